"""What the term queries store and send: packed chunks of counts, not a row for each document and term."""

import glob
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarrylog.operators import clustering, term_blocks

WORDS = [f"w{i}" for i in range(40)] + ["é", "w1 w2"]


def made(seed, docs):
    rng = random.Random(seed)
    return [(i, rng.choice("cde"), [WORDS[int(len(WORDS) * rng.random() ** 2)] for _ in range(rng.randrange(60))]) for i in range(docs)]


def batch(rows):
    names, types = ["c", "k", "w"], [pa.string(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(c, k, w) for k, c, w in rows]), types)], names=names)


def stored_rows(spark, run):
    """The result of ``run`` and the rows of the tables that it leaves behind."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/**/*.parquet", recursive=True))
    got = run()
    left = set(glob.glob(f"{folder}/**/*.parquet", recursive=True)) - before
    return got, sum(pq.read_metadata(f).num_rows for f in left if os.path.exists(f))


def test_chunks_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(term_blocks, "TOKENS", 100)
    monkeypatch.setattr(term_blocks, "SLICE", 30)
    rows = sorted(made(1, 80), key=lambda r: (r[1], r[0]))
    rows = [x for r in rows for x in ([r, r] if r[0] % 7 == 0 else [r])]  # equal keys are one document
    rows[5] = (*rows[5][:2], None)
    for n in (1, 2, 3):
        want = Counter()
        for k, c, w in rows:
            want.update((c, k, " ".join((w or [])[i : i + n])) for i in range(len(w or []) - n + 1))
        got, parts, chunks = Counter(), defaultdict(set), 0
        for chunk in term_blocks.chunks(iter([batch(rows[:50]), batch(rows[50:])]), n, 5):
            chunks += 1
            texts = chunk.texts.to_pylist()
            assert sorted(chunk.part.tolist()) == chunk.part.tolist()
            for doc, term, tf in zip(chunk.doc.tolist(), chunk.term.tolist(), chunk.tf.tolist(), strict=True):
                cluster = chunk.clusters[chunk.term_cluster[term]]
                assert cluster == chunk.clusters[chunk.doc_cluster[doc]]
                assert (cluster, chunk.docs[doc], texts[term]) not in got
                got[cluster, chunk.docs[doc], texts[term]] = tf
                parts[texts[term]].add(int(chunk.part[term]))
        assert got == want and chunks > 10
        assert all(len(p) == 1 for p in parts.values()) and len({x for p in parts.values() for x in p}) == 5


def test_packed_numbers_and_texts_come_back():
    for x in ([], [0, 3, 255], [-1, 127], [-129, 5], [2**63 - 1, -(2**63)], [2**40]):
        assert term_blocks.unpack(term_blocks.pack(np.array(x, np.int64))).tolist() == x
    assert term_blocks.unpack(term_blocks.pack(np.array([0.5, -1e300]))).tolist() == [0.5, -1e300]
    texts = pa.array(["", "é a", "b"], pa.large_string())
    assert term_blocks.unpack_texts(*term_blocks.pack_texts(texts.slice(1))).to_pylist() == ["é a", "b"]


def test_cluster_terms_store_no_row_for_each_term(spark, monkeypatch):
    """Over many chunks and parts, with ties; what is left is the few terms that may lead."""
    monkeypatch.setattr(term_blocks, "PART_DOCS", 20)
    docs = made(2, 150)
    counts = {(k, c): Counter(" ".join(w[i : i + 2]) for i in range(len(w) - 1)) for k, c, w in docs}
    n, df, score = Counter(c for _, c, _ in docs), Counter(), Counter()
    for (_, c), terms in counts.items():
        df.update((c, t) for t in terms)
    idf = {x: math.log((1 + n[x[0]]) / (1 + f)) + 1 for x, f in df.items()}
    for (_, c), terms in counts.items():
        length = math.sqrt(sum((f * idf[c, t]) ** 2 for t, f in terms.items()))
        for t, f in terms.items():
            score[c, t] += f * idf[c, t] / length
    frame = spark.createDataFrame(docs, "i long, g string, w array<string>")
    weights = {(r["g"], r["i"], r["term"]): (r["df"], r["w"]) for r in clustering.tfidf(frame, "i", "g", F.col("w"), 2).collect()}
    assert len(weights) == sum(map(len, counts.values())) and all(df[c, t] == f for (c, _, t), (f, _) in weights.items())
    for top in (3, 25):
        (got, left) = stored_rows(spark, lambda: clustering.cluster_terms(frame, "i", "g", F.col("w"), 2, top).collect())
        for c in "cde":
            want = sorted((-round(s, 9), t) for (g, t), s in score.items() if g == c)[:top]
            have = sorted((-r["score"], r["term"]) for r in got if r["g"] == c)
            assert [t for _, t in have] == [t for _, t in want] and np.allclose([s for s, _ in have], [s for s, _ in want], atol=2e-9)
        assert left < sum(map(len, counts.values())) / 4


def test_latent_terms_send_vectors_by_block(spark, monkeypatch):
    """Many blocks, parts and stripes: one vector for each block and term is sent, at most ten elements at a time; nothing of it stays."""
    from quarrylog.operators import term_vectors

    monkeypatch.setattr(term_blocks, "PART_DOCS", 30)
    docs = [(None if i == 7 else i, w if i != 9 else []) for i, _, w in made(3, 120)]
    docs.append(docs[20])  # one key twice
    frame = spark.createDataFrame(docs, "i long, w array<string>").repartition(6)

    def run():
        rows = clustering.latent_terms(frame, "i", F.col("w"), 4, min_df=3, max_share=0.9).collect()
        return {r["i"]: np.array(r["vector"]) for r in rows}, len(rows)

    seen, by_term = [], term_vectors.sums_by_term
    monkeypatch.setattr(term_vectors, "sums_by_term", lambda met, n, turn: seen.append(turn.shape[1]) or by_term(met, n, turn))
    (one, count), left = stored_rows(spark, run)
    monkeypatch.setattr(term_vectors, "BLOCK", 300)
    monkeypatch.setattr(term_vectors, "STRIPE", 3)
    (many, _), _ = stored_rows(spark, run)
    assert count == 121 and not one[None].any() and not one[9].any()
    assert max(np.abs(one[i] - many[i]).max() for i in one) < 1e-9
    assert seen[:3] == [10, 4, 10] and max(seen[6:]) == 3
    assert left < 100
