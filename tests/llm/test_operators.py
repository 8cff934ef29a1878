"""Operators against brute force on small inputs: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import bpe, chat_format, exact_dedup, minhash_dedup, mixing, quality_rules, suffix_dedup, token_counts, token_store, weak_labels
from quarrylog.llm.queries import tokenizer_path
from quarrylog.session import new_shared_path

SCHEMA = "doc_id long, text string, lang string, source string, row string, id long, digest string, body string, n_words int"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def frame(spark, texts, ids=None):
    """Documents with extra columns named like those the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, f"s{k % 4}", "x", 1, "d", "b", 7) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ODD = [None, "", " \n\t", "a", "one two", "é́ ǅ İ I'LL <|endoftext|>x 1234 😀\x1c\x00 z", "word " * 3000, "same text", "same text", "Ünï ÀSΣ. don't ., a,b c.. d.,"]


def test_suffix_dedup_matches_brute_force(spark):
    rng, length = random.Random(3), 40
    make = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    passage, line = make(80, "abcdefgh"), make(25, "abcdé")
    texts = []
    for i in range(120):
        t = make(rng.randrange(120), "abcdefghij")
        t += passage + make(rng.randrange(40), "abc xyz") if i % 3 == 0 else ""
        t += line + make(30, "klm") if i % 4 == 0 else ""
        texts.append(t + (t[:60] if i % 7 == 0 else "") + ("a" * 100 + "xy" * 60 if i % 50 == 0 else ""))
    texts += texts[:8] + [None, ""]
    bodies = [(t or "").encode() for t in texts]
    starts = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    expected = {}
    for k, b in enumerate(bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        expected[k] = bytes(c for c, g in zip(b, gone) if not g), len(re.findall(b"\x01+", bytes(gone)))
    for config in (suffix_dedup.Config(length, 16), suffix_dedup.Config(length, 8, 2, (8, 2, 1), 500)):
        got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.remove_repeats(frame(spark, texts), config=config).collect()}
        assert got == expected


def test_suffix_dedup_of_one_repeated_row(spark):
    text = "".join(random.Random(1).choices("abcdef", k=900))
    rows = suffix_dedup.remove_repeats(frame(spark, [text, text, "b" * 399], ids=[5, 5, None])).collect()
    assert sorted((r.doc_id or -1, len(r.kept)) for r in rows) == [(-1, 399), (5, 0), (5, 0)]


def test_hash_collisions_are_seen(monkeypatch):
    """With hashes that never differ, only the bytes decide."""
    monkeypatch.setattr(suffix_dedup.SuffixSort, "extension", lambda self, a, b: np.full(len(a), self.length))
    bodies = [b"x" * 40, b"x" * 39 + b"y", b"x" * 40]
    first, last = suffix_dedup.repeated_spans(bodies, np.zeros(3, int), np.zeros(3, int), np.ones(3, int), 40)
    assert list(zip(first, last)) == [(0, 0), (-1, -1), (0, 0)]


def repeat_words(w, n=8):
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})


def test_quality_figures_and_verdicts(spark):
    rng = random.Random(2)
    clean = "\n".join(" ".join(rng.choices([f"w{i}" for i in range(500)], k=12)) + "." for _ in range(10))
    menu = "\n".join("Home | About | News | Contact" for _ in range(10)) + "\n" + "A plain line of several words here."
    texts = [*ODD, clean, menu, " ".join(rng.choices("abcd", k=400)), clean + "\n" + clean]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w, r = words(t), got[k]
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeat_words(w))
        assert r.base_failed == (len(w) < 20 or 100 * repeat_words(w) > 30 * len(w))
    assert got[len(ODD)].kept and not got[len(ODD) + 1].kept and got[len(ODD)].cleaned == clean
    docs = frame(spark, texts)
    assert quality_rules.drop_rejected(docs).columns == docs.columns
    assert {r.doc_id for r in quality_rules.drop_rejected(docs).collect()} == {k for k, r in got.items() if r.kept}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def corpus_texts(n=60):
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:n]


def test_bpe_equals_the_library(spark, library):
    texts = ODD + corpus_texts()
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts), tokenizer_path()).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[k].ids) == ids and got[k].decoded == library.decode(ids, skip_special_tokens=False)


def test_speculation_and_exact_merging_agree(library):
    from quarrylog.llm.word_pieces import tokenizer_text

    coder = bpe.WordBpe(tokenizer_text(tokenizer_path()), library)
    rng = random.Random(4)
    some = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 14))) for _ in range(3000)]
    exact = [bpe.packed(coder.merged(coder.symbols(w + "</w>"))) for w in some]
    assert coder.encode_words(some) == exact and coder.n_speculated > 0 and coder.n_exact > 0


def test_token_counts_and_store(spark, library):
    texts = ODD + corpus_texts()
    docs = frame(spark, texts)
    encoded = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in token_counts.token_counts(docs, tokenizer_path()).collect()}
    assert all((got[k].n_bytes, got[k].n_tokens) == (len((t or "").encode()), len(encoded[k])) for k, t in enumerate(texts))
    path = new_shared_path(spark, "store")
    token_store.write_store(docs, path, tokenizer_path())
    back, at = {r.doc_id: r for r in token_store.read_digests(spark, path).collect()}, 0
    for k, ids in enumerate(encoded):
        raw = np.array([*ids, 1], "<u4").tobytes()
        assert (back[k].start, back[k].n_tokens, back[k].ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw))
        at += len(ids) + 1


def test_planes_round_trip():
    for n in (0, 1, token_store.BLOCK_IDS, token_store.BLOCK_IDS * 2 + 5):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        assert np.array_equal(token_store.from_planes(token_store.to_planes(ids)), ids)


def near_brute(texts, n, percent):
    sets = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        m = min(n, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("config", [minhash_dedup.CONTRACT, minhash_dedup.Config(words=5, percent=80, node_limit=3), minhash_dedup.Config(node_limit=2, dense_members=5)])
def test_near_duplicates_match_brute_force(spark, config):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    common, texts = " ".join(rng.choices(vocabulary, k=30)), list(ODD)
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(30, 150))
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            t = " ".join(copy) + (" " + common if g % 3 == 0 else "")
            texts.append(t.upper() if rng.random() < 0.2 else t)
    sizes, roots = near_brute(texts, config.words, config.percent)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, texts), config=config).collect()}
    assert [(got[k].n_shingles, got[k].component_id, got[k].kept) for k in range(len(texts))] == [(n, r, r == k) for k, (n, r) in enumerate(zip(sizes, roots))]


def test_chat_format_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[ROLE] x [/ROLE] ", "<", "[", None, "é\n", "<s", "\\\\</s>\\"]
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo")]
    rows += [(2, k, ("user", "assistant", "tool </s>", None)[k % 4], t) for k, t in enumerate(tricky)]
    rows += [(None, 0, "user", "no id"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    done = chat_format.format_conversations(turns)
    back = done.select("conv_id", "valid", "formatted", "segments", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()
    by_id = {r.conv_id: r for r in back}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x[1:])
        assert [(t.role, t.text) for t in by_id[conv].t] == [(r, x) for _, _, r, x in own]
        assert by_id[conv].loss == "".join(x for _, _, r, x in own if r == "assistant")
        assert "".join(s.text for s in by_id[conv].segments) == by_id[conv].formatted
    assert {c: r.valid for c, r in by_id.items()} == {1: True, 2: False, 3: False, 4: False, None: False}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")])
def test_exact_groups_compare_bytes(spark, digest):
    texts = [*ODD, "same text", "same TEXT", "x" * 50_000, "x" * 50_000]
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(t or "", []).append(k)
    got = exact_dedup.exact_groups(frame(spark, texts), digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""])) for k, t in enumerate(texts)]


def test_exact_state_over_several_batches(spark):
    path = new_shared_path(spark, "narrow")
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("digest"), "id").repartition(5)
    rows.write.parquet(path)
    state = exact_dedup.run_state(spark, path, rows.schema, files_per_batch=1).collect()
    assert sorted((r.digest, r.keep_id, r.locator, r.group_size) for r in state) == [(str(d), max(range(d, 100, 7)), d, len(range(d, 100, 7))) for d in range(7)]


def test_drop_copies_keeps_one_row_each(spark):
    texts, ids = ["a", "a", "b", None, "", "b"], [1, 1, 2, 3, None, 2]
    left = exact_dedup.drop_copies(frame(spark, texts, ids))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "a"), (2, "b"), (3, "")]
    assert left.columns == SCHEMA.replace(",", "").split()[::2]


def test_raking_meets_the_targets(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "a", "a", "b"]), rng.choice(["x", "y", None]), rng.choice("pq"), rng.randrange(1, 90)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long")
    want = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.5, "y": 0.3, mixing.NONE: 0.2}}
    targets = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in want.items()}
    got = mixing.mix(docs, "doc_id", "n", targets=targets, rounds=12).collect()
    total = sum(r.tokens for r in got)
    assert len(got) == len(rows) and sum(r.tokens * r.weight for r in got) == pytest.approx(total)
    for d, shares in want.items():
        for value, share in shares.items():
            assert sum(r.tokens * r.weight for r in got if r[d] == value) / total == pytest.approx(share, abs=1e-4)
    # The draw without copies keeps the weights' proportions wherever it does not keep everything.
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(mixing.KEPT_SHARE * total)
    open_ = {r.probability / r.weight for r in got if r.probability < 1}
    assert max(open_) == pytest.approx(min(open_)) and all(r.weight * max(open_) >= 1 - 1e-9 for r in got if r.probability == 1)
    assert sum(r.kept for r in got) == pytest.approx(sum(r.probability for r in got), rel=0.1)


def test_one_rare_document_leaves_the_others(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice("aaab"), rng.choice("xxy"), rng.choice("pq"), rng.randrange(1, 90)) for k in range(2000)] + [(2000, None, "z", "p", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long")
    total = sum(r[-1] for r in rows)
    got = mixing.mix(docs, "doc_id", "n").collect()
    assert len(got) == len(rows) and sum(r.tokens * r.copies for r in got) == pytest.approx(total, rel=0.05)
    assert sum(r.copies > 0 for r in got) > 0.8 * len(rows)
    assert next(r.copies for r in got if r.id == 2000) > 1
    raised = Counter()
    for r in rows:
        raised[r[1]] += r[-1]
    raised = {k: n**0.7 for k, n in raised.items()}
    for source in "ab":
        now = sum(r.tokens * r.weight for r in got if r.source == source) / total
        assert now == pytest.approx(raised[source] / sum(raised.values()), abs=1e-3)
    left = mixing.sample(docs, "doc_id", F.col("n"), F.col("topic")).collect()
    assert len(set(left)) == len(left) and set(left) <= set(docs.collect()) and 2000 in {r.doc_id for r in left}
    assert sum(r.n for r in left) == pytest.approx(mixing.KEPT_SHARE * total, rel=0.05)


def test_trees_that_went_deep_are_repeated(spark):
    """Pairs at the threshold among unlike texts of one template, in nodes that no task may compare in full."""
    rng = random.Random(9)
    template, texts = [f"t{i}" for i in range(102)], []
    for g in range(100):
        base = list(template)
        for at in rng.sample(range(10, 55, 4), 3):
            base[at] = f"g{g}x{at}"
        copy = list(base)
        for at in (1, 62, 80):
            copy[at] = f"g{g}y{at}"
        texts += [" ".join(base), " ".join(copy)]
    config = minhash_dedup.Config(trees=4, node_limit=2, dense_depth=1, dense_members=3, max_depth=5)
    _, roots = near_brute(texts, config.words, config.percent)
    assert roots == [k - k % 2 for k in range(200)]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, texts), config=config).collect()}
    assert [got[k] for k in range(200)] == roots


def test_tree_recall_falls_with_depth():
    for config in (minhash_dedup.CONTRACT, minhash_dedup.STAGE):
        by_depth = [minhash_dedup.tree_recall(config, d) for d in (1, 3, 10, 20, 40)]
        assert by_depth == sorted(by_depth, reverse=True) and by_depth[1] > config.target_recall > by_depth[3]


def test_weak_labels_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = weak_labels.classify(docs).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in got]) > 0.95
    odd = {r.doc_id: r for r in weak_labels.classify(frame(spark, ODD)).collect()}
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd.values())


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    bad_rate = np.array([0.6, 0.5, 0.7, 0.4])
    votes = np.where(~truth[:, None] & (rng.random((20_000, 4)) < bad_rate), weak_labels.BAD, weak_labels.GOOD)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = weak_labels.fit_votes(patterns, counts.astype(float), 100)
    assert prior == pytest.approx(0.8, abs=0.05) and (table[:, 1, weak_labels.BAD] < 0.02).all()


@pytest.mark.parametrize("run", [
    lambda d: suffix_dedup.remove_repeats(d), lambda d: quality_rules.judge(d), lambda d: bpe.encode_decode(d, tokenizer_path()),
    lambda d: minhash_dedup.near_duplicates(d), lambda d: weak_labels.classify(d), lambda d: token_counts.token_counts(d, tokenizer_path()),
    lambda d: exact_dedup.exact_groups(d), lambda d: mixing.mix(d, "doc_id", "n_words", ("source", "lang")),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
