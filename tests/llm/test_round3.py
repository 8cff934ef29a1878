"""Memory of batches, pieces with marks, line rules without counts, and what near dedup joins."""

import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import bpe, minhash_dedup, suffix_dedup, weak_labels, word_pieces
from quarrylog.llm.queries import tokenizer_path
from quarrylog.llm.quality_rules import DEFAULT, has_words, line_passes, words_of


class Task:
    """A frame whose ``mapInArrow`` runs here, on the batches given."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, _):
        return list(run(iter(self.batches)))


def test_runs_are_sorted_in_batches_of_bounded_bytes(monkeypatch):
    """Runs of one string hold 400 bytes each: 20,000 of them are 8 MB, far below the limit on strings."""
    rng, n = random.Random(1), 20_000
    bodies = [rng.randbytes(400) for _ in range(n // 2)]
    columns = [range(n), range(n), [0] * n, [1] * n, [0] * n, [i // 2 for i in range(n)], [bodies[i // 2] for i in range(n)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "start", "n", "offset", "h", "body"])
    sizes, sort = [], suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda bodies, *a: sizes.append(sum(map(len, bodies))) or sort(bodies, *a))
    out = suffix_dedup.sorted_spans(Task([batch.slice(i, 10_000) for i in (0, 10_000)]), suffix_dedup.DEFAULT)
    assert max(sizes) < suffix_dedup.DEFAULT.batch_bytes + 1000 and sum(sizes) == 400 * n
    # One span for a run at most: the rows out never exceed the rows in.
    assert sum(b.num_rows for b in out) == n


def test_memos_of_other_operators_are_dropped():
    memos = vars(sys).setdefault("_quarrylog_memos", {})
    before = dict(memos)
    try:
        word_pieces.worker_memo("hasher")["one"] = 1
        word_pieces.worker_memo("whole:other")["piece"] = b"x"
        word_pieces.give_back_memory()
        assert "whole:other" in memos
        word_pieces.give_back_memory("hasher")
        assert list(memos) == ["hasher"]
    finally:
        memos.clear()
        memos.update(before)


def test_words_with_marks_go_to_the_model_not_to_the_whole_tokenizer():
    name, text = "round3", word_pieces.tokenizer_text(tokenizer_path())
    tokenizer = word_pieces.library_tokenizer(name, text)
    pieces = ["NO!!", "ofing$$$", "don't", "abc'", "abc'.", "x''s", "É...", "ñu%", "<|endoftext|>", "abc<|endoftext|>", "a|>", "75.76", "!!", "ªb", "ab×"]
    pieces += ["".join(random.Random(i).choices("aBé!'<|>.s7", k=6)) for i in range(2000)]
    encode = word_pieces.LibraryPieces(tokenizer, name)
    seen, whole = [], encode._of_texts
    encode._of_texts = lambda texts: seen.extend(texts) or whole(texts)
    got = encode(pieces)
    assert got == [word_pieces.packed(e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
    assert not {"NO!!", "ofing$$$", "É..."} & set(seen) and "abc<|endoftext|>" in seen


LINES = ["", " ", "a", "a b c", "a b c d", "\ta  b\tc \x0b d", " a b c ", "A B C D", "AB CD EF GH ij", "a | b | c | d", "a » b › c • d", "a | b » c", "a|b|c.", "home", "uses cookies here now ok.", "#### ## a b c d", "x" * 50, "a b c d", "A b c. "]


def test_open_lines_are_told_without_a_count(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string")
    n = F.size(words_of(F.col("line")))
    got = rows.select("line", *[(has_words(F.col("line"), k) == (n >= k)).alias(str(k)) for k in (1, 2, 4)]).collect()
    assert all(r["1"] and r["2"] and r["4"] for r in got)


def test_separators_of_all_kinds_count_together(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string")
    many = has_words(F.col("line"), DEFAULT.min_open_line_words)
    ok = {r["line"]: r["ok"] for r in rows.select("line", line_passes(F.col("line"), many, DEFAULT).alias("ok")).collect()}
    assert not ok["a | b | c | d"] and not ok["a » b › c • d"] and not ok["home"] and not ok["AB CD EF GH ij"]
    assert ok["a b c d"] and not ok["a b c"] and not ok["uses cookies here now ok."]


@pytest.mark.parametrize("text, n", [("AB cd", 1), ("aB AB1 1AB É1", 3), ("A b", 0), ("A1 1 B-", 2), ("-A\nÑO", 2), ("ABc", 0)])
def test_words_of_capitals(spark, text, n):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(F.regexp_count("text", F.lit(weak_labels.CAPITAL_WORD))).first()[0] == n


def test_a_member_of_many_nodes_is_joined_once(spark, monkeypatch):
    """Texts of one template meet in many nodes: their facts are joined by member and dealt out after that."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() < 0.95 else f"x{rng.random()}" for w in base) for _ in range(40)]
    seen, links = [], minhash_dedup._dense_links

    def looked_at(rows, config):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        seen.append((plan.index("Generate explode(paths"), plan.index("Join Inner"), rows.count(), rows.select("cid").distinct().count()))
        return links(rows, config)

    monkeypatch.setattr(minhash_dedup, "_dense_links", looked_at)
    config = minhash_dedup.Config(node_limit=2, dense_depth=2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, config=config).collect()}
    assert seen and all(generate < join and memberships > members for generate, join, memberships, members in seen)
    sets = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                want = [min(want[i], want[j]) if c in (want[i], want[j]) else c for c in want]
    assert got == dict(enumerate(want))


def test_proposals_try_no_length_that_no_token_has():
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

    text = word_pieces.tokenizer_text(tokenizer_path())
    coder = bpe.WordBpe(text, word_pieces.library_tokenizer("round3", text))
    coder.vocab = Counted(coder.vocab)
    word = "zqxjk" * 12
    tokens = coder.proposed(word)
    assert "".join(coder.surface[t] for t in tokens) == word + coder.suffix
    # From every position 30 lengths could be tried; no token is that long here.
    assert Counted.n < 4 * len(word)


def test_pieces_of_all_kinds_keep_their_places():
    """All pieces are matched as lines of one string; an empty one, one of marks and one that repeats stay where they are."""
    text = word_pieces.tokenizer_text(tokenizer_path())
    library = word_pieces.library_tokenizer("round3", text)
    pieces = ["", "Été,", "...", "a\x85b", "x</s>y", "</s>", "日本", "don't", "END", "", "END", "word!?", "\x1c", ""]
    want = [word_pieces.packed(library.encode(p, add_special_tokens=False).ids) for p in pieces]
    assert word_pieces.PARTS.groups == word_pieces.PLAIN.groups == 3
    assert word_pieces.LibraryPieces(library, "round3-kinds")._of_parts(pieces) == want
    assert bpe.WordBpe(text, library).encode_new(pieces) == want
