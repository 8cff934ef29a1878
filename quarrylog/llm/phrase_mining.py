"""Phrase collocations by a multikey three-way quicksort of suffix pointers to a depth of ``max_words``.

1. A pass over the texts counts words (summed per block before they are
   exchanged) and finds the hot prefixes, those of two or three words that hold
   more than a stated share of all suffixes.
2. A second pass cuts every suffix after ``max_words`` words, sums equal ones
   per block and routes them by their leading words: by two, or by three or four
   where the shorter prefix is hot. A bucket receives all suffixes of its
   prefixes, so no phrase is counted in two places.
3. Every bucket sorts pointers to its suffixes: all its partitions are split at
   once around a pivot each into less, equal and greater. An equal partition's
   size is the count of the words it shares; it goes on at the next word.
   A partition of fewer than ``least`` suffixes holds no candidate and is
   abandoned.
4. Candidates are scored by their cuts, contained ones dropped and the best of
   each language ranked, with exact integers.

Bounds: a bucket holds the suffixes of about ``bucket_bytes`` of text, and no
prefix that is routed as a whole holds more than a ``hot_share``-th of all. The list
of hot prefixes (8 bytes each) has at most ``4 * hot_limit`` entries, whatever the
input. A block's texts are read by one task at a time (``block_bytes``; one
longer text is a block of its own).

Defined cases: a null or empty text has no words. A null language is ``und``.
Repeated rows count each time. Pieces end with their text. Languages without a
candidate do not appear. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.rolling import Hasher, mixed
from quarrylog.llm.word_pieces import blocks, give_back_memory, worker_memo
from quarrylog.operators.joins import first_per_group, spread_join
from quarrylog.session import cut_lineage

SPACES, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANG = "und"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTOR = np.uint64(0x9FB21C651E98DF25)
DEPTHS = 5  # the language and up to four words
RECORD = 7  # those, the count and the number of words that a suffix is routed by


@dataclass(frozen=True)
class Config:
    least: int = 30
    contained_percent: int = 80
    top: int = 2000
    scale: int = 2_000_000
    block_bytes: int = 4 << 20
    bucket_bytes: int = 8 << 20
    hot_per_bucket: int = 4
    hot_limit: int = 1 << 16


CONTRACT = Config()


class Block(NamedTuple):
    """Words of some texts: ``lang[i], word[i]`` (codes; words from 1) and ``more[i]``, how many words follow in the piece (3 at most)."""

    langs: list[str]
    words: pa.Array
    lang: np.ndarray
    word: np.ndarray
    more: np.ndarray

    def hashes(self) -> np.ndarray:
        """A hash per word code; code 0 is the end of a piece."""
        memo = worker_memo("hasher")
        hasher = memo.setdefault("one", Hasher())
        offsets = np.frombuffer(self.words.buffers()[1], np.int32)[: len(self.words) + 1].astype(np.int64)
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        spans = hasher.spans(hasher.prefix(data[: offsets[-1]]), offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64)
        return np.concatenate((np.zeros(1, np.uint64), mixed(spans)))

    def lang_hashes(self) -> np.ndarray:
        memo, hasher = worker_memo("hasher"), Hasher()
        hasher = memo.setdefault("one", hasher)
        one = [np.frombuffer(x.encode(), np.uint8) for x in self.langs]
        return mixed(np.array([hasher.prefix(x)[-1] + np.uint64(len(x)) for x in one], np.uint64))


def read_block(bodies: pa.Array, langs: pa.Array) -> Block:
    """The words of texts (binary) in their languages."""
    listed = bodies.to_pylist()
    sizes = np.fromiter((len(b) + 1 for b in listed), np.int64, len(listed))
    data = _LOWER[np.frombuffer(b"\n".join(listed) + b"\n", np.uint8)]
    del listed
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    more = np.zeros(len(start), np.int8)
    for o in (1, 2, 3):
        more[: len(start) - o] += piece[: len(start) - o] == piece[o:] if len(start) > o else 0
    known = langs.dictionary_encode()
    per_text = np.diff(np.concatenate((np.searchsorted(start, np.cumsum(sizes) - sizes), [len(start)])))
    lang = np.repeat(known.indices.to_numpy(zero_copy_only=False), per_text)
    return Block(known.dictionary.to_pylist(), coded.dictionary, lang, coded.indices.to_numpy(zero_copy_only=False) + np.int32(1), more)


def _at(block: Block, o: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Code of the word ``o`` places on, 0 beyond the piece."""
    shifted = np.zeros_like(block.word)
    if o < len(shifted):
        shifted[: len(shifted) - o] = block.word[o:]
    return np.where(block.more >= o, shifted, 0)[at]


def _joined_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * _FACTOR + word)


def _tally(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (language, word) codes as one number each, their counts, and the count of every position's own."""
    keys = block.lang * np.int64(len(block.words) + 1) + block.word
    if len(block.langs) * len(block.words) > 4 * len(keys):  # many languages
        distinct, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return distinct, counts, counts[which]
    counts = np.bincount(keys)
    distinct = np.flatnonzero(counts)
    return distinct, counts[distinct], counts[keys]


def word_counts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, words and counts of the distinct pairs."""
    size = np.int64(len(block.words) + 1)
    keys, counts, _ = _tally(block)
    return keys // size, keys % size, counts


def hot_prefixes(block: Block, least: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Prefixes of two and of three words with at least ``least`` suffixes in the block: number of words, hashes, counts."""
    out, frequent = [], _tally(block)[2] >= least
    # Every word of a hot prefix is at least as frequent.
    both = frequent[:-1] & frequent[1:] & (block.more[:-1] >= 1) if len(frequent) else frequent
    at = np.flatnonzero(both)
    words, langs = block.hashes(), block.lang_hashes()
    h = _joined_hash(langs[block.lang[at]], words[block.word[at]])
    for o in (1, 2):
        h = _joined_hash(h, words[_at(block, o, at)])
        _, which, n = np.unique(h, return_inverse=True, return_counts=True)
        hot = n[which] >= least
        at, h = at[hot], h[hot]
        out.append((o + 1, *np.unique(h, return_counts=True)))
        going = block.more[at] >= o + 1
        at, h = at[going], h[going]
    return out


def suffixes(block: Block) -> np.ndarray:
    """Distinct suffixes of two words and more, in order: rows of language, four words and count."""
    size = np.int64(len(block.words) + 1)
    at = np.flatnonzero(block.more >= 1)
    lang, w = block.lang[at], [_at(block, o, at) for o in range(4)]
    high, low = (lang * size + w[0]) * size + w[1], w[2] * size + w[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if len(order) else order
    picked = order[new]
    return np.stack([lang[picked], *[x[picked] for x in w], np.diff(np.concatenate((new, [len(order)]))).astype(np.int32)])


def route(block: Block, rows: np.ndarray, hot: dict[int, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` with the number of words each is routed by, and its bucket.

    A hot prefix is spread over buckets, so its own count goes to the bucket of
    its hash as one more row that ends with the prefix.
    """
    words = block.hashes()
    h = _joined_hash(_joined_hash(block.lang_hashes()[rows[0]], words[rows[1]]), words[rows[2]])
    by, own = np.full(rows.shape[1], 2, np.int32), [rows]
    depths, hashes, at, deep = [by], [h], np.arange(rows.shape[1]), h
    for d in (2, 3):
        # A prefix that ends its piece here stays with the prefix's own count.
        spread = np.isin(deep, hot[d]) & (rows[d + 1, at] > 0)
        at, deep = at[spread], deep[spread]
        if not len(at):
            break
        _, one, which = np.unique(deep, return_index=True, return_inverse=True)
        ended = rows[:, at[one]]
        ended[d + 1 : DEPTHS] = 0
        ended[DEPTHS] = np.bincount(which, weights=rows[DEPTHS, at])
        own.append(ended)
        depths.append(np.full(len(one), d, np.int32))
        hashes.append(deep[one])
        deep = _joined_hash(deep, words[rows[d + 1, at]])
        by[at], h[at] = d + 1, deep
    return np.vstack([np.hstack(own), np.concatenate(depths)]), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)


def pack(rows: np.ndarray, words: pa.Array, compress) -> tuple[bytes, bytes]:
    """Rows with codes into a word list of their own, and that list; byte planes, compressed."""
    seen = np.zeros(len(words) + 1, bool)
    seen[rows[1:DEPTHS].ravel()] = True
    seen[0] = False
    kept = np.flatnonzero(seen)
    codes = np.zeros(len(seen), np.int32)
    codes[kept] = np.arange(1, len(kept) + 1)
    rows[1:DEPTHS] = codes[rows[1:DEPTHS]]
    planes = np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(-1, 4).T)
    listed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), words.take(pa.array(kept - 1))), b" ")
    return compress(planes), compress(listed[0].as_py())


def _split_words(listed: bytes) -> pa.Array:
    """The words of a list that ``pack`` joined."""
    data = np.frombuffer(listed, np.uint8)
    gap = data == SPACES[0]
    ends = np.concatenate((np.flatnonzero(gap), [len(data)] if len(data) else []))
    offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])


def unpack(packed: list[tuple[bytes, bytes, list[str]]], expand) -> tuple[np.ndarray, pa.Array, list[str]]:
    """Rows of several packs with codes into common word and language lists."""
    lists = [_split_words(expand(listed)) for _, listed, _ in packed]
    common = pa.concat_arrays(lists).dictionary_encode()
    code, at = common.indices.to_numpy(zero_copy_only=False) + np.int32(1), 0
    rows, langs = [], {}
    for (body, _, names), listed in zip(packed, lists, strict=True):
        planes = np.frombuffer(expand(body), np.uint8).reshape(4, -1)
        own = np.ascontiguousarray(planes.T).view(np.int32).reshape(RECORD, -1)
        own[1:DEPTHS] = np.concatenate((np.zeros(1, np.int32), code[at : at + len(listed)]))[own[1:DEPTHS]]
        own[0] = np.array([langs.setdefault(x, len(langs)) for x in names], np.int32)[own[0]]
        at += len(listed)
        rows.append(own)
    return np.hstack(rows), common.dictionary, list(langs)


def sort_suffixes(rows: np.ndarray, least: int):
    """Multikey three-way quicksort of pointers to ``rows`` (language, words, count, routed by), all partitions at a time.

    Returns the frequent prefixes as (number of words, pointer to a suffix, count) arrays.
    """
    width = rows.shape[1]
    keys, counts, routed = rows[:DEPTHS].ravel(), rows[DEPTHS].astype(np.float64), rows[DEPTHS + 1]
    spread = bool((routed > 2).any())
    at = np.arange(width)  # pointers, partition after partition
    sizes, depth = np.array([len(at)]), np.zeros(1, np.int64)
    found = []
    while len(at):
        ends = np.cumsum(sizes)
        starts = ends - sizes
        key = keys[np.repeat(depth * width, sizes) + at]
        three = np.stack([key[starts], key[starts + sizes // 2], key[ends - 1]])
        pivot = np.sort(three, axis=0)[1]
        key -= np.repeat(pivot, sizes)
        side = np.sign(key, out=key) + np.int32(1)
        part = np.repeat(np.arange(len(sizes)) * 3, sizes) + side
        n = np.bincount(part, minlength=3 * len(sizes))
        held = counts[at]
        weight = np.bincount(part, weights=held, minlength=len(n))
        base = np.cumsum(n) - n
        moved = np.empty_like(at)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            m = n[s::3]
            moved[np.repeat(base[s::3] - (np.cumsum(m) - m), m) + np.arange(len(mine))] = at[mine]
        # An equal partition's size is the count of its words, of those suffixes that were routed by no more words.
        size = np.bincount(part, weights=held * (routed[at] <= np.repeat(depth, sizes)), minlength=len(n))[1::3] if spread else weight[1::3]
        count = (depth >= 2) & (pivot > 0) & (size >= least)
        found.append((depth[count], moved[base[1::3][count]], size[count].astype(np.int64)))
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        going = weight >= least
        going[1::3] &= (depth + 1 < DEPTHS) & ((pivot > 0) | (depth == 0))
        at = moved[np.repeat(going, n)]
        sizes, depth = n[going], deeper[going]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _first_pass(texts: DataFrame, config: Config, hot_share: int) -> DataFrame:
    """``words, lang, phrase, h, n``: word counts per block, and prefixes that are hot in a block (by hash)."""

    def run(batches):
        give_back_memory()
        for batch in batches:
            for piece in blocks(batch, 1, config.block_bytes):
                block = read_block(piece.column(1), piece.column(0))
                lang, word, n = word_counts(block)
                names = pa.array(block.langs, pa.string()).take(pa.array(lang))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), names, block.words.take(pa.array(word - 1)).cast(pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64())], names=FIRST)
                for k, h, n in hot_prefixes(block, max(2.0, len(block.word) / (2 * hot_share))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=FIRST)

    return cut_lineage(texts.mapInArrow(run, "words int, lang string, phrase string, h long, n long"))


FIRST = ["words", "lang", "phrase", "h", "n"]


def _routed(texts: DataFrame, config: Config, hot: dict[int, np.ndarray], buckets: int) -> DataFrame:
    """``bucket, langs, words, body``: the suffixes of every block, by bucket."""

    def run(batches):
        give_back_memory()
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece in blocks(batch, 1, config.block_bytes):
                block = read_block(piece.column(1), piece.column(0))
                rows, bucket = route(block, suffixes(block), hot, buckets)
                order = np.argsort(bucket, kind="stable")
                which, starts = np.unique(bucket[order], return_index=True)
                for b, own in zip(which.tolist(), np.split(order, starts[1:]) if len(order) else [], strict=True):
                    body, words = pack(rows[:, own], block.words, compress)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([block.langs], pa.list_(pa.string())), pa.array([words], pa.binary()), pa.array([body], pa.binary())], names=["bucket", "langs", "words", "body"])

    return texts.mapInArrow(run, "bucket long, langs array<string>, words binary, body binary")


def _counted(routed: DataFrame, config: Config, buckets: int) -> DataFrame:
    """``lang, phrase, words, f`` of the frequent phrases of two words and more."""

    def frequent(packed):
        rows, words, langs = unpack(packed, zstandard.ZstdDecompressor().decompress)
        depth, at, n = sort_suffixes(rows, config.least)
        spoken = [words.take(pa.array(np.maximum(rows[c, at] - 1, 0))).to_pylist() for c in range(1, DEPTHS)]
        phrases = [b" ".join(w[:d]) for d, *w in zip(depth.tolist(), *spoken, strict=True)]
        names = pa.array([langs[x] for x in rows[0, at].tolist()], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(depth.astype(np.int32)), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "f"])

    def run(batches):
        give_back_memory()
        bucket, waiting = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                b, langs, words, body = (batch.column(c)[k].as_py() for c in range(4))
                if waiting and b != bucket:
                    yield frequent(waiting)
                    waiting = []
                bucket = b
                waiting.append((body, words, langs))
        if waiting:
            yield frequent(waiting)

    dealt = routed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "lang string, phrase string, words int, f long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", config: Config = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to four words that occur ``least`` times, and ``lang, n`` (all words)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, ceil(size / config.bucket_bytes))
    hot_share = min(config.hot_limit, config.hot_per_bucket * buckets)
    first = _first_pass(texts, config, hot_share)
    words = first.where("words = 1")
    langs = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # What a prefix has in blocks where it is not hot adds up to less than half the share, so every prefix above the share is found.
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = first.where("words > 1").groupBy("words", "h").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * hot_share) >= total)
    hot = hot.select("words", "h").collect()
    listed = {k: np.array([r.h for r in hot if r.words == k], np.int64).view(np.uint64) for k in (2, 3)}
    single = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= config.least)
    single = single.select("lang", "phrase", F.lit(1).alias("words"), "f")
    return cut_lineage(single.unionByName(_counted(_routed(texts, config, listed, buckets), config, buckets))), langs


def _exact(c: str):
    return F.col(c).cast("decimal(20,0)")


def scored(counts: DataFrame, config: Config = CONTRACT) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every candidate, by its lowest-scoring cut."""
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda c: F.array(F.struct(c.alias("cut"), F.lit("l").alias("side"), F.concat_ws(" ", F.slice("_w", 1, c)).alias("part")), F.struct(c.alias("cut"), F.lit("r").alias("side"), F.concat_ws(" ", F.slice("_w", c + 1, 4)).alias("part"))),
    )
    rows = candidates.withColumn("_w", F.split("phrase", " ")).select("lang", "phrase", "words", "a", F.explode(F.flatten(parts)).alias("p")).select("lang", "phrase", "words", "a", "p.*")
    asked = rows.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    dims = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    found = spread_join(rows, cut_lineage(dims), ["lang", "part"], ["phrase", "cut"], n="asked")
    sides = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"{s}{c}") for c in (1, 2, 3) for s in "lr"]
    wide = found.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), *sides)
    cuts = [
        F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(f"{config.scale} * cast(a as decimal(20,0)) div (cast(l{c} as decimal(20,0)) + r{c})").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
        for c in (1, 2, 3)
    ]
    return wide.withColumn("_cut", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull()))).select("lang", "phrase", "words", "a", "_cut.l", "_cut.r", "_cut.score")


def _contained(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the greatest count among the longer candidates that hold a phrase."""
    w = F.split("phrase", " ")
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k))))))
    longer = counts.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f")
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", config: Config = CONTRACT) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, langs = phrase_counts(docs, text_col, lang_col, config)
    rows = scored(counts, config).join(_contained(counts), ["lang", "phrase"], "left")
    kept = rows.where(F.col("longer").isNull() | (100 * _exact("longer") < config.contained_percent * _exact("a")))
    best = first_per_group(kept.drop("longer"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], config.top)
    return best.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
