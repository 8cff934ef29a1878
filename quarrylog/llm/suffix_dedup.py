"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

A string of ``length`` bytes that starts at two places is found without sorting
every suffix. Its grams of ``gram`` bytes are hashed, and the one of least hash is
its anchor: equal strings have equal anchors at equal offsets, so strings are
compared only with those of the same anchor. A run of strings with one anchor is
one row (about one per ``(length - gram) / 2`` bytes of text).

1. Rows are counted by anchor and by digest of the whole run. Runs that occur
   twice are repeated as they are; copies meet as counts, never as rows.
2. Different runs of one anchor are sorted suffix by suffix: mergesort, where a
   comparison finds the common extension of two suffixes by binary search over
   prefix polynomial hashes. Neighbours with a common extension of ``length``
   are compared byte by byte before they count as equal.
3. An anchor with more than ``group_limit`` different runs does not go to one
   task. Its runs are cut into blocks of fewer strings, keyed by the bytes that
   all strings of the block share, and go through 1 and 2 again; blocks of one
   string end in step 1.

Defined cases: a null text is empty. Texts shorter than ``length`` keep all
bytes. Rows that repeat an id and its text are separate documents, so each is a
repeat of the other. Strings may cut UTF-8 characters, so what is left is bytes.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.rolling import Hasher
from quarrylog.llm.word_pieces import give_back_memory, worker_memo
from quarrylog.session import cut_lineage

PIECE = 1 << 19
#: Texts, and runs, that are Python objects at the same time.
SLICE_TEXTS, SLICE_RUNS = 256, 1024
_LOW = np.uint64(0xFFFFFF)
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class Config:
    length: int = 400
    gram: int = 128
    group_limit: int = 2048
    block_widths: tuple[int, ...] = (32, 4, 1)
    batch_windows: int = 150_000
    #: Bytes sorted at once; a sort takes some 50 bytes for each, and runs of few strings hold 400 bytes a string.
    batch_bytes: int = 2 << 20


DEFAULT = Config()


def _hasher() -> Hasher:
    memo = worker_memo("hasher")
    if "one" not in memo:
        memo["one"] = Hasher()
    return memo["one"]


def anchor_runs(data: np.ndarray, length: int, gram: int):
    """``(start, n, anchor, hash)`` arrays: strings ``start .. start + n - 1`` share the anchor gram."""
    hasher, found = _hasher(), []
    width = length - gram + 1
    for a in range(0, len(data) - length + 1, PIECE):
        n = min(PIECE, len(data) - length + 1 - a)
        hashes = hasher.grams(hasher.prefix(data[a : a + n - 1 + length]), gram)
        # The low bits hold the position, so that of equal hashes the rightmost wins.
        keys = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
        table = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
        table[: len(keys)] = keys
        table = table.reshape(-1, width)
        to_right = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        to_left = np.minimum.accumulate(table, 1).ravel()
        least = np.minimum(to_right[:n], to_left[width - 1 : width - 1 + n])
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        found.append((a + start, np.diff(np.append(start, n)), a + anchor[start], hashes[anchor[start]].view(np.int64)))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def _slices(batches, rows: int):
    """The rows of a task as dicts, ``rows`` at a time."""
    give_back_memory("hasher")
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pylist()


def _digest(body: bytes, offset: int, n: int) -> bytes:
    return hashlib.blake2b(body + struct.pack("<II", offset, n), digest_size=16).digest()


RUNS = "k1 long, k2 long, start int, n int, anchor int, h long, f binary"


def runs_of(rows: DataFrame, config: Config) -> DataFrame:
    """One row per run of every text: key, place, anchor hash ``h`` and digest ``f`` of the run's bytes."""

    def run(batches):
        give_back_memory("hasher")
        for batch in batches:
            out = []
            for k1, k2, body in zip(*[batch.column(i) for i in range(3)], strict=True):
                body = body.as_py()
                start, n, anchor, h = anchor_runs(np.frombuffer(body, np.uint8), config.length, config.gram)
                ends = start + n - 1 + config.length
                f = [_digest(body[s:e], x - s, m) for s, e, x, m in zip(start.tolist(), ends.tolist(), anchor.tolist(), n.tolist(), strict=True)]
                keys = [np.full(len(start), k.as_py()) for k in (k1, k2)]
                out.append(pa.RecordBatch.from_arrays([*map(pa.array, keys), *[pa.array(x, pa.int32()) for x in (start, n, anchor)], pa.array(h), pa.array(f, pa.binary())], names=RUN_NAMES))
            yield from out

    return rows.select("k1", "k2", "body").mapInArrow(run, RUNS)


RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def with_counts(runs: DataFrame) -> DataFrame:
    """Runs whose anchor occurs twice, with ``n_rows`` equal runs and ``n_kinds`` different runs of the anchor."""
    kinds = runs.groupBy("h", "f").agg(F.count("*").alias("n_rows"), F.min("k1").alias("first"))
    anchors = kinds.groupBy("h").agg(F.count("*").alias("n_kinds"), F.sum("n_rows").alias("n_all")).where("n_all > 1").drop("n_all")
    return runs.join(kinds.join(anchors, "h"), ["h", "f"]).drop("f")


def _undecided(counted: DataFrame) -> DataFrame:
    """Runs to compare: of equal runs only those of one document, as what others may match."""
    return counted.where((F.col("n_kinds") > 1) & ((F.col("n_rows") == 1) | (F.col("k1") == F.col("first"))))


CONTEXTS = "k1 long, k2 long, start int, n int, offset int, h long, n_kinds long, body binary"


def contexts_of(rows: DataFrame, runs: DataFrame, config: Config) -> DataFrame:
    """The bytes of each run."""
    per_text = runs.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "anchor", "h", "n_kinds")).alias("runs"))  # bounded by the text
    joined = rows.join(per_text.hint("shuffle_hash"), KEY).select(*KEY, "body", "runs")

    def run(batches):
        for texts in _slices(batches, SLICE_TEXTS):
            out: list[list] = [[] for _ in CONTEXT_ARROW]
            for row in texts:
                for r in row["runs"]:
                    cut = row["body"][r["start"] : r["start"] + r["n"] - 1 + config.length]
                    for column, value in zip(out, (row["k1"], row["k2"], r["start"], r["n"], r["anchor"] - r["start"], r["h"], r["n_kinds"], cut), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CONTEXT_ARROW, strict=True)], schema=CONTEXT_ARROW)

    return joined.mapInArrow(run, CONTEXTS)


CONTEXT_ARROW = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("offset", pa.int32()), ("h", pa.int64()), ("n_kinds", pa.int64()), ("body", pa.binary())]
)


class SuffixSort:
    """Suffixes of a buffer, compared up to ``length`` bytes by binary search over prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hasher = data, length, _hasher()
        self.prefix = self.hasher.prefix(data)
        padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
        self.head = np.zeros(len(data), np.uint64)  # the first eight bytes as one number
        for i in range(8):
            self.head = (self.head << np.uint64(8)) | padded[i : i + len(data)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at ``a`` and ``b``, ``length`` at most."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hasher.spans(self.prefix, a, a + mid) == self.hasher.spans(self.prefix, b, b + mid)
            low, high = np.where(same & open_, mid, low), np.where(same | ~open_, high, mid - 1)
        return low

    def precedes(self, a: np.ndarray, b: np.ndarray, if_same: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` stands before suffix ``b``: by their heads, else by the byte after the common extension."""
        before = self.head[a] < self.head[b]
        tie = np.flatnonzero(self.head[a] == self.head[b])
        x, y = a[tie], b[tie]
        same = self.hasher.spans(self.prefix, x, x + self.length) == self.hasher.spans(self.prefix, y, y + self.length)
        before[tie] = if_same[tie]
        tie, x, y = tie[~same], x[~same], y[~same]
        at = np.minimum(self.extension(x, y), self.length - 1)
        before[tie] = self.data[x + at] < self.data[y + at]
        return before

    def sort(self, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes ``at`` within classes (entry ``i``'s class holds ``first[i] : first[i] + size[i]``)."""
        at, width = at.copy(), 1
        rank = np.arange(len(at)) - first
        while (work := np.flatnonzero(size > width)).size:
            r, begin = rank[work], first[work]
            run = r // width
            stop = np.minimum(begin + ((run ^ 1) + 1) * width, begin + size[work])
            low = np.minimum(begin + (run ^ 1) * width, stop)
            low0, later, own = low, (run & 1) == 1, at[work]
            high = stop
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                other, mine = at[mid], own[open_]
                before = self.precedes(other, mine, later[open_])
                low, high = low.copy(), high.copy()
                low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
            merged = begin + (run >> 1) * 2 * width + (r - run * width) + (low - low0)
            at[merged] = own
            width *= 2
        return at

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte by byte, whether the strings at ``a`` and ``b`` are equal."""
        strings = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        return np.concatenate([np.zeros(0, bool), *[(strings[a[i : i + 8192]] == strings[b[i : i + 8192]]).all(1) for i in range(0, len(a), 8192)]])


def repeated_spans(bodies: list[bytes], groups: np.ndarray, offsets: np.ndarray, counts: np.ndarray, length: int):
    """First and last string of each run that another run of its group holds at the same offset (-1: none)."""
    first_of = np.full(len(bodies), np.iinfo(np.int64).max)
    last_of = np.full(len(bodies), -1)
    base = np.cumsum([0, *map(len, bodies)])[:-1]
    owner = np.repeat(np.arange(len(bodies)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    classes = groups[owner] * length + (offsets[owner] - nth)
    order = np.argsort(classes, kind="stable")
    classes = classes[order]
    begins = np.concatenate(([0], np.flatnonzero(np.diff(classes)) + 1)) if len(classes) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(classes)))
    many = np.repeat(sizes > 1, sizes)
    order, sizes = order[many], sizes[sizes > 1]
    if not len(order):
        return np.full(len(bodies), -1), last_of
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    sorter = SuffixSort(np.frombuffer(b"".join(bodies), np.uint8), length)
    at = sorter.sort((base[owner] + nth)[order], first, np.repeat(sizes, sizes))
    beside = np.flatnonzero(first[1:] == first[:-1])
    beside = beside[sorter.extension(at[beside], at[beside + 1]) == length]
    same = sorter.equal(at[beside], at[beside + 1])
    if same.all():
        hit = np.unique(np.concatenate((at[beside], at[beside + 1])))
    else:  # strings that differ and share a hash: decide on the bytes alone
        seen: dict = {}
        text = sorter.data.tobytes()
        for p, c in zip(at.tolist(), first.tolist(), strict=True):
            seen.setdefault((c, text[p : p + length]), []).append(p)
        hit = np.array(sorted(p for found in seen.values() if len(found) > 1 for p in found), np.int64)
    run = np.searchsorted(base, hit, "right") - 1
    np.minimum.at(first_of, run, hit - base[run])
    np.maximum.at(last_of, run, hit - base[run])
    return np.where(last_of < 0, -1, first_of), last_of


SPANS = "k1 long, k2 long, a int, b int"


def sorted_spans(contexts: DataFrame, config: Config) -> DataFrame:
    """Spans that groups of runs share, by suffix sort; a task reads its groups one after another."""

    def spans(rows: list[dict]):
        groups = np.cumsum([0, *[x["h"] != y["h"] for x, y in zip(rows, rows[1:])]])
        counts = np.array([r["n"] for r in rows])
        first, last = repeated_spans([r["body"] for r in rows], groups, np.array([r["offset"] for r in rows]), counts, config.length)
        some = np.flatnonzero(last >= 0).tolist()
        a = [rows[i]["start"] + int(first[i]) for i in some]
        b = [rows[i]["start"] + int(last[i]) + config.length for i in some]
        return pa.RecordBatch.from_arrays([pa.array([rows[i]["k1"] for i in some], pa.int64()), pa.array([rows[i]["k2"] for i in some], pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["k1", "k2", "a", "b"])

    def run(batches):
        waiting: list[dict] = []
        n = size = 0
        for rows in _slices(batches, SLICE_RUNS):
            for row in rows:
                if (n >= config.batch_windows or size >= config.batch_bytes) and row["h"] != waiting[-1]["h"]:
                    yield spans(waiting)
                    waiting, n, size = [], 0, 0
                waiting.append(row)
                n += row["n"]
                size += len(row["body"])
        if waiting:
            yield spans(waiting)

    columns = contexts.select("k1", "k2", "start", "n", "offset", "h", "body")
    return columns.repartition("h").sortWithinPartitions("h").mapInArrow(run, SPANS)


BLOCKS = "k1 long, k2 long, start int, n int, offset int, h long, f binary, body binary"
BLOCK_ARROW = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("offset", pa.int32()), ("h", pa.int64()), ("f", pa.binary()), ("body", pa.binary())]
)


def blocks_of(contexts: DataFrame, width: int, config: Config) -> DataFrame:
    """Runs cut where the offset passes a multiple of ``width``, keyed by the bytes all strings of the block hold."""

    def run(batches):
        for runs in _slices(batches, SLICE_RUNS):
            out = []
            for r in runs:
                at = 0
                while at < r["n"]:
                    offset = r["offset"] - at
                    block = offset // width
                    n = min(r["n"] - at, offset - block * width + 1)
                    body = r["body"][at : at + n - 1 + config.length]
                    core = r["body"][r["offset"] - block * width : r["offset"] - (block + 1) * width + 1 + config.length]
                    key = hashlib.blake2b(core + struct.pack("<qI", r["h"], block), digest_size=8).digest()
                    out.append([r["k1"], r["k2"], r["start"] + at, n, offset, struct.unpack("<q", key)[0], _digest(body, offset, n), body])
                    at += n
            columns = zip(*out, strict=True) if out else [[] for _ in BLOCK_ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

    return contexts.select("k1", "k2", "start", "n", "offset", "h", "body").mapInArrow(run, BLOCKS)


def _whole(counted: DataFrame, config: Config) -> DataFrame:
    found = counted.where("n_rows > 1")
    return found.select(*KEY, F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + config.length).cast("int").alias("b"))


def repeated(rows: DataFrame, config: Config) -> DataFrame:
    """``k1, k2, a, b``: byte spans of texts that are covered by repeated strings (they may overlap)."""
    counted = cut_lineage(with_counts(cut_lineage(runs_of(rows, config))))
    spans = _whole(counted, config)
    contexts = cut_lineage(contexts_of(rows, _undecided(counted), config))
    few = F.col("n_kinds") <= config.group_limit
    spans = spans.unionByName(sorted_spans(contexts.where(few), config))
    large = contexts.where(~few)
    for width in config.block_widths:
        if large.isEmpty():
            break
        counted = cut_lineage(with_counts(cut_lineage(blocks_of(large, width, config))))
        spans = spans.unionByName(_whole(counted, config))
        left = _undecided(counted)
        spans = spans.unionByName(sorted_spans(left.where(few), config))
        large = left.where(~few)
    return spans


OUT = "doc_id long, n_bytes long, spans array<struct<a:int,b:int>>, kept binary"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("kept", pa.binary())])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans: overlapping and touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = DEFAULT) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: removed byte spans and the bytes that are left."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # An id may repeat or be null: rows are told apart by id and text.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("body"))
    found = repeated(rows, config).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # bounded by the text

    def run(batches):
        for batch in batches:
            all_spans, all_kept = [], []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = memoryview(body.as_buffer())
                spans = joined([(s["a"], s["b"]) for s in spans.as_py() or []])
                ends = [0, *[b for _, b in spans]]
                all_kept.append(b"".join(body[e:a] for e, a in zip(ends, [*[a for a, _ in spans], len(body)], strict=True)))
                all_spans.append([{"a": a, "b": b} for a, b in spans])
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(all_spans, OUT_ARROW.field("spans").type), pa.array(all_kept, pa.binary())], schema=OUT_ARROW)

    return rows.join(found.hint("shuffle_hash"), KEY, "left").select("doc_id", "body", "spans").mapInArrow(run, OUT)
