"""Sums of vectors over documents and over terms, from packed term counts in blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from quarrylog.operators import term_blocks as blocks
from quarrylog.session import lean

BLOCK = 12_000_000  # counts of a block; a block sends and gets one vector for each of its terms
ROW = 1_000_000  # counts of a row of a block, or one document
STRIPE = 10  # elements of the vectors that are sent at a time
NEXT, LAST = 1 << 16, 2**31 - 1


def sum_of(cells: DataFrame) -> np.ndarray:
    """Sum of square matrices, a few hundred numbers each."""
    with lean(cells.sparkSession):
        sums = cells.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
    size = int(round(len(sums) ** 0.5))
    return sums["x"].to_numpy().reshape(size, size)


def whole(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """For every chunk its documents' keys, vectors and what came of them in a step, put together from their stripes."""
    for _, rows in blocks.grouped(batches, "chunk"):
        rows = list(rows)
        size = len(rows[0]["keys"])
        first, then = ([np.frombuffer(row["v"]).reshape(size, -1) for row in rows if (row["part"] >= NEXT) == later] for later in (False, True))
        yield rows[0]["keys"], np.hstack(first), np.hstack(then) if then else None


def gram(basis: DataFrame, size: int, number: int) -> np.ndarray:
    """Sum of outer products of the vectors."""

    def run(batches):
        total = np.zeros((size, size))
        for _, own, _ in whole(batches):
            total += own.T @ own
        yield {"g": total.ravel().tolist()}

    return sum_of(blocks.packed(in_blocks(basis, None, number), run, "g array<double>"))


def gram_of_terms(basis: DataFrame, after: DataFrame, turn: np.ndarray, number: int) -> np.ndarray:
    """Sum of outer products of the terms' sums: the turned vectors times what came of them, over documents with a key."""
    size = turn.shape[1]

    def run(batches):
        total = np.zeros((size, size))
        for keys, own, then in whole(batches):
            known = np.array([k is not None for k in keys])
            total += (own @ turn)[known].T @ then[known]
        yield {"g": ((total + total.T) / 2).ravel().tolist()}

    both = basis.unionByName(after.withColumn("part", F.col("part") + NEXT))
    return sum_of(blocks.packed(in_blocks(both, None, number), run, "g array<double>"))


def orthonormal(outer: np.ndarray) -> np.ndarray:
    """What turns vectors of this Gram matrix into orthonormal columns of the same space; weightless directions are left out."""
    values, directions = np.linalg.eigh(outer)
    used = values > values.max() * 1e-12
    return directions[:, used] / np.sqrt(values[used])


def blocks_of_counts(dealt: DataFrame, key: T.DataType, min_df: int, max_share: float) -> DataFrame:
    """The kept counts by block: a head with the block's terms (``part << 32 | rank``), and in the order of their frequency idf and hashes; and the counts, with the lengths of the documents."""
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("keys", T.ArrayType(key))]
        + [T.StructField(name, T.BinaryType()) for name in ("terms", "place", "df", "hashes", "sizes", "length", "term", "tf")]
    )

    def run(batches):
        for block, rows in blocks.grouped(batches, "block"):
            totals, own, terms = {}, {}, None
            for row in rows:
                chunk = row["chunk"]
                if row["total"] is not None:
                    totals.setdefault(chunk, []).append(blocks.unpack(row["total"]))
                    own.setdefault(chunk, []).append(blocks.unpack(row["rank"]).astype(np.int64) + (row["part"] << 32))
                    continue
                n_docs = row["n_docs"][0]
                if terms is None:  # all answers have come
                    totals, own = ({c: np.concatenate(x) for c, x in each.items()} for each in (totals, own))
                    terms = np.unique(np.concatenate(list(own.values())))
                    df = np.zeros(len(terms), np.int64)
                    for c, total in totals.items():
                        df[np.searchsorted(terms, own[c])] = total[(total >= min_df) & (total <= max_share * n_docs)]
                    order = np.argsort(-df, kind="stable")
                    idf, hashes, place = np.log((1 + n_docs) / (1 + df[order])) + 1, np.zeros(len(terms), np.int64), np.empty(len(terms), np.int32)
                    place[order] = np.arange(len(terms))
                total = totals.pop(chunk)
                kept = (total >= min_df) & (total <= max_share * n_docs)
                to = np.zeros(len(total), np.int32)
                to[kept] = at = place[np.searchsorted(terms, own.pop(chunk))]
                hashes[at] = blocks.unpack(row["hashes"])[kept]
                doc, term, tf = blocks.counts_of(row)
                size = np.bincount(doc, minlength=len(row["keys"]))
                ends = np.append(0, np.cumsum(size))
                for number, (low, high) in enumerate(blocks.runs(size, ROW)):
                    some = slice(ends[low], ends[high])
                    used = kept[term[some]]
                    own_doc, own_term, own_tf = doc[some][used] - low, to[term[some][used]], tf[some][used]
                    sizes = np.bincount(own_doc, minlength=high - low)
                    length = np.sqrt(np.bincount(own_doc, (own_tf * idf[own_term]) ** 2, minlength=high - low))
                    same = {"block": block, "chunk": (chunk << 16) + number, "part": LAST, "keys": row["keys"][low:high]}
                    yield same | {"sizes": blocks.pack(sizes), "length": blocks.pack(length), "term": blocks.pack(own_term), "tf": blocks.pack(own_tf)}
            # The terms rise by little.
            head = {"terms": np.diff(terms, prepend=0), "place": place, "df": df[order], "hashes": hashes}
            yield {"block": block, "chunk": -1, "part": -1} | {name: blocks.pack(x) for name, x in head.items()}

    return blocks.packed(dealt, run, schema)


def in_blocks(counts: DataFrame, more: DataFrame | None, number: int) -> DataFrame:
    """Of each block the head, what came from the terms' owners, and by chunk its vectors and its counts."""
    union = counts if more is None else counts.unionByName(more, allowMissingColumns=True)
    return union.repartitionById(number, F.col("block")).sortWithinPartitions("block", "chunk", "part")


def head_of(row: dict, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's terms, their places in the order of frequency, and by place their idf."""
    idf = np.log((1 + n_docs) / (1 + blocks.unpack(row["df"]).astype(np.int64))) + 1
    return np.cumsum(blocks.unpack(row["terms"]), dtype=np.int64), blocks.unpack(row["place"]), idf


def entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of counts the number of terms of each document and its length, and the terms and counts."""
    return blocks.unpack(row["sizes"]).astype(np.int64), blocks.unpack(row["length"]), blocks.unpack(row["term"]).astype(np.int64), blocks.unpack(row["tf"]).astype(np.float64)


def sums_by_document(dealt: DataFrame, n_docs: int, key: T.DataType, stripe: int, low: int, high: int) -> DataFrame:
    """Per row of counts its documents' weighted sums of their terms' vectors, from ``low`` to ``high`` of their elements: those from the owners, at the start signs from the terms' hashes."""
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("keys", T.ArrayType(key)), T.StructField("v", T.BinaryType())]
    )
    start = "v" not in dealt.columns

    def run(batches):
        for block, rows in blocks.grouped(batches, "block"):
            for row in rows:
                if row["terms"] is not None:
                    (_, place, idf), end = head_of(row, n_docs), 0
                    vectors = np.empty((high - low, len(idf)))
                    if start:
                        hashes = blocks.unpack(row["hashes"]).astype(np.int64)
                        for j in range(low, high):
                            vectors[j - low] = ((hashes >> j & 1) * 2 - 1) * idf
                elif row["part"] < LAST:
                    own = np.frombuffer(row["v"]).reshape(-1, high - low)
                    to = place[end : (end := end + len(own))]
                    for j in range(high - low):
                        vectors[j][to] = own[:, j] * idf[to]
                else:
                    sizes, length, term, tf = entries(row)
                    sums, some = np.zeros((len(sizes), high - low)), sizes > 0
                    if some.any():
                        first = (np.cumsum(sizes) - sizes)[some]
                        for j in range(high - low):
                            sums[some, j] = np.add.reduceat(tf * vectors[j][term], first) / length[some]
                    yield {"block": block, "chunk": row["chunk"], "part": stripe, "keys": row["keys"], "v": sums.tobytes()}

    return blocks.packed(dealt, run, schema)


def sums_by_term(dealt: DataFrame, n_docs: int, turn: np.ndarray) -> DataFrame:
    """Per block and part the terms' weighted sums of their documents' vectors, these multiplied by ``turn`` first. A document without a key has no vector."""
    size = turn.shape[1]

    def run(batches):
        for block, rows in blocks.grouped(batches, "block"):
            stripes = []
            for row in rows:
                if row["terms"] is not None:
                    terms, place, idf = head_of(row, n_docs)
                    sums = np.zeros((size, len(terms)))
                elif row["part"] < LAST:
                    stripes.append(np.frombuffer(row["v"]))
                else:
                    sizes, length, term, tf = entries(row)
                    own, stripes = np.hstack([x.reshape(len(sizes), -1) for x in stripes]) @ turn, []
                    known = (sizes > 0) & np.array([k is not None for k in row["keys"]])
                    own[known] /= length[known, None]
                    own[~known] = 0
                    for j in range(size):
                        sums[j] += np.bincount(term, tf * np.repeat(own[:, j], sizes), minlength=len(terms))
            parts, starts = np.unique(terms >> 32, return_index=True)
            for part, low, high in zip(parts.tolist(), starts, np.append(starts[1:], len(terms)), strict=True):
                at = place[low:high]
                yield {"part": part, "block": block, "rank": (terms[low:high] & 0xFFFFFFFF).astype(np.int32).tobytes(), "v": (sums[:, at] * idf[at]).T.tobytes()}

    return blocks.packed(dealt, run, "part int, block int, rank binary, v binary")


def summed(batches, size: int):
    """For every part the sums over all blocks, and the ranks that each block has."""
    for part, rows in blocks.grouped(batches, "part"):
        ranks, sums = [], np.zeros((0, size))
        for row in rows:
            rank = np.frombuffer(row["rank"], np.int32)
            ranks.append((row["block"], rank))
            if rank[-1] >= len(sums):
                sums = np.vstack([sums, np.zeros((rank[-1] + 1 - len(sums), size))])
            sums[rank] += np.frombuffer(row["v"]).reshape(-1, size)
        yield part, ranks, sums


def back_to_blocks(by_term: DataFrame, size: int) -> DataFrame:
    """The whole sums of the terms of each block."""

    def run(batches):
        for part, ranks, sums in summed(batches, size):
            for block, rank in ranks:
                yield {"block": block, "chunk": -1, "part": part, "v": sums[rank].tobytes()}

    return blocks.packed(by_term, run, "block int, chunk long, part int, v binary")
