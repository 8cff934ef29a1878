"""Token ids in a bit-plane-shuffled file format.

A store is a folder of two Parquet tables. ``data`` has one row per chunk of
whole documents: ids are cut into blocks of ``BLOCK_IDS``, each block is
transposed into four byte planes and every plane is compressed with zstandard.
``index`` has one row per chunk: where its ids start among all ids, its
documents, its size. Chunks follow ascending document ids: the documents are
range-partitioned by id, a task writes the chunks of one range, and only the
totals per range (one row per task) are summed in order.

Defined cases: a null text is empty and holds only the end id. A null id sorts
first. Rows that repeat an id follow each other, ordered by text. An empty table
gives a store without chunks. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarrylog.llm.word_pieces import LibraryPieces, blocks, expand, give_back_memory, library_tokenizer, pieces_of, tokenizer_text

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 18
PLANES = 4
DATA = "part int, chunk int, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, planes array<binary>"
READ = "doc_id long, start long, ids binary"


def to_planes(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """``PLANES`` compressed byte planes per block of ids, lowest byte first."""
    compress = zstandard.ZstdCompressor(level=level).compress
    out = []
    for at in range(0, len(ids), BLOCK_IDS):
        planes = np.ascontiguousarray(ids[at : at + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
        out += [compress(p.tobytes()) for p in planes]
    return out


def from_planes(planes: list[bytes]) -> np.ndarray:
    """The ids of a chunk's planes."""
    expand_bytes = zstandard.ZstdDecompressor().decompress
    out = [np.zeros(0, "<u4")]
    for at in range(0, len(planes), PLANES):
        rows = np.stack([np.frombuffer(expand_bytes(p), np.uint8) for p in planes[at : at + PLANES]])
        out.append(np.ascontiguousarray(rows.T).reshape(-1).view("<u4"))
    return np.concatenate(out)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with ``end_id`` after each document."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    out[bounds[1:] + np.arange(n)] = end_id
    return out, bounds + np.arange(n + 1)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the store under ``path``."""
    spark = docs.sparkSession
    text = tokenizer_text(tokenizer_path)
    name = hashlib.sha256(text.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(text)  # one tokenizer file, not data

    def run(batches):
        give_back_memory()
        encode = LibraryPieces(library_tokenizer(name, shared.value), name)
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for block in blocks(batch, 1):
                pieces = pieces_of(block.column(1))
                ids, bounds = expand(pieces.codes, pieces.starts, encode(pieces.distinct))
                ids, bounds = with_end(ids, bounds, end_id)
                doc_ids = block.column(0).to_pylist()
                at = 0
                while at < len(doc_ids):
                    to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_IDS, "right")) - 1)
                    own = ids[bounds[at] : bounds[to]]
                    row = [part, chunk, before, len(own), doc_ids[at:to], np.diff(bounds[at : to + 1]).tolist(), to_planes(own)]
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], schema=ARROW)
                    at, chunk, before = to, chunk + 1, before + len(own)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, DATA).write.option("compression", "uncompressed").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    size = F.aggregate("planes", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    facts = data.select("part", "chunk", "before", "n_ids", F.size("doc_ids").alias("n_docs"), F.get("doc_ids", F.lit(0)).alias("first_doc"), size.alias("n_bytes"))
    # One row per written range: far fewer than chunks or documents.
    totals = facts.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("part_start"))
    index = facts.join(starts, "part").withColumn("start", F.col("part_start") + F.col("before"))
    index.select("part", "chunk", "start", "n_ids", "n_docs", "first_doc", "n_bytes").write.parquet(f"{path}/index")


NAMES = ["part", "chunk", "before", "n_ids", "doc_ids", "lengths", "planes"]
ARROW = pa.schema(
    [("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary()))]
)


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a store with the global start of their ids."""
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", "start")
    return spark.read.parquet(f"{path}/data").join(index, ["part", "chunk"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (little-endian unsigned 32-bit) of every document in a store."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"])
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - np.array(row["lengths"], np.int64)
                raw = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"])

    return chunks_of(spark, path).select("doc_ids", "lengths", "planes", "start").mapInArrow(run, READ)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ids stay in the task."""

    def run(batches):
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_py()) for x in batch.column(2)], pa.int64())
            n = pa.array([len(x.as_py()) // 4 for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_store(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
