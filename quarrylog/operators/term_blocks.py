"""Term counts of documents in packed chunks: a term costs a task some bytes to send, not a row.

A chunk is a run of whole documents: one row with its counts, and for every
part (a share of all terms, by a hash of the term) one row with the terms it
has there. What the owner of a part answers goes back chunk by chunk in the
order of those terms, so terms travel once and as text only to their owner.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylog.session import cut_lineage

TOKENS = 3_000_000  # of a chunk, or one document
SLICE = 500_000  # tokens encoded at once, or one text
PART_DOCS = 2_000  # documents for each part of the terms
ROWS, BATCH = 10_000, 8_000_000  # rows and bytes of a batch
PRIME = 2**31 - 19
LEVEL = 6  # of zstandard


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    if numbers.dtype.kind in "iu":
        low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
        numbers = numbers.astype(np.min_scalar_type(high if low >= 0 else min(low, -high - 1)))
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return numbers.dtype.str.encode().ljust(4) + numbers.size.to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    kind, size = np.dtype(data[:4].decode().strip()), int.from_bytes(data[4:12], "little")
    planes = np.frombuffer(pa.decompress(data[12:], size * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_texts(texts: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of ``large_string`` texts and their lengths."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return pack(np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]), pack(np.diff(offsets))


def unpack_texts(data: bytes, lengths: bytes) -> pa.Array:
    sizes = unpack(lengths).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(unpack(data)))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size > BATCH or len(held) >= ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workers wait for other tasks; what they have freed goes back to the system first."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def packed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function that gives rows."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    return rows.mapInArrow(lambda batches: released(batched(run(batches), arrow)), kind)


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows that follow each other with one value of ``by``; they are read one at a time."""
    return groupby(rows_of(batches), key=lambda row: row[by])


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least one that hold no more than ``most`` together."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


class Chunk:
    """Documents in the order of cluster and key; equal keys that follow each other are one document."""

    def __init__(self, n: int):
        self.n, self.words, self.tokens = n, {}, 0
        self.codes, self.rows, self.hashes = [], [], []
        self.docs, self.clusters, self.doc_cluster, self.doc_of_row = [], [], [], []

    def add(self, names: list[tuple], lists: pa.Array, hashes: pa.Array | None) -> None:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        at = pc.fill_null(flat.indices, -1).to_numpy(zero_copy_only=False)
        before = len(self.words)
        lookup = np.array([-1 if w is None else self.words.setdefault(w, len(self.words)) for w in flat.dictionary.to_pylist()], np.int32)
        if hashes is not None:
            values = np.zeros(len(lookup) + 1, np.int64)
            values[at] = hashes.flatten().to_numpy(zero_copy_only=False)
            self.hashes.append(values[:-1][lookup >= before])
        self.codes.append(np.append(lookup, np.int32(-1))[at])
        self.rows.append(np.repeat(np.arange(len(self.doc_of_row), len(self.doc_of_row) + len(names), dtype=np.int32), sizes))
        self.tokens += len(at)
        for cluster, key in names:
            if not self.clusters or cluster != self.clusters[-1]:
                self.clusters.append(cluster)
                self.docs.append(key)
                self.doc_cluster.append(len(self.clusters) - 1)
            elif key != self.docs[-1]:
                self.docs.append(key)
                self.doc_cluster.append(len(self.clusters) - 1)
            self.doc_of_row.append(len(self.docs) - 1)

    def ends_with(self, name: tuple) -> bool:
        return bool(self.docs) and name == (self.clusters[-1], self.docs[-1])

    def _grams(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """The number of the n-gram that begins at each token (-1: none) and its row; of each n-gram text, number for ``part`` and word hash."""
        words = pa.array(list(self.words), pa.large_string())
        order = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(words) + 1, np.int32)
        rank[order], rank[-1] = np.arange(len(words)), -1
        codes, rows = rank[np.concatenate(self.codes)], np.concatenate(self.rows)
        self.codes, self.rows, self.words = [], [], {}
        texts = words = words.take(pa.array(order))
        hashes = np.concatenate(self.hashes)[order] if self.hashes else np.zeros(0, np.int64)
        # Of the text as a number in base 256, so that of a longer text follows from its pieces.
        plain = [w.encode() for w in words.to_pylist()]
        rest = of_word = np.array([int.from_bytes(w, "big") % PRIME for w in plain], np.int64)
        power = np.array([pow(256, len(w), PRIME) for w in plain], np.int64)
        grams = codes
        for k in range(1, self.n):
            head, tail = grams[: max(len(codes) - k, 0)], codes[k:]
            joined = (rows[: len(tail)] == rows[k:]) & (head >= 0) & (tail >= 0)
            pairs, grams = np.unique(np.where(joined, head * np.int64(len(words)) + tail, -1), return_inverse=True)
            none = int(pairs.size > 0 and pairs[0] < 0)
            pairs, grams = pairs[none:], (grams - none).astype(np.int32)
            first, last = np.divmod(pairs, max(len(words), 1))
            rest = ((rest[first] * 256 + 32) % PRIME * power[last] + of_word[last]) % PRIME
            texts = pc.binary_join_element_wise(texts.take(pa.array(first)), words.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
        if self.n > 1 and pc.any(pc.match_substring(words, " ")).as_py():
            # Different words may give one text then.
            once = texts.dictionary_encode()
            same = np.append(once.indices.to_numpy(), -1)
            kept = np.empty(len(once.dictionary), np.int64)
            kept[same[:-1]] = rest
            grams, texts, rest = same[grams], once.dictionary, kept
        return grams, rows[: len(grams)], texts, rest, hashes

    def close(self, parts: int = 1) -> bool:
        """Sets ``texts``, ``term_cluster``, ``part``, ``df`` and ``hashes`` of the terms, by part, and ``doc``, ``term``, ``tf`` of the counts; whether there are any."""
        if not self.words:
            return False
        grams, rows, texts, rest, hashes = self._grams()
        doc = np.array(self.doc_of_row, np.int32)[rows[grams >= 0]]
        grams = grams[grams >= 0]
        if not grams.size:
            return False
        if len(self.clusters) > 1:
            terms, grams = np.unique(np.array(self.doc_cluster)[doc] * len(texts) + grams, return_inverse=True)
            self.term_cluster, gram = np.divmod(terms, len(texts))
        else:
            self.term_cluster, gram = np.zeros(len(texts), np.int64), np.arange(len(texts))
        part = ((rest[gram].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counts, self.tf = np.unique(doc * np.int64(len(order)) + place[grams], return_counts=True)
        del doc, grams, rows
        self.doc, self.term = np.divmod(counts, len(order))
        self.df = np.bincount(self.term, minlength=len(order))
        self.part, self.term_cluster, gram = part[order].astype(np.int64), self.term_cluster[order], gram[order]
        self.texts = texts.take(pa.array(gram))
        self.hashes = hashes[gram] if len(hashes) else None
        return True


def chunks(batches: Iterator[pa.RecordBatch], n: int, parts: int = 1) -> Iterator[Chunk]:
    """Of batches of cluster, key, words and, if any, hashes of the words; ordered by cluster and key."""
    chunk = Chunk(n)
    for batch in batches:
        clusters, keys, lists, *hashes = batch.columns
        names = list(zip(clusters.to_pylist(), keys.to_pylist(), strict=True))
        for start, stop in runs(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), SLICE):
            if chunk.tokens >= TOKENS and not chunk.ends_with(names[start]):
                if chunk.close(parts):
                    yield chunk
                chunk = Chunk(n)
            chunk.add(names[start:stop], lists.slice(start, stop - start), hashes[0].slice(start, stop - start) if hashes else None)
    if chunk.close(parts):
        yield chunk


def dealt(docs: DataFrame, key: str, cluster: str, tokens: Column, *more: Column) -> DataFrame:
    """Cluster, key and words, with the documents dealt out by ``key``: whole texts are shuffled once."""
    ordered = docs.repartition(key).sortWithinPartitions(cluster, key)
    return ordered.select(cluster, key, tokens.alias("_words")).select("*", *more)


def counted(docs: DataFrame, key: str, cluster: str, tokens: Column, n: int, hashed: bool = False) -> tuple[DataFrame, int]:
    """The rows of all chunks, to be stored, and the number of parts; ``hashed``: with xxhash64 of single words."""
    docs = docs.where(F.col(cluster).isNotNull())
    parts = -(-max(docs.count(), 1) // PART_DOCS)
    of_key, of_cluster = docs.schema[key].dataType, docs.schema[cluster].dataType
    blobs = ["text", "lengths", "cluster_no", "df", "doc_cluster", "sizes", "term", "tf", "hashes"]
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("entries", T.LongType())]
        + [T.StructField("keys", T.ArrayType(of_key)), T.StructField("clusters", T.ArrayType(of_cluster))]
        + [T.StructField(name, T.BinaryType()) for name in blobs]
    )

    def run(batches):
        for number, chunk in enumerate(chunks(batches, n, parts)):
            same = {"chunk": (TaskContext.get().partitionId() << 24) + number}
            # Rises within a document.
            first = np.append(True, chunk.doc[1:] != chunk.doc[:-1])
            step = np.where(first, chunk.term, np.diff(chunk.term, prepend=0))
            row = same | {"part": -1, "entries": len(chunk.term), "keys": chunk.docs, "clusters": chunk.clusters}
            row |= {"doc_cluster": pack(np.array(chunk.doc_cluster)), "sizes": pack(np.bincount(chunk.doc, minlength=len(chunk.docs))), "term": pack(step), "tf": pack(chunk.tf)}
            row |= {"hashes": None if chunk.hashes is None else pack(chunk.hashes)}
            yield row
            bounds = np.searchsorted(chunk.part, np.arange(parts + 1))
            for part, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if low < high:
                    text, lengths = pack_texts(chunk.texts.slice(low, high - low))
                    used, no = np.unique(chunk.term_cluster[low:high], return_inverse=True)
                    row = same | {"part": part, "entries": int(high - low), "clusters": [chunk.clusters[c] for c in used]}
                    row |= {"text": text, "lengths": lengths, "cluster_no": pack(no), "df": pack(chunk.df[low:high])}
                    yield row

    more = [F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes")] if hashed else []
    return packed(dealt(docs, key, cluster, tokens, *more), run, schema), parts


def to_owners(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """All rows of a part in one task, in order."""
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *order)


def known_terms(rows: list[dict]) -> tuple[np.ndarray, pa.Array, np.ndarray, list]:
    """Of the rows of one part: for every entry the number of its term in its cluster, and of each number text, cluster's number and the clusters."""
    known, clusters, numbers = {}, [], []
    for row in rows:
        for value in row["clusters"]:
            if repr(value) not in known:
                known[repr(value)] = len(known)
                clusters.append(value)
        numbers.append(np.array([known[repr(value)] for value in row["clusters"]])[unpack(row["cluster_no"])])
    texts = pa.concat_arrays([unpack_texts(row["text"], row["lengths"]) for row in rows]).dictionary_encode()
    size = len(texts.dictionary)
    terms, entries = np.unique(np.concatenate(numbers) * size + texts.indices.to_numpy(), return_inverse=True)
    return entries, texts.dictionary.take(pa.array(terms % size)), terms // size, clusters


ANSWER = "chunk long, part int, total binary, rank binary"


def answered(table: DataFrame, parts: int, kept: tuple[int, float] | None = None) -> DataFrame:
    """For every chunk and part the documents that have each term (``total``); ``kept``: and the ranks of terms in so many documents, from least to most."""

    def run(batches):
        for part, rows in grouped(batches, "part"):
            rows = list(rows)
            entries, texts, *_ = known_terms(rows)
            totals = np.bincount(entries, weights=np.concatenate([unpack(row["df"]) for row in rows])).astype(np.int64)
            if kept:
                used = (totals >= kept[0]) & (totals <= kept[1])
                order = pc.sort_indices(texts).to_numpy()
                ranks = np.empty(len(order), np.int64)
                ranks[order] = np.cumsum(used[order]) - 1
            end = 0
            for row in rows:
                own = entries[end : (end := end + row["entries"])]
                rank = pack(ranks[own[used[own]]]) if kept else None
                yield {"chunk": row["chunk"], "part": part, "total": pack(totals[own]), "rank": rank}

    asked = table.where("part >= 0").select("chunk", "part", "entries", "clusters", "text", "lengths", "cluster_no", "df")
    return packed(to_owners(asked, parts, "chunk"), run, ANSWER)


def placed(table: DataFrame, entries: int | None = None) -> tuple[DataFrame, int]:
    """Chunks by block, each block begun within ``entries`` counts or else one chunk, and the number of blocks; there is a row for each chunk."""
    order = Window.orderBy("chunk")
    block = F.row_number().over(order) - 1 if entries is None else F.floor((F.sum("entries").over(order) - F.col("entries")) / entries)
    places = cut_lineage(table.where("part = -1").select("chunk", block.cast("int").alias("block")))
    return F.broadcast(places), (places.agg(F.max("block")).first()[0] or 0) + 1


def with_sizes(table: DataFrame, sizes: DataFrame, cluster: str) -> DataFrame:
    """The count rows with ``n_docs``: the documents of each of their clusters."""
    rows = table.where("part = -1")
    listed = rows.select("chunk", F.posexplode("clusters").alias("no", cluster)).join(sizes, cluster)
    n_docs = listed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("no", "docs"))).alias("_n"))
    return rows.join(n_docs.select("chunk", F.col("_n.docs").alias("n_docs")), "chunk")


def to_blocks(rows: DataFrame, answers: DataFrame, places: DataFrame, blocks: int) -> DataFrame:
    """Count rows and answers of the chunks of a block in one task, the answers of all its chunks before the counts."""
    union = rows.withColumn("part", F.lit(2**31 - 1)).unionByName(answers, allowMissingColumns=True).join(places, "chunk")
    return union.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "part", "chunk")


def counts_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every entry of a chunk."""
    sizes, step = unpack(row["sizes"]).astype(np.int64), unpack(row["term"])
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    term = np.cumsum(step, dtype=np.int64)
    term -= np.repeat(term[first] - step[first].astype(np.int64), sizes[sizes > 0])
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), term.astype(np.int32), unpack(row["tf"])


def weights_of(row: dict, total: np.ndarray, min_df: int, max_share: float) -> tuple[np.ndarray, ...]:
    """Document, term and weight of every kept entry of a chunk, and its terms' clusters."""
    doc, term, tf = counts_of(row)
    cluster = np.zeros(len(total), np.int64)
    cluster[term] = unpack(row["doc_cluster"])[doc]
    docs = np.array(row["n_docs"], np.float64)[cluster]
    idf = np.log((1 + docs) / (1 + total)) + 1
    kept = ((total >= min_df) & (total <= max_share * docs))[term]
    doc, term = doc[kept], term[kept]
    w = tf[kept] * idf[term]
    length = np.sqrt(np.bincount(doc, w * w, minlength=len(row["keys"])))
    return doc, term, w / length[doc], cluster


def leading(values: np.ndarray, groups: np.ndarray, top: int) -> np.ndarray:
    """Which values are among the ``top`` of their group, or as large as the last of these to within rounding."""
    order = np.lexsort((-values, groups))
    start = np.searchsorted(groups[order], groups, "left")
    end = np.searchsorted(groups[order], groups, "right")
    return (end - start <= top) | (values >= values[order][np.minimum(start + top, end) - 1] - 1e-8)
