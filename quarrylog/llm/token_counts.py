"""Token counts per document without token ids.

Pieces are counted once per distinct pre-token of a block and worker, joined to
the documents' own pre-tokens by code and summed; ids are never built for a document.

Defined cases: a null text is empty (0 bytes, 0 tokens). Repeated rows give
repeated rows, an empty table an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarrylog.llm.word_pieces import LibraryPieces, blocks, library_tokenizer, pieces_of, tokenizer_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the tokenizer's library counts."""
    text = tokenizer_text(tokenizer_path)
    name = hashlib.sha256(text.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(text)  # one tokenizer file, not data

    def run(batches):
        encode = LibraryPieces(library_tokenizer(name, shared.value), name)
        for batch in batches:
            for part in blocks(batch, 1):
                pieces = pieces_of(part.column(1))
                counts = np.fromiter(map(len, encode(pieces.distinct)), np.int64, len(pieces.distinct)) >> 2
                totals = np.concatenate(([0], np.cumsum(counts[pieces.codes])))
                n = totals[pieces.starts[1:]] - totals[pieces.starts[:-1]]
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
