"""Token ids as Parquet list columns.

Texts are tokenised with a public byte-level BPE (see pretokens.py) and written
by Spark's Parquet writer, whose commit protocol survives lost executors: format
v2, token ids dictionary-encoded with bit-packed indexes, ids and counts
delta-encoded without a dictionary, row groups of ROW_GROUP bytes, pages of PAGE
bytes and at most PAGE_ROWS rows, with column and offset indexes (which the
writer always adds). A reader of the counts or the source never touches the
tokens, and one of a range of doc_ids reads the pages that the index names.

Defined results. One row per input row, repeated ones too. A null text has null
tokens and a null count, an empty text an empty list and 0. Null doc_ids are
handed on. Texts that name special tokens are ordinary text. Only doc_id, text,
lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .pretokens import encoding

ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: What the Parquet writer is told.
OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd",
}
SCHEMA = "doc_id long, lang string, source string, n_tokens int, token_ids array<int>"


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                cells = [None if t is None else array("i", encode(t)).tobytes() for t in batch.column(3).to_pylist()]
                missing = np.array([x is None for x in cells], bool)
                lengths = np.array([len(x or b"") // 4 for x in cells], np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(lengths.sum()), [None, pa.py_buffer(b"".join(x for x in cells if x))])
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), flat, mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(lengths, mask=missing), tokens], ["doc_id", "lang", "source", "n_tokens", "token_ids"])

    return run


def tokenise(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids) of each row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text")).mapInArrow(_encode(vocabulary), SCHEMA)


def token_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The same, written to the shared folder in the layout above and read from there."""
    return written(tokenise(docs, vocabulary), "tokens", **OPTIONS)
