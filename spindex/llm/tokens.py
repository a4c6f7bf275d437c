"""Token counts of whole texts (whole-token shortcut)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindex.llm import bpe, textvec
from spindex.llm.common import arrow_map, text_bytes

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers``
    library. Counts are the library's, without special tokens added; a special
    string within a text counts as the library counts it by default. One narrow
    map over the scan: no shuffle. A null or empty text has 0 bytes and 0 tokens;
    rows are neither merged nor dropped, null ids and repeated ids included;
    other columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = textvec.binary_column(batch.column(1))
        n = bpe.encoder(tokenizer).count(buf, off)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(text_bytes(docs, id_col, text_col), count, SCHEMA)
