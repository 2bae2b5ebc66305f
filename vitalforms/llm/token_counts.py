"""Token counts of whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalforms.llm.common import in_blocks
from vitalforms.llm.token_table import tokenizer


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``vocabulary`` is the path of a tokenizer file that every worker can read.
    Needs doc_id and text; other columns are ignored.  A null or empty text
    counts nothing; repeated rows are counted each.
    """
    def work(batch, texts):
        encode = tokenizer(vocabulary).encode
        counts = [len(encode(t.decode())) // 4 for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
             pa.array([n > limit for n in counts], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: in_blocks(batches, work),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
