"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are cut into slices balanced by bytes; texts are cut at places no token can
cross (see ``tokens``), so a long text is never handed over in one piece and pieces that
repeat are encoded once. Null texts count as empty, an empty text has 0 tokens, repeated
rows each give a row, an empty table gives none. Only the named columns are read; other
columns of the input never reach the result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, whole
from .tokens import pieces


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text",
                 key: str = "doc_id", slice_bytes: int = 4 << 20) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``path`` is a tokenizers vocabulary file that every executor can open. Special strings
    inside a text are handled as the library does by default; no special ids are added.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))

    def count(batches):
        encoder = pieces(path, counts=True, direct=False)
        for b in by_bytes(batches, "text", slice_bytes):
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(encoder.encode(texts.to_pylist()), pa.int64()),
                 pc.binary_length(texts).cast(pa.int64())],
                ["key", "n_tokens", "n_bytes"])

    n = asked.mapInArrow(count, f"key {kind}, n_tokens long, n_bytes long")
    return n.select(F.col("key").alias(key), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit"))
