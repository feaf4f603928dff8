"""Packing: first-fit decreasing with a tournament tree of bin capacities, in random groups.

A document's ids are cut into pieces of the sequence length and a rest. Pieces are dealt into
groups at random; in each group they go, longest first, into the first sequence with room,
which a tournament tree over the room left finds in logarithmic time. Groups are bounded in
tokens and rows whatever the input, so no task gathers more than one group at a time, and a
hot source or copied text spreads over all groups. Padding is what the last sequences of a
group leave empty.

Null texts are empty: their document is its end id alone. Repeated rows and repeated or null
ids are packed row by row. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ROW, by_bytes, in_batches, whole, with_rows
from .tokens import pieces

GROUP_TOKENS = 4 << 20
GROUP_ROWS = 100_000


def cut_documents(docs: DataFrame, path: str, length: int, end_id: int | None,
                  keep_ids: bool = False, text: str = "text", key: str = "doc_id",
                  slice_bytes: int = 4 << 20, narrow: bool = False) -> DataFrame:
    """Pieces of documents: (key, start, length, ids_crc32, doc_tokens[, ids]).

    ``ids`` are packed little-endian unsigned 32-bit, 16-bit if ``narrow``; ``ids_crc32`` is
    null then. With no ``end_id`` an empty document
    has no ids and gives no piece.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    width = 2 if narrow else 4
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
    names = ["key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def cut(batches):
        encoder = pieces(path, narrow=narrow)
        for b in by_bytes(batches, "text", slice_bytes):
            rows, cols = [], [[] for _ in names[1:]]
            for i, ids in enumerate(encoder.encode(b.column("text").to_pylist())):
                ids += end
                for at in range(0, len(ids), width * length):
                    piece = ids[at:at + width * length]
                    rows.append(i)
                    for c, v in zip(cols, (at // width, len(piece) // width,
                                           None if narrow else zlib.crc32(piece),
                                           len(ids) // width, piece)):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(rows, pa.int64())),
                 *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    got = in_batches(asked, cut, f"key {kind}, start long, length long, ids_crc32 long, "
                                 "doc_tokens long" + ", ids binary" * keep_ids)
    return got.withColumnRenamed("key", key)


def first_fit(sizes, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, taken in the order given.

    The tree's leaves hold the room left in each bin and each node the larger room below it;
    going left wherever the size fits finds the first bin with room.
    """
    n = len(sizes)
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def dealt(parts: DataFrame, name: str, group_tokens: int = GROUP_TOKENS,
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """``parts`` written down, each with a random ``grp``; groups are bounded in both sizes."""
    parts = with_rows(parts, name)
    rows, tokens = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // group_tokens), -(-rows // group_rows))
    return parts.withColumn("grp", F.pmod(F.xxhash64(F.col(ROW)), F.lit(groups)))


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int | None = None,
         keep_ids: bool = False, text: str = "text", key: str = "doc_id",
         group_tokens: int = GROUP_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there."""
    cut = cut_documents(docs, path, length, end_id, keep_ids, text, key)
    parts = dealt(cut, "pieces", group_tokens, group_rows)
    names = cut.columns

    def fit(group: pa.Table) -> pa.Table:
        size = group.column("length").to_numpy()
        order = np.lexsort((group.column(ROW).to_numpy(), -size))
        bins, offsets = first_fit(size[order].tolist(), length)
        base = group.column("grp")[0].as_py() << 32
        return (group.select(names).take(order)
                .append_column("sequence_id", pa.array(base + bins))
                .append_column("offset", pa.array(offsets)))

    kinds = ", ".join(f"`{c}` {k}" for c, k in cut.dtypes)
    return parts.groupBy("grp").applyInArrow(fit, f"{kinds}, sequence_id long, offset long")
