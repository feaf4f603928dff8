"""Packed id matrices: best-fit-decreasing with a segment tree, rows of ids ready to train on.

Overlong documents are cut losslessly into pieces of at most one row. Pieces, dealt into
bounded random groups, go longest first into the row that they leave the least room in: a
segment tree over the amounts of room holds which amounts occur and finds the smallest one
that is large enough. A result row holds a matrix row of ids, the cumulative lengths of its
segments (first 0, last the number of ids) and positions that start at 0 in each segment.

Null texts are empty documents: with an end id they are that id alone, without one they give
nothing. Repeated rows are packed each; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import GROUP_ROWS, GROUP_TOKENS, cut_documents, dealt
from .shared import ROW


def best_fit(sizes, capacity: int) -> np.ndarray:
    """The bin of each size, taken in the order given."""
    leaves = 1 << capacity.bit_length()
    held = [0] * (2 * leaves)                      # bins below each node, by room left
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def change(room: int, by: int) -> None:
        node = leaves + room
        while node:
            held[node] += by
            node //= 2

    def least(room: int) -> int:
        """The smallest room held that is at least ``room``; -1 if none."""
        node = leaves + room
        if held[node]:
            return room
        while node > 1:
            if node % 2 == 0 and held[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if held[2 * node] else 2 * node + 1
                return node - leaves
            node //= 2
        return -1

    bins, made = np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes):
        room = least(size)
        if room < 0:
            bins[i], room, made = made, capacity, made + 1
        else:
            bins[i] = open_bins[room].pop()
            change(room, -1)
        if room > size:
            open_bins[room - size].append(int(bins[i]))
            change(room - size, 1)
    return bins


def pack_matrix(docs: DataFrame, path: str, length: int = 4096, end_id: int | None = None,
                pad_id: int = 0, narrow: bool = True, text: str = "text", key: str = "doc_id",
                group_tokens: int = GROUP_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(sequence_id, n_tokens, keys, starts, cu_seqlens, ids, positions), one row per sequence.

    ``ids`` is a matrix row of ``length`` little-endian unsigned integers, 16-bit if
    ``narrow`` (for vocabularies up to 65,536), else 32-bit; past ``n_tokens`` it holds
    ``pad_id``. ``positions`` has the same form. ``keys`` and ``starts`` say whose piece each
    segment is and where it begins in its document, so documents can be put together again.
    """
    if narrow and length > 1 << 16:
        raise ValueError("positions need 32 bits at this length")
    kind = docs.schema[key].dataType.simpleString()
    cut = cut_documents(docs, path, length, end_id, True, text, key, narrow=narrow)
    parts = dealt(cut.drop("ids_crc32", "doc_tokens").withColumnRenamed(key, "key"),
                  "matrix-pieces", group_tokens, group_rows)
    unit = "<u2" if narrow else "<u4"

    names = ["sequence_id", "n_tokens", "keys", "starts", "cu_seqlens", "ids", "positions"]

    def fit(group: pa.Table) -> pa.Table:
        size = group.column("length").to_numpy()
        order = np.lexsort((group.column(ROW).to_numpy(), -size))
        bins = best_fit(size[order].tolist(), length)
        by_bin = np.argsort(bins, kind="stable")
        group = group.take(order[by_bin])
        bins, size = bins[by_bin], size[order][by_bin]
        base = group.column("grp")[0].as_py() << 32
        raw, keys, starts = (group.column(c).to_pylist() for c in ("ids", "key", "start"))
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(bins)]
        cols: list[list] = [[] for _ in names]
        for lo, hi in zip(cuts, cuts[1:]):
            ends = [0, *np.cumsum(size[lo:hi]).tolist()]
            ids, positions = np.full(length, pad_id, unit), np.zeros(length, unit)
            ids[:ends[-1]] = np.frombuffer(b"".join(raw[lo:hi]), unit)
            for at, end in zip(ends, ends[1:]):
                positions[at:end] = np.arange(end - at)
            row = (base + int(bins[lo]), ends[-1], keys[lo:hi], starts[lo:hi], ends,
                   ids.tobytes(), positions.tobytes())
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.list_(group.schema.field("key").type),
                 pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return parts.groupBy("grp").applyInArrow(
        fit, f"sequence_id long, n_tokens long, keys array<{kind}>, starts array<long>, "
             "cu_seqlens array<int>, ids binary, positions binary")


def write_matrix(matrix: DataFrame, folder: str) -> None:
    """Writes the rows as parquet under ``folder``: one fixed-width binary row per sequence."""
    matrix.write.parquet(folder)
