"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has 64 bits over the hashes of the text's word shingles. Each of its bits is
given a nonzero vector of radius + 1 bits; a table exists for every nonzero vector v, and its
mask keeps the bits whose vector has an odd inner product with v. Any radius bits at which two
fingerprints differ leave some v orthogonal to all of their vectors, so in that table the two
agree: every pair within the radius collides somewhere, with 2^(radius+1) - 1 tables.

Distinct fingerprints only are compared, in blocks of a bucket, and a task gives back a forest
of what it linked; copies of a text meet in their fingerprint and are never paired.

A-Z are lower-cased; words are runs of anything but space and tab to carriage return; a text
of fewer words than a shingle has one shingle of all its words; null, empty and wordless texts
have fingerprint 0, linked like any other. Repeated rows get equal results. Null ids count
only where a component has no other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .links import block_pairs, components, linked_blocks
from .shared import ROW, by_bytes, masked, nothing_kept, unmasked, whole, with_rows

BITS = 64
BLOCK = 4096


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """A bit is 1 if more than half of ``n`` hashes, given in parts, set it."""
    ones = np.zeros(BITS, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if more than half the shingle hashes set it."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat, hash_ = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    step = 1 << 16
    return majority((np.array([hash_(flat[s:e], seed) for s, e in
                               zip(starts[k:k + step], stops[k:k + step])], "<u8")
                     for k in range(0, n, step)), n)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text",
                 carry: tuple[str, ...] = ("doc_id",), slice_bytes: int = 4 << 20) -> DataFrame:
    """``carry`` columns and ``fp``, the fingerprint as a signed long."""
    asked = docs.select(*carry, whole(F.col(text)).alias("__text"))
    kinds = "".join(f"`{n}` {k}, " for n, k in asked.select(*carry).dtypes)

    def make(batches):
        nothing_kept()
        for b in by_bytes(batches, "__text", slice_bytes):
            fp = np.array([fingerprint(t, shingle, seed)
                           for t in b.column("__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carry), pa.array(fp.view(np.int64))], [*carry, "fp"])

    return asked.mapInArrow(make, kinds + "fp long")


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(BITS)]
    out = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def link(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect distinct fingerprints (``fp`` of ``prints``) as all pairs
    within ``radius`` differing bits do."""
    fps = prints.select("fp", F.col("fp").alias(ROW))
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"),
                                          F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                 for i, m in enumerate(masks(radius)))))
    placed = fps.withColumn("x", tables).select("fp", ROW, "x.t", "x.key")

    def near(left: pa.Table, right: pa.Table):
        a = left.column("fp").to_numpy().view(np.uint64)
        b = right.column("fp").to_numpy().view(np.uint64)
        found = []
        for k in range(0, len(a), 512):
            far = np.bitwise_count(a[k:k + 512, None] ^ b[None, :])
            i, j = np.nonzero(far <= radius)
            found.append((i + k, j))
        return tuple(np.concatenate(x) for x in zip(*found))

    pairs = block_pairs(placed, ["t", "key"], block, "simhash-buckets")
    return linked_blocks(pairs, ["t", "key"], ["fp"], near)


def group(made: DataFrame, radius: int = 2, key: str = "doc_id") -> DataFrame:
    """(__row, key, fp, component_id, first_row): every row with the least id it reaches and
    the row that stays for its component (the one of the least id, then of the least __row).

    ``made`` has ``__row``, the key and ``fp``, written down.
    """
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"),
                           F.col(ROW).alias("row")))
    prints = stored(made.groupBy("fp").agg(first.alias("first")), "distinct-prints")
    roots = components(link(prints, radius), "simhash-links").withColumnRenamed("id", "fp")
    owned = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = owned.groupBy("root").agg(F.min("first").alias("all_first"))
    named = stored(owned.join(of_root, "root")
                   .select("fp", F.col("all_first.id").alias("component_id"),
                           F.col("all_first.row").alias("first_row")), "print-components")
    return made.join(named, "fp").select(ROW, key, "fp", "component_id", "first_row")


def report(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint in hexadecimal, component_id) of every row."""
    made = with_rows(fingerprints(docs, shingle, seed, text, (key,)), "fingerprints")
    return group(made, radius, key).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42,
               text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, all columns."""
    named, at = masked(docs)
    rows = with_rows(named, "simhash-documents")
    made = stored(fingerprints(rows, shingle, seed, at[text], (ROW, at[key])), "fingerprints")
    stay = group(made, radius, at[key]).filter(F.col(ROW) == F.col("first_row")).select(ROW)
    return unmasked(rows.join(stay, ROW, "left_semi"), at)
