"""Line dedup: lines spread over many distinct sites are boilerplate and go.

The sites of a line (known by two hashes of the trimmed line) are gathered in HyperLogLog
sketches that merge by aggregation. A line whose estimate is within ``band`` of the threshold
gets an exact distinct count; the others are decided by their estimates. Most lines have one
site only; the least and the largest site tell them apart before any sketch is made.

Every site that holds a line counts, also those of copies of a whole text. One occurrence of
every line stays in the corpus, in the text whose least key is least: a text that alone holds a
line keeps it in all of its copies, and lines of a large group of near copies are never lost
altogether.

Null texts stay null and have no lines; lines blank after trimming are kept and not counted; a
null site is a site of its own. Repeated rows are one text. An empty table gives no rows. All
columns pass through, whatever their names; a figure whose name is taken gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import free, masked, once, record, unmasked

LINE, TEXT = ["h1", "h2"], ["t1", "t2"]


def _hashes(value, names):
    return [F.xxhash64(value, F.lit(i)).alias(n) for i, n in enumerate(names)]


def occurrences(docs: DataFrame, text: str = "text", site: str = "source",
                key: str = "doc_id") -> DataFrame:
    """(h1, h2, t1, t2, pos, site, key): the lines of distinct texts at each of their sites,
    with the least key of the rows that hold the text there; written down."""
    line = F.btrim(F.col("line"))
    lines = (docs.select(*_hashes(F.col(text), TEXT),
                         F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")),
                                    F.lit("")).alias("site"), F.col(key).alias("key"),
                         F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
             .filter(line != "").select(*_hashes(line, LINE), *TEXT, "pos", "site", "key"))
    return stored(lines.groupBy(*LINE, *TEXT, "pos", "site").agg(F.min("key").alias("key")),
                  "line-places")


def spread_lines(places: DataFrame, min_sites: int, band: float = 0.15,
                 lg_k: int = 12) -> DataFrame:
    """(h1, h2): the lines of ``places`` on ``min_sites`` distinct sites or more."""
    several = stored(places.groupBy(*LINE)
                     .agg(F.min("site").alias("low"), F.max("site").alias("high"))
                     .filter("low < high").select(*LINE), "line-several")
    # Written first: each task then sketches the lines of its rows, whichever they are, and only
    # sketches meet, so that a line found everywhere is the work of many tasks.
    places = stored(places.join(several, LINE, "left_semi"), "line-several-places")
    estimated = stored(places.groupBy(*LINE)
                       .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")),
                       "line-estimates")
    near = F.abs(F.col("sites") - min_sites) <= band * min_sites
    clear = estimated.filter(~near & (F.col("sites") >= min_sites)).select(*LINE)
    exact = (places.join(estimated.filter(near).select(*LINE), LINE, "left_semi")
             .groupBy(*LINE, "site").agg(F.lit(1).alias("x"))
             .groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= min_sites).select(*LINE))
    return clear.union(exact)


def removed_lines(places: DataFrame, lines: DataFrame) -> DataFrame:
    """(t1, t2, gone): of each text, the sorted places of the lines to remove."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", *TEXT, "pos")
    hit = stored(places.join(lines, LINE, "left_semi").groupBy(*LINE, *TEXT, "pos")
                 .agg(F.min("key").alias("key")).withColumn("at", order), "line-hits")
    first = stored(hit.groupBy(*LINE).agg(F.min("at").alias("first")), "line-firsts")
    return stored(hit.join(first, LINE).filter("at != first").groupBy(*TEXT)
                  .agg(F.sort_array(F.collect_list("pos")).alias("gone")), "line-removals")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, text: str = "text",
                       site: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, all columns and rows kept, and
    at the end ``n_lines`` (0 for a null text) and ``n_removed``; with underscores after the
    name where ``docs`` has such a column."""
    named, at = masked(docs)
    t = at[text]
    places = occurrences(named, t, at[site], at[key])
    gone = removed_lines(places, spread_lines(places, min_sites))
    lines = F.split(F.col(t), "\n", -1)

    def without(x):
        # What stays are the runs between removed places.
        ends = F.zip_with(F.concat(F.array(F.lit(-1)), x["gone"]),
                          F.concat(x["gone"], F.array(F.size(x["lines"]))),
                          lambda a, b: record(a=a, b=b))
        runs = F.transform(ends, lambda e: F.slice(x["lines"], e["a"] + 2, e["b"] - e["a"] - 1))
        return F.array_join(F.flatten(runs), "\n")

    both = record(lines=lines, gone=F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(t)).otherwise(once(both, without))
    joined = (named.withColumns(dict(zip(TEXT, _hashes(F.col(t), TEXT))))
              .join(gone, TEXT, "left")
              .withColumn("n_lines", F.when(F.col(t).isNull(), 0).otherwise(F.size(lines))))
    clean = joined.select(*named.columns, kept.alias("kept"), "n_lines",
                          F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    names = {free(n, at): n for n in ("n_lines", "n_removed")}
    return unmasked(clean.withColumn(t, F.col("kept")), at | names)
