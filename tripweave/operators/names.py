"""Names found by a part of their text: an inverted index of trigrams.

Every name is listed under its distinct pieces of three characters; a list holds row numbers
only, and each piece its number of names. A text is looked up by its rarest piece, so a piece
that every name has costs nothing unless the text has no other. Long lists are dealt over parts
of about ``LIST`` rows with keys of their own. What a list gives is tested in full, and only then
are wider rows fetched.

Names end in two fill characters, so that each character starts a piece: texts of one or two
characters take all pieces that start with them. Texts of wildcards alone go through all names,
block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

LIST = 4096
FILL = "\0\0"
#: Characters that mean something else in a pattern; pieces don't reach over them.
SPECIAL = r"[%_\\]+"


def _pieces(text: Column) -> Column:
    """Each run of three characters of a text, once."""
    at = F.when(F.length(text) > 2, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: text.substr(i, F.lit(3))))


def holds(name: Column | str, text: Column) -> Column:
    """Whether a name contains the text in any case; its wildcards count as such."""
    return F.ilike(name, F.concat(F.lit("%"), text, F.lit("%")))


@dataclass
class NameIndex:
    """``names``: rows with their number ``_no``. ``pieces``: (piece, n, parts). ``lists``:
    (piece, part, nos)."""

    names: DataFrame
    name: str
    pieces: DataFrame
    lists: DataFrame
    blocks: int

    def _rarest(self, texts: DataFrame) -> DataFrame:
        """(q, piece, parts) of each text that has a piece; none if no name has one of them."""
        each = texts.select("q", F.explode("pieces").alias("piece"))
        known = each.join(self.pieces, "piece", "left").groupBy("q").agg(F.min(F.struct(
            F.coalesce("n", F.lit(0)).alias("n"), "piece", "parts")).alias("least"))
        return known.filter("least.n > 0").select("q", "least.piece", "least.parts")

    def _starting(self, texts: DataFrame) -> DataFrame:
        """(q, piece, parts) for texts with no run of three: all pieces that start with one."""
        short = texts.filter("size(pieces) = 0 AND run <> ''").select("q", F.col("run").alias("start"))
        starts = self.pieces.withColumn("start", F.explode(F.array_distinct(F.array(
            F.substring("piece", 1, 1), F.substring("piece", 1, 2)))))
        return short.join(starts, "start").select("q", "piece", "parts")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """(q, _no): what the lists give for each distinct text of ``asked``."""
        runs = F.split(F.lower("q"), SPECIAL)
        texts = asked.select("q").distinct().select(
            "q", F.array_distinct(F.flatten(F.transform(runs, _pieces))).alias("pieces"),
            F.element_at(F.array_sort(runs, lambda a, b: F.length(a) - F.length(b)), -1)
            .alias("run"))

        def listed(found):
            parts = found.select("q", "piece", F.explode(
                F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            return parts.join(self.lists, ["piece", "part"]).select(
                "q", F.explode("nos").alias("_no"))
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        every = (texts.filter("run = ''").select("q", blocks.alias("block"))
                 .join(self.names.select("_no", _part("_no", F.lit(self.blocks)).alias("block")),
                       "block").select("q", "_no"))
        return (listed(self._rarest(texts)).unionByName(listed(self._starting(texts)).distinct())
                .unionByName(every))

    def find(self, asked: DataFrame) -> DataFrame:
        """The indexed rows that contain each distinct text of ``asked``, with ``q``."""
        return (self.candidates(asked).join(self.names, "_no").filter(holds(self.name, F.col("q")))
                .drop("_no"))


def _part(no: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(no), parts).cast("int")


def index_names(rows: DataFrame, name: str, size: int = LIST) -> NameIndex:
    """An index over ``rows``; they should be narrow (a key and the name). Null names are left
    out, as no text is part of them."""
    names = stored(rows.filter(F.col(name).isNotNull())
                   .withColumn("_no", F.monotonically_increasing_id()), "names")
    listed = names.select("_no", F.explode(_pieces(F.concat(F.lower(name), F.lit(FILL))))
                          .alias("piece"))
    pieces = stored(listed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("parts", F.ceil(F.col("n") / size).cast("int")), "name-pieces")
    # Only long lists need the join; it is split where one piece is in most names.
    long = stored(pieces.filter("parts > 1").select("piece", "parts"), "name-long-pieces")
    lists = (listed.join(long, "piece", "left")
             .withColumn("part", F.coalesce(_part("_no", F.col("parts")), F.lit(0)))
             .groupBy("piece", "part").agg(F.collect_list("_no").alias("nos")))
    n = names.count()
    return NameIndex(names, name, pieces, stored(lists, "name-lists", "piece", "part"),
                     max(1, -(-n // size)))
