"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Spans of the base kinds are found by regular expressions that match in linear time what the
plain ones do. They seed the bootstrap: the words around seeds are lexical patterns (two words
before; one before and one after). Other identifier-shaped tokens are candidates. A graph joins
patterns and values; in a few rounds a pattern's confidence is the share of its values that
are seeds or likely (with one added to the count), and a candidate's likelihood is one less the
product of its patterns' doubts. Candidates that end above ``accept`` get a span. A pattern
needs ``min_seeds`` distinct seed values, so chance neighbours induce nothing.

Null texts are empty: no spans. Positions are in code points, ends exclusive. Repeated rows are
reported each; a value's many copies count once in the graph. Very long texts are matched
whole; context is at most 64 characters of them. An empty table gives no rows; extra columns
are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import ROW, once, record, whole, with_rows

KINDS = ("email", "ip", "card", "phone")
# A match can only begin where a run of its characters begins or another match has ended;
# possessive runs never go back. Cards: whole runs of 16 to 19 digits with single marks
# between; shorter and longer runs are matches that fail.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# A token with a digit or an at sign, from its first character to its last.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT = 64
_HIT = "array<struct<start:int,end:int,value:string,left:string,head:string>>"


def hits(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places and what stands before them.

    Matches and the gaps between them alternate, so their lengths add up to places. The last
    element has no value: it is the gap at the end.
    """
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       F.split(text, pattern, -1),
                       lambda h, g: record(h=h, g=g))

    def step(held, x):
        start = held["pos"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["h"]), F.lit(0))
        one = record(start=start, end=end, value=x["h"],
                     left=F.right(x["g"], F.lit(CONTEXT)), head=F.left(x["g"], F.lit(CONTEXT)))
        return record(pos=end, out=F.concat(held["out"], F.array(one)))

    none = F.array().cast(_HIT)
    return F.aggregate(parts, record(pos=F.lit(0), out=none), step,
                       lambda held: held["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d):
        def step(held, i):
            n = F.substring(d, -i, F.lit(1)).cast("int")
            twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
            return held + F.when(i % 2 == 0, twice).otherwise(n)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)
    return once(digits, total) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."),
                             lambda p: p.rlike("^0*[0-9]{1,3}$") & (
                                 F.right(p, F.lit(3)).cast("int") <= 255)),
    "card": lambda v: _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(__row, key, email, ip, card, phone, tokens): the hits of each kind that are valid, and
    of tokens, with gaps; written down, without texts."""
    t = F.col("text")
    docs = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    digit, none = t.rlike("[0-9]"), F.array().cast(_HIT)
    found = {}
    for kind in KINDS:
        sign = F.contains(t, F.lit(SIGNS[kind])) if SIGNS[kind] else F.lit(True)
        need = sign if kind == "email" else sign & F.col("digit")
        found[kind] = F.when(need, hits(t, PATTERNS[kind])).otherwise(none)
    need = F.col("digit") | F.contains(t, F.lit("@"))
    found["tokens"] = F.when(need, hits(t, TOKEN)).otherwise(none)
    return with_rows(docs.withColumn("digit", digit)
                     .select("key", *(c.alias(n) for n, c in found.items())), "pii-base")


def _with_next(column: str) -> Column:
    """Hits with the head of the gap that follows; the gap at the end goes."""
    both = F.zip_with(F.col(column), F.slice(column, 2, F.greatest(F.size(column), F.lit(1))),
                      lambda h, n: record(start=h["start"], end=h["end"], value=h["value"],
                                          left=h["left"], after=n["head"]))
    return F.filter(both, lambda h: h["value"].isNotNull())


def _valid(kind: str) -> Column:
    return F.filter(_with_next(kind), lambda h: VALID[kind](h["value"]))


def _occurrences(base: DataFrame) -> DataFrame:
    """(__row, kind, seed, value, start, end, patterns): seeds, and candidates that overlap
    no base span. A candidate's kind is told by its shape; of other shapes it is null."""
    seeds = None
    for kind in KINDS:
        one = (base.filter(F.size(kind) > 0).select(ROW, F.lit(kind).alias("kind"),
                                                    F.lit(True).alias("seed"),
                                                    F.explode(kind).alias("h")))
        seeds = one if seeds is None else seeds.unionByName(one)
    spans = F.concat(*(F.transform(k, lambda h: record(s=h["start"], e=h["end"]))
                       for k in KINDS))
    free = (base.filter(F.size("tokens") > 0)
            .select(ROW, spans.alias("spans"), F.explode("tokens").alias("h"))
            .filter(~F.exists("spans", lambda s: (s["s"] < F.col("h.end"))
                              & (s["e"] > F.col("h.start")))).drop("spans"))
    opens = F.length(F.regexp_extract("h.value", r"^[(\[<\"']*", 0))
    core = F.regexp_extract("h.value", r"^[(\[<\"']*+(.*?)[.,;:!?)\]>\"']*$", 1)
    free = free.withColumn("opens", opens).withColumn("core", core)
    n = F.length(_digits(F.col("core")))
    kind = (F.when(F.col("core").rlike(r"^[^@]+@[^@]+$"), "email")
            .when(F.col("core").rlike(r"^[0-9]+([.:][0-9]+){3,}$"), "ip")
            .when(F.col("core").rlike(r"^[0-9][0-9-]*[0-9]$") & n.between(12, 19), "card")
            .when(F.col("core").rlike(r"^[(0-9][().0-9-]*[0-9]$") & n.between(7, 11), "phone"))
    start = F.col("h.start") + F.col("opens")
    free = (free.filter((n >= 5) | F.contains("core", F.lit("@")))
            .select(ROW, kind.alias("kind"), F.lit(False).alias("seed"),
                    record(start=start, end=start + F.length("core"), value=F.col("core"),
                           left=F.col("h.left"), after=F.col("h.after")).alias("h")))
    left = F.lower("h.left")
    two = F.regexp_extract(left, r"(?:^|\s)(\S+\s+\S+)\s+$", 1)
    one = F.regexp_extract(left, r"(?:^|\s)(\S+)\s+$", 1)
    after = F.regexp_extract(F.lower("h.after"), r"^\s+(\S+)(?:\s|$)", 1)
    patterns = F.array_compact(F.array(
        F.when(two != "", F.concat(F.lit("2:"), F.regexp_replace(two, r"\s+", " "))),
        F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("1:"), one, after))))
    return (seeds.unionByName(free)
            .select(ROW, "kind", "seed", "h.value", "h.start", "h.end", patterns.alias("patterns")))


def discovered(occurrences: DataFrame, min_seeds: int, accept: float, rounds: int) -> DataFrame:
    """(kind, value): candidates that patterns speak for."""
    edges = (occurrences.select(F.explode("patterns").alias("p"), "kind", "value", "seed")
             .groupBy("p", "kind", "value", "seed").agg(F.lit(1).alias("x")).drop("x"))
    edges = stored(edges, "pii-edges")
    induced = stored(edges.filter("seed").groupBy("p", "kind").agg(F.count(F.lit(1)).alias("seeds"))
                     .filter(F.col("seeds") >= min_seeds).drop("seeds"), "pii-patterns")
    # Of patterns that were induced: how many values of any kind, and the edges of their kind.
    of = induced.select("p").distinct()
    sizes = stored(edges.join(of, "p", "left_semi").groupBy("p")
                   .agg(F.count(F.lit(1)).alias("values")), "pii-sizes")
    graph = stored(edges.join(induced, ["p", "kind"], "left_semi"), "pii-graph")
    likely = None
    for _ in range(rounds):
        score = F.when(F.col("seed"), 1.0)
        scored = graph
        if likely is not None:
            scored = graph.join(likely, ["kind", "value"], "left")
            score = score.otherwise(F.coalesce("score", F.lit(0.0)))
        else:
            score = score.otherwise(0.0)
        trust = (scored.groupBy("p", "kind").agg(F.sum(score).alias("good")).join(sizes, "p")
                 .select("p", "kind", (F.col("good") / (F.col("values") + 1)).alias("trust")))
        trust = stored(trust, "pii-trust")
        doubt = F.sum(F.log1p(-F.col("trust")))
        likely = stored(graph.filter("not seed").join(trust, ["p", "kind"])
                        .groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("score")),
                        "pii-likely")
    return likely.filter(F.col("score") >= accept).select("kind", "value")


def _ordered(kind: str, order: int) -> Column:
    return F.transform(kind, lambda h: record(order=F.lit(order), start=h["start"], end=h["end"]))


def find(docs: DataFrame, min_seeds: int = 3, accept: float = 0.8, rounds: int = 3,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, added) for every row: base spans counted
    by kind, and both lists of spans as arrays of ``kind:start:end`` structs in order."""
    raw = base_spans(docs, text, key)
    base = stored(raw.select(ROW, "key", *(_valid(k).alias(k) for k in KINDS),
                             _with_next("tokens").alias("tokens")), "pii-spans")
    seen = stored(_occurrences(base), "pii-occurrences")
    known = discovered(seen, min_seeds, accept, rounds)
    order = F.lit(0)
    for i, k in enumerate(KINDS):
        order = F.when(F.col("kind") == k, i).otherwise(order)
    added = (seen.filter("not seed and kind is not null").join(known, ["kind", "value"], "left_semi")
             .groupBy(ROW).agg(F.collect_list(
                 record(order=order, start=F.col("start"), end=F.col("end"))).alias("added")))
    own = F.concat(*(_ordered(k, i) for i, k in enumerate(KINDS)))
    none = F.array().cast("array<struct<order:int,start:int,end:int>>")
    return (base.join(added, ROW, "left")
            .select(F.col("key").alias(key),
                    *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
                    F.sort_array(own).alias("base"),
                    F.coalesce("added", none).alias("added")))


def written(spans: Column) -> Column:
    """Spans as text, by kind and start."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")
