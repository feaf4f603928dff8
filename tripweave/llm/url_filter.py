"""URL filter: rules first, then empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are added up by host, registered domain and suffix.
Each level's rates are shrunk towards the level above by a beta-binomial prior whose strength
is estimated from how much the rates of that level differ: suffixes towards all pages, domains
towards their suffix, hosts towards their domain. A host whose posterior lower bound of the bad
rate (mean less ``z`` standard deviations) is above ``max_bad`` is blocked.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path what follows up to ``?``, ``#`` or the end. Null urls and urls without
``://`` have an empty host and path, belong to no suffix and are judged like any other host.
Repeated pages are judged each; a page with outcomes of several rows is bad if one is; outcomes
of null or unknown page ids count nowhere; with no outcomes all is allowed. Only DataFrame
functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import once, record

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
MAX_BAD, Z = 0.5, 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and paths that start with a path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def levels(hosts: DataFrame, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``hosts`` with the ``suffix`` and registered ``domain`` of ``host``."""
    last = lambda n: F.substring_index("host", ".", -n)
    two = last(2).isin(*two_label)
    return (hosts.withColumn("suffix", F.when(two, last(2)).otherwise(last(1)))
            .withColumn("domain", F.when(two, last(3)).otherwise(last(2))))


def strength(groups: DataFrame) -> float:
    """Pseudo-pages of the prior at a level, by the method of moments, from its (n, k)."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    g, total, bad, squares, rates = groups.filter("n > 0").agg(
        F.count(F.lit(1)), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n)).first()
    if g < 2 or not 0 < bad < total:
        return MOST_STRENGTH
    m = bad / total
    within, room = m * (1 - m), total - squares / total - (g - 1)
    if room <= 0:
        return MOST_STRENGTH
    rho = (rates - m * m * total - within * (g - 1)) / (within * room)
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1)) if rho > 0 else MOST_STRENGTH


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, k, mean, bound) from (host, n, k): pages, bad ones, posterior, lower bound."""
    hosts = levels(hosts)
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    total, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    m0 = bad / total if total else 0.0
    m_h, m_d, m_s = strength(hosts), strength(domains), strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("k") + m_s * m0) / (F.col("n") + m_s)).alias("up"))
    domains = (domains.join(suffixes, "suffix")
               .select("domain", "suffix",
                       ((F.col("k") + m_d * F.col("up")) / (F.col("n") + m_d)).alias("up")))
    a = F.col("k") + m_h * F.col("up")
    b = F.col("n") - F.col("k") + m_h * (1 - F.col("up"))
    mean = a / (a + b)
    return (hosts.join(domains, ["domain", "suffix"])
            .select("host", "n", "k", mean.alias("mean"),
                    (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound")))


def rules_of(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, rules): of each host some rule fits, the rules on it or on a host above it."""
    listed = hosts.sparkSession.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(r.host).alias("above"), F.lit(r.path).alias("path"),
                 F.lit(r.text).alias("text"), F.lit(r.action).alias("action"))
        for r in rules))))
    above = once(F.split("host", r"\."), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return (hosts.select("host", F.explode(F.array_distinct(above)).alias("above"))
            .join(listed, "above").groupBy("host")
            .agg(F.collect_list(F.struct("path", "text", "action")).alias("rules")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], max_bad: float = MAX_BAD,
          z: float = Z, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of every page.

    ``outcomes`` has (key, bad), bad being 1 or 0; a null one is no outcome.
    """
    pages = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"))
    bad = (outcomes.select(F.col(key).alias("key"), F.col("bad").cast("int").alias("bad"))
           .dropna().groupBy("key").agg(F.max("bad").alias("bad")))
    hosts = stored(pages.select("key", "host").join(bad, "key", "left").groupBy("host")
                   .agg(F.count("bad").alias("n"),
                        F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), "hosts")
    known = reputations(hosts, z)
    if rules:
        known = known.join(rules_of(hosts.select("host"), rules), "host", "left")
    else:
        known = known.withColumn(
            "rules", F.expr("cast(null as array<struct<path:string,text:string,action:string>>)"))
    known = stored(known, "host-reputations")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: record(
        size=F.length(r["text"]), text=r["text"], action=r["action"])))
    own = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return (pages.join(known, "host").withColumn("best", best)
            .select(F.col("key").alias(key), "host", "path", F.col("best.text").alias("rule"),
                    F.coalesce("best.action", own).alias("verdict")))
