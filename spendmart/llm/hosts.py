"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and public suffix. Every level shrinks towards the one
above through a beta-binomial prior: the prior's mean is the parent's posterior mean, its strength is estimated from the
spread of the level's rates by the method of moments. A host is blocked when the lower posterior bound of its bad rate
lies above a threshold; a host without labels has its domain's posterior, and so on up. All of it is column expressions
and aggregates; only the strength of each level, one row, is joined to all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendmart.llm.shared import materialize

# Suffixes of two labels under which names are registered; everything else has one label
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
BLANK_STRENGTH = 10.0  # where the data cannot tell: too few units, or no spread beyond chance


@dataclass(frozen=True)
class Rule:
    """text: host/path; fits the host and its subdomains where the url's path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands between the host and ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null where none does. Ties: the first listed."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def with_levels(pages: DataFrame) -> DataFrame:
    """Adds domain (suffix and one label before it) and suffix of `host`; a port does not count. A bare suffix is its own domain."""
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.element_at(labels, -1))
    width = F.size(F.split(suffix, r"\.")) + 1
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - width + 1), width), ".")
    return pages.withColumn("suffix", suffix).withColumn("domain", domain)


def _strength(units: DataFrame) -> DataFrame:
    """One row: prior strength of a level. units: n, bad, prior (the parent's mean).

    With binomial counts n around beta means of strength s, the squared misses sum to m(1-m)(n + (n-1) n/(s+1) ...)/n;
    solving the sums for the correlation 1/(s+1) gives s.
    """
    miss = F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2)
    chance = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    extra = chance * (F.col("n") - 1)
    sums = units.agg(F.sum(miss).alias("miss"), F.sum(chance).alias("chance"), F.sum(extra).alias("extra"), F.count(F.lit(1)).alias("units"))
    share = (F.col("miss") - F.col("chance")) / F.nullif(F.col("extra"), F.lit(0.0))
    known = (F.col("units") >= 3) & (share > 0)
    return sums.select(F.when(known, F.greatest(F.lit(1.0), 1 / F.least(share, F.lit(1.0)) - 1)).otherwise(F.lit(BLANK_STRENGTH)).alias("strength"))


def _shrunk(units: DataFrame, level: str) -> DataFrame:
    """Adds a and b of each unit's beta posterior. units: level's key, n, bad, prior."""
    units = materialize(units, level)
    strength = F.broadcast(_strength(units))  # one row
    return units.join(strength, F.lit(True)).select(
        *units.columns,
        (F.col("bad") + F.col("strength") * F.col("prior")).alias("a"),
        (F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))).alias("b"),
    )


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Beta posteriors of the bad rate by level: host, domain, suffix (key, a, b) and one row for all (a, b).

    outcomes: host, bad (0 or 1), one row per labelled page; rows without either are left out.
    """
    known = with_levels(outcomes.filter("host IS NOT NULL AND host <> '' AND bad IS NOT NULL").select("host", F.col("bad").cast("double").alias("bad")))
    hosts = materialize(known.groupBy("host", "domain", "suffix").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).cast("double").alias("n")), "host-counts")
    everything = hosts.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5).alias("a"), (F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0.0)) + 0.5).alias("b"))
    everything = materialize(everything, "all-outcomes")
    mean = lambda: F.col("a") / (F.col("a") + F.col("b"))
    top = F.broadcast(everything.select(mean().alias("prior")))  # one row
    suffixes = hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).join(top, F.lit(True))
    suffixes = _shrunk(suffixes, "suffix")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    domains = _shrunk(domains.join(suffixes.select("suffix", mean().alias("prior")), "suffix"), "domain")
    below = _shrunk(hosts.join(domains.select("domain", mean().alias("prior")), "domain"), "host")
    return {"host": below.select("host", "a", "b"), "domain": domains.select("domain", "a", "b"), "suffix": suffixes.select("suffix", "a", "b"), "all": everything}


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], worst: float = 0.5, deviations: float = 1.645) -> DataFrame:
    """Per page (page_id, url): page_id, host, path, rule, verdict, bad_rate, bad_bound, level.

    bad_rate is the posterior mean of the nearest level with labels, bad_bound its lower bound (mean less `deviations`
    standard deviations); a page is blocked where the bound exceeds `worst`. A rule overrides. A null url or one without
    :// has an empty host and path and is judged by the mean of all; without any label nothing is blocked.
    """
    names = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    levels = reputation(outcomes)
    distinct = with_levels(names.select("host").distinct())
    rated = distinct
    for level in ("host", "domain", "suffix"):
        rated = rated.join(levels[level].select(level, F.struct("a", "b", F.lit(level).alias("level")).alias(f"by_{level}")), level, "left")
    rated = rated.join(F.broadcast(levels["all"].select(F.struct("a", "b", F.lit("all").alias("level")).alias("by_all"))), F.lit(True))
    best = F.coalesce("by_host", "by_domain", "by_suffix", "by_all")
    a, b = best["a"], best["b"]
    rate = a / (a + b)
    bound = F.greatest(F.lit(0.0), rate - deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    rated = materialize(rated.select("host", rate.alias("bad_rate"), bound.alias("bad_bound"), best["level"].alias("level")), "rated")
    ruled = names.join(rated, "host", "left").withColumn("ruling", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("ruling.verdict", F.when(F.col("bad_bound") > worst, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("ruling.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_bound", "level")
