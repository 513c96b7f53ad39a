"""URL filters: rules first, then empirical-Bayes host reputation. DataFrame functions only.

Reputation. Pages with a known outcome (bad or not) are counted by host, registered domain and public suffix. The rate of bad pages of
a suffix is shrunk towards the overall rate, that of a domain towards its suffix, that of a host towards its domain, each by a beta-binomial prior
whose weight is fitted to how much the rates of that level differ (method of moments). A host is blocked if a lower bound of its
posterior rate exceeds a limit: hosts with few outcomes follow their domain, and none is blocked on thin evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Lower posterior bound: mean less so many standard deviations.
SIGMAS = 1.645
LIMIT = 0.5
#: A prior weighs as much as so many pages, at least and at most.
WEIGHT = (1.0, 10_000.0)
MANY = 1000
#: Second-level labels that belong to the suffix below a country's domain (fixed values).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"[.]*(:[0-9]*)?$", "")


def suffix_of(name: Column) -> Column:
    """The public suffix by rule: the last label, with a usual second level below a two-letter one; addresses are their own."""
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).otherwise(
        F.regexp_extract(name, r"(?:^|\.)((?:" + "|".join(SECOND_LEVEL) + r")\.[a-z][a-z]|[^.]*)$", 1))


def domain_of(name: Column, suffix: Column) -> Column:
    """The suffix and one label more; the suffix itself if there is none."""
    rest = F.substr(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    return F.when(F.length(name) <= F.length(suffix) + 1, name).otherwise(F.concat(F.regexp_extract(rest, r"[^.]*$", 0), F.lit("."), suffix))


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """host and ``bound``, the lower posterior bound of its rate of bad pages, for every row of ``hosts`` (host, each once).

    ``outcomes`` has host and bad (boolean), a row for each page with a known outcome; null hosts count as empty ones, rows with a null bad are passed
    over. Without outcomes the bound is null.
    """
    counted = (outcomes.where("bad is not null").groupBy(F.coalesce("host", F.lit("")).alias("host"))
               .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("b")))
    name = hosts.select("host", name_of(F.col("host")).alias("name")).withColumn("suffix", suffix_of(F.col("name")))
    at_host = stored(name.withColumn("domain", domain_of(F.col("name"), F.col("suffix"))).join(counted, "host", "left")
                     .select("host", "domain", "suffix", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("b", F.lit(0.0)).alias("b")), "hosts")
    at_domain = at_host.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    at_suffix = at_domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    total = at_suffix.agg(F.sum("sn").alias("n"), F.sum("sb").alias("b")).first()
    if not total["n"]:
        return hosts.select("host", F.lit(None).cast("double").alias("bound"))
    overall = (total["b"] + 0.5) / (total["n"] + 1.0)
    k_suffix = _weight(at_suffix.select(F.col("sn").alias("n"), F.col("sb").alias("b"), F.lit(overall).alias("m")), 1)
    shrunk = lambda b, n, m, k: (b + m * F.lit(k)) / (n + F.lit(k))
    at_suffix = at_suffix.withColumn("sm", shrunk(F.col("sb"), F.col("sn"), F.lit(overall), k_suffix))
    at_domain = at_domain.join(at_suffix.select("suffix", "sm"), "suffix")
    k_domain = _weight(at_domain.select(F.col("dn").alias("n"), F.col("db").alias("b"), F.col("sm").alias("m")), 0)
    at_domain = at_domain.withColumn("dm", shrunk(F.col("db"), F.col("dn"), F.col("sm"), k_domain))
    at_host = at_host.join(at_domain.select("domain", "suffix", "dm"), ["domain", "suffix"])
    k_host = _weight(at_host.select("n", "b", F.col("dm").alias("m")), 0)
    mean = shrunk(F.col("b"), F.col("n"), F.col("dm"), k_host)
    return at_host.select("host", (mean - F.lit(SIGMAS) * F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(k_host + 1.0)))).alias("bound"))


def _weight(groups: DataFrame, fitted: int) -> float:
    """Weight of a beta prior, in pages, from groups (n, b, expected rate m): the less the rates differ beyond chance, the heavier.

    ``fitted``: means that were fitted to the groups themselves. Three sums come back.
    """
    n, b, m = F.col("n"), F.col("b"), F.col("m")
    row = groups.where("n > 0").agg(
        F.sum((b - n * m) * (b - n * m) / n).alias("spread"), F.sum(m * (1 - m)).alias("chance"), F.sum(n).alias("n"),
        F.sum(n * n).alias("n2"), F.sum(n * m * (1 - m)).alias("v"), F.count(F.lit(1)).alias("groups")).first()
    variance = row["v"] / row["n"]
    between = (row["spread"] - row["chance"] + fitted * variance) / (row["n"] - fitted * row["n2"] / row["n"]) if row["groups"] > fitted else 0.0
    if between <= 0:
        return WEIGHT[1]
    return math.exp(max(math.log(WEIGHT[0]), min(math.log(WEIGHT[1]), math.log(max(variance / between - 1, WEIGHT[0])))))


def rules_by_host(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """host and ``fits``: the rules whose host it is or is below, as (length, rule, path, action).

    A host is cut into itself and all that it is below, which meet the rules by equality: any number of rules costs one join.
    """
    table = hosts.sparkSession.createDataFrame([(r.host, r.path, r.action) for r in rules], "at string, path string, action string")
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))).alias("at"))
    return (above.join(table, "at").groupBy("host").agg(F.collect_list(F.struct(
        F.length(F.concat("at", "path")).alias("length"), F.concat("at", "path").alias("rule"), F.col("path"), F.col("action"))).alias("fits")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url); ``outcomes`` has page_id and bad.

    The longest rule that fits decides (of two actions for one host and path, block); without one the verdict is the reputation's. Null urls have
    empty hosts and paths. Repeated rows are judged each, and their outcome counts each time; outcomes whose page is missing are passed over, several of one page are
    bad if any is. A table without rows gives none, one without outcomes blocks by rules only.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = stored(parts.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    score = reputation(parts.join(known, "page_id").select("host", "bad"), hosts)
    facts = stored(score.join(hosts, "host").join(rules_by_host(hosts, rules), "host", "left"), "host-facts")
    # A host with more than a MANY-th of all pages is joined by broadcast: there are fewer than MANY. The others are joined by shuffling.
    often = F.col("pages") * MANY > (hosts.agg(F.sum("pages")).first()[0] or 0)
    common = F.broadcast(facts.where(often))
    known_host = (parts.join(common, "host").unionByName(
        parts.join(common.select("host"), "host", "left_anti").join(facts.where(~often), "host")))
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])))
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return (known_host.withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", own).alias("verdict")))
