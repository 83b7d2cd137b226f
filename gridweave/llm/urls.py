"""URL filters: explicit rules first, else the reputation of the host by empirical Bayes.

Outcomes of pages (bad or not) are counted by host, registered domain and suffix. Each level's rate is
shrunk to the rate of the level above through a beta prior, whose strength is estimated from the spread
between the units of that level. A host is blocked if the lower bound of its posterior rate is too high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import MOST_SENT, looked_up, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "com.cn", "co.za", "com.mx")
#: Standard deviations below its mean that a posterior is under with a chance of at most 5 %, whatever its form
#: (Cantelli's inequality: 1 / (1 + k k)), the highest bad rate that passes, and the limits of a prior's strength.
DEVIATE, HIGHEST, WEAKEST, STRONGEST = 19**0.5, 0.2, 1.0, 10_000.0
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """From after the first :// up to the next /, ? or #, with A to Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column, doubles: tuple[str, ...] = DOUBLE_SUFFIXES) -> Column:
    """The last label of a name, or two where they are in doubles; an address is its own suffix."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*doubles), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, doubles: tuple[str, ...] = DOUBLE_SUFFIXES) -> Column:
    """The suffix and the label before it; an address is its own domain."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*doubles), F.substring_index(name, ".", -3)).otherwise(two)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, rule) pairs that fits; nulls if none does.

    A rule is a host, a slash and the start of a path. It fits the host and all below it. Of equal rules, block wins.
    The list is written into the plan, so it should hold hundreds at most.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        own = text.partition("/")[0]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(text[len(own) :])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def prior_strength(units: DataFrame) -> tuple[float, float]:
    """(overall rate, strength) of units (n, bad), by the moments of rates that differ more than chance allows."""
    r = units.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq")).first()
    if not r["n"]:
        return 0.0, STRONGEST
    mean = r["bad"] / r["n"]
    spread = mean * (1 - mean)
    space = r["n"] - r["nn"] / r["n"]
    between = (r["sq"] - r["n"] * mean * mean - (r["k"] - 1) * spread) / space if space > 0 else 0.0
    return mean, min(STRONGEST, max(WEAKEST, spread / between - 1)) if between > 0 else STRONGEST


def reputation(outcomes: DataFrame, doubles: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, low) for each host of outcomes (host, bad): its posterior bad rate and lower bound.

    bad is 1, 0 or null; null outcomes only make the host known. Hosts number far fewer than pages. doubles are the
    suffixes of two labels; ports and users belong to the host, not to its domain.
    """
    seen = F.col("bad").isNotNull().cast("long")
    hosts = outcomes.groupBy("host").agg(F.sum(seen).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"), doubles)).withColumn("suffix", suffix_of(F.col("host"), doubles)), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains, suffixes = hosts.groupBy("domain", "suffix").agg(*sums), hosts.groupBy("suffix").agg(*sums)
    (mean, at_suffix), (_, at_domain), (_, at_host) = (prior_strength(x.where("n > 0")) for x in (suffixes, domains, hosts))

    def shrunk(strength: float, above) -> Column:
        return (F.col("bad") + strength * above) / (F.col("n") + strength)

    top = suffixes.select("suffix", shrunk(at_suffix, F.lit(mean)).alias("above"))
    middle = domains.join(top, "suffix").select("domain", "suffix", shrunk(at_domain, F.col("above")).alias("above"))
    rate = shrunk(at_host, F.col("above"))
    posterior = hosts.join(middle, ["domain", "suffix"]).withColumn("rate", rate)
    error = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + at_host + 1))
    return posterior.select("host", "n", "bad", "rate", (F.col("rate") - DEVIATE * error).alias("low"))


def junk(html: Column, marks: str = "#$%*|", share: float = 0.01) -> Column:
    """1 if over a share of a page's characters are marks, 0 if not: the outcome where no labels are given."""
    return (F.length(html) - F.length(F.translate(html, marks, "")) > share * F.length(html)).cast("int")


def judge(pages: DataFrame, rules: list[tuple[str, str]], bad: Column, highest: float = HIGHEST) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page: the rule's verdict, else that of the host's reputation.

    bad: the outcome of a page, 1, 0 or null. Null urls and urls without :// have an empty host, judged as any other.
    Null page_ids and repeated rows come back as they are, and each repeated row counts as an outcome.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), bad.alias("bad"))
    known = stored(reputation(own.select("host", "bad")).select("host", F.when(F.col("low") > highest, "block").otherwise("allow").alias("by_host")), "reputation")
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    own = own.drop("bad")
    few = known.count() <= MOST_SENT
    judged = own.join(F.broadcast(known), "host") if few else looked_up(own, known, own.groupBy("host").agg(F.count("*").alias("n")), "host", "page_id")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict"))
