"""URL filtering by empirical-Bayes host reputation, with explicit rules that take precedence.

Labelled page outcomes are counted by host, registered domain and public suffix. Each level has a beta prior whose mean
is the posterior mean of the level above and whose strength comes from the spread between that level's groups (method
of moments for the beta-binomial). A host is blocked where the lower posterior bound of its rate of bad pages is over
the threshold; the bound is the posterior mean less Z posterior deviations, which stands for the beta quantile that SQL
lacks. Counts by host are written down once; pages are read for them and for the verdicts. Everything is built-in SQL
functions; the driver sees fifteen sums.

For the grouping alone a host goes without user info, port and trailing dots, and numeric and bracketed addresses have
no domain or suffix above them but themselves.

Defined results: a url that is null or has no "://" has an empty host and path; the empty host is a group like any
other. Hosts without labels get their domain's, suffix's or the overall rate. Rows are neither merged nor dropped;
outcomes that are null don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels: a registry's usual second level below a country's two letters; else the last label.
SECOND_LEVEL = "ac|co|com|edu|go|gob|gov|gv|mil|ne|net|nom|or|org|sch"
TWO_LABELS, ADDRESS = rf"^({SECOND_LEVEL})\.[a-z][a-z]$", r"^([0-9]+(\.[0-9]+)*|\[.*)$"
#: The outcome of a host is block where mean - Z * deviation of the bad rate is over THRESHOLD.
THRESHOLD, Z = 0.4, 1.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def named(host: Column) -> Column:
    """The host without user info, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def suffix_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.rlike(TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.rlike(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. The rules are few: one CASE, longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _strength(n: str, bad: str) -> list[Column]:
    """Groups, trials, bad ones, squares of trials and bad ** 2 / trials of the groups that have trials."""
    some = F.col(n) > 0
    return [F.sum(some.cast("long")), F.sum(n), F.sum(bad), F.sum(F.col(n) * F.col(n)), F.sum(F.when(some, F.col(bad) * F.col(bad) / F.col(n)))]


def prior_strength(groups: float, trials: float, bad: float, squares: float, ratio: float) -> float:
    """a + b of the beta prior, from the intraclass correlation rho of the groups, held within 0.001 to 0.9."""
    if not trials or not 0 < bad < trials:
        return 1 / 0.001 - 1
    p = bad / trials
    room = trials - squares / trials - (groups - 1)
    rho = ((ratio - bad * p) / (p * (1 - p)) - (groups - 1)) / room if room > 0 else 0.0
    return 1 / min(0.9, max(0.001, rho)) - 1


def host_reputation(hosts: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """hosts (host, n_labelled, n_bad) with bad_rate, bad_bound and blocked."""
    hosts = hosts.withColumn("name", named(F.col("host")))
    hosts = cut(hosts.select("host", suffix_of(F.col("name")).alias("suffix"), domain_of(F.col("name")).alias("domain"), "n_labelled", "n_bad"))
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad"))
    domains = total(hosts, "suffix", "domain")
    suffixes = total(domains, "suffix")
    sums = [[float(x or 0) for x in df.agg(*_strength("n_labelled", "n_bad")).first()] for df in (suffixes, domains, hosts)]
    of_suffix, of_domain, of_host = (prior_strength(*x) for x in sums)
    overall = (sums[0][2] + 0.5) / (sums[0][1] + 1)
    above = lambda n, bad, strength, mean: (F.col(bad) + strength * mean) / (F.col(n) + strength)
    suffixes = suffixes.select("suffix", above("n_labelled", "n_bad", of_suffix, F.lit(overall)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", above("n_labelled", "n_bad", of_domain, F.col("suffix_rate")).alias("domain_rate"))
    rate = above("n_labelled", "n_bad", of_host, F.col("domain_rate"))
    return (
        hosts.join(domains, ["domain", "suffix"])
        .withColumn("bad_rate", rate)
        .withColumn("bad_bound", F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n_labelled") + of_host + 1)))
        .select("host", "n_labelled", "n_bad", "bad_rate", "bad_bound", (F.col("bad_bound") > threshold).alias("blocked"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and the host's bad_rate and bad_bound.

    outcomes: page_id and bad (boolean), several a page or none. Counts are summed on each side of the join before
    hosts are grouped, and hosts are grouped with partial sums, so a host with a third of the pages costs no one task.
    """
    url = F.col("url")
    pages = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    found = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    labelled = pages.select("page_id", "host").join(found, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_labelled"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_bad"))
    known = host_reputation(hosts, threshold, z)
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return pages.join(known, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "bad_rate", "bad_bound")
