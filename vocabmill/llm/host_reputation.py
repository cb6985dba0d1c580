"""URL filter: rules first, then the host's reputation by empirical Bayes.

Labelled page outcomes are counted by host. Beta-binomial priors shrink them:
the rate of bad pages of a suffix is drawn towards that of all pages, that of a
registered domain towards its suffix', that of a host towards its domain's. How
strongly is estimated at each level from how much the groups' rates differ
beyond chance (moments of the beta-binomial). A host is blocked if the lower
posterior bound of its rate of bad pages exceeds a limit, so few labels block
nothing, and hosts without labels go by their domain and suffix.

The suffix is the host's last label and the registered domain its last two,
unless the host ends with one of ``suffixes`` of two labels.

Null urls and urls without ``://`` have an empty host and path; an empty host is
judged like any other. Repeated pages are judged each. Outcomes of unknown pages
or without a value count for nothing; a page with several outcomes counts with
each. Without outcomes everything is allowed unless a rule blocks it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabmill.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Some suffixes of two labels.
SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk"]


#: Of the variance between groups. At this share a prior weighs four pages, the least that it ever does.
MOST_SHARED = 0.2


@dataclass(frozen=True)
class Params:
    limit: float = 0.5  # of the rate of bad pages
    deviations: float = 1.6448536269514722  # below the posterior mean: 95 % on one side
    suffixes: tuple[str, ...] = tuple(SUFFIXES)


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if nothing does."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(verdict, host, path)`` that fits, and its verdict; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, its_host, its_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(its_path)
        name = F.when(fits, its_host + its_path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


#: Users before a host, ports behind it, and addresses instead of names.
USER, PORT, ADDRESS = r"^.*@", r":[0-9]*\z", r"^([0-9]+([.][0-9]+){3}|\[.*\])\z"


def domain_of(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix, without users and ports. An address is its own domain; all share an empty suffix."""
    site = F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, "")
    address = site.rlike(ADDRESS)
    two = F.substring_index(site, ".", -2)
    long = two.isin(list(suffixes))
    domain = F.when(long, F.substring_index(site, ".", -3)).otherwise(two)
    suffix = F.when(long, two).otherwise(F.substring_index(site, ".", -1))
    return F.when(address, site).otherwise(domain), F.when(address, "").otherwise(suffix)


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Rate of all, and how many pages its prior weighs, from counts ``n, bad`` of groups."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    row = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("bb")
    ).head()
    if not row.n:
        return 0.0, 1.0
    rate = row.bad / row.n
    spread = rate * (1 - rate)
    free = row.n - row.nn / row.n - (row.k - 1)
    if spread == 0 or free <= 0:
        return rate, 1000.0
    shared = ((row.bb - row.bad * rate) / spread - (row.k - 1)) / free
    shared = min(max(shared, 0.001), MOST_SHARED)
    return rate, (1 - shared) / shared


def reputation(pages: DataFrame, outcomes: DataFrame, params: Params = Params(), key: str = "page_id", url: str = "url") -> DataFrame:
    """``host, n_labelled, bad_rate, bad_bound`` of every host of ``pages``.

    ``outcomes`` has ``key`` and the boolean ``bad``.
    """
    own = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"))
    known = outcomes.select(F.col(key).alias("key"), F.col("bad")).where("bad is not null")
    counted = own.join(known, "key", "left").groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
    domain, suffix = domain_of(F.col("host"), params.suffixes)
    hosts = stored(counted.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")

    def shrunk(prior: Column | float, weight: float) -> Column:
        return (F.col("bad") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))

    rate, weight = _strength(suffixes)
    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), weight).alias("prior"))
    _, weight = _strength(domains)
    domains = stored(domains.join(suffixes, "suffix").select("domain", shrunk(F.col("prior"), weight).alias("prior")), "domain-rates")
    _, weight = _strength(hosts)
    mean, total = shrunk(F.col("prior"), weight), F.col("n") + F.lit(weight)
    return hosts.join(domains, "domain").select(
        "host",
        F.col("n").alias("n_labelled"),
        mean.alias("bad_rate"),
        (mean - F.lit(params.deviations) * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bad_bound"),
    )


def judged(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], params: Params = Params(), key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key, host, path, rule, verdict, n_labelled, bad_rate, bad_bound`` of every page; the last two to six digits."""
    hosts = stored(reputation(pages, outcomes, params, key, url), "reputation")
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > params.limit, "block").otherwise("allow")
    rows = rows.join(hosts, "host", "left").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method))
    shown = [F.round(name, 6).alias(name) for name in ("bad_rate", "bad_bound")]
    return rows.select(F.col("key").alias(key), "host", "path", "rule", "verdict", "n_labelled", *shown)


