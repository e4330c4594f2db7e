"""URL filter: ordered host rules, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages are counted per host. A beta-binomial prior passes from all
pages to the public suffix, to the registered domain, to the host: each level's mean
is shrunk towards the one above by a strength that the spread of its members' rates
implies (method of moments). A host whose posterior bad rate is surely above the
threshold, by a one-sided bound, is blocked. A host without outcomes has the posterior
of the nearest level above it that has some.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from turnstore.runtime import cut_lineage, small_side

# Suffixes of more than one label under which names are registered. Fixed values.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                 "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "org.au", "org.uk", "or.jp")
# A host is blocked above so many times the bad rate of all pages, and above this rate at the
# latest; standard deviations of the bound.
RATE_FACTOR = 2.0
BAD_RATE = 0.5
BOUND_SD = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
# The prior of all: one bad and one good page.
START_MEAN, START_STRENGTH = 0.5, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains if the path starts with *path*."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as (name, verdict); null without one."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def _sums(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, bad, strength) of *members*, the counts one level below; the strength follows from the spread of their rates."""
    sums = members.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("_k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("_q"), F.sum(F.col("n") * F.col("n")).alias("_nn"),
        (F.sum("bad") / F.sum("n")).alias("_p"))
    noise = F.col("_p") * (1 - F.col("_p"))
    spread = F.col("_q") - F.col("_p") * F.col("bad")
    room = (F.col("n") - F.col("_nn") / F.col("n") - (F.col("_k") - 1)) * noise
    rho = (spread - (F.col("_k") - 1) * noise) / room
    strength = F.when((F.col("_k") > 1) & (room > 0) & (rho > 0), F.least(
        F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.round(1 / rho - 1, 6)))).otherwise(F.lit(MOST_STRENGTH))
    return sums.select(*keys, "n", "bad", F.when(F.col("_k") == 1, F.lit(10.0)).otherwise(strength).alias("strength"))


def _mean(strength, mean):
    """The mean of a row's n and bad, shrunk towards *mean*."""
    return (strength * mean + F.col("bad")) / (strength + F.col("n"))


def _placed(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))


@dataclass(frozen=True)
class Reputation:
    """What outcomes say: the mean and strength of all pages, and the tables of the levels below."""

    mean: float
    strength: float
    suffixes: DataFrame
    domains: DataFrame
    hosts: DataFrame


def fit(outcomes: DataFrame) -> Reputation:
    """Priors from rows (host, bad 0/1); rows without host or outcome are ignored.

    The prior of all pages is one row, which the driver holds. Sums are exact; the strengths are
    rounded to six places, so the order of rows does not matter.
    """
    hosts = _placed(cut_lineage(outcomes.where("host is not null and bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))))
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    world = _sums(by_suffix).first()
    if not world.n:
        mean, strength = START_MEAN, START_STRENGTH
    else:
        mean, strength = (START_STRENGTH * START_MEAN + world.bad) / (START_STRENGTH + world.n), world.strength
    suffixes = cut_lineage(_sums(by_domain, "suffix").withColumn("mean", _mean(F.lit(strength), F.lit(mean))))
    above = suffixes.select("suffix", F.col("mean").alias("_mean"), F.col("strength").alias("_strength"))
    domains = _sums(hosts, "domain", "suffix").join(small_side(above), "suffix").withColumn(
        "mean", _mean(F.col("_strength"), F.col("_mean"))).drop("_mean", "_strength")
    return Reputation(mean, strength, suffixes, domains, hosts)


def reputation(outcomes: DataFrame | Reputation, bound_sd: float = BOUND_SD, asked: DataFrame | None = None) -> DataFrame:
    """Per host of *outcomes* (host, bad 0/1): n, bad, mean and lower bound of the bad rate.

    Hosts of *asked* (host) without outcomes follow with n = 0 and what their domain,
    suffix or all pages imply.
    """
    known = outcomes if isinstance(outcomes, Reputation) else fit(outcomes)
    hosts = known.hosts
    if asked is not None:
        new = asked.select("host").where("host is not null").distinct().join(hosts.select("host"), "host", "left_anti")
        none = F.lit(0).cast("long")
        hosts = hosts.unionByName(_placed(new.select("host", none.alias("n"), none.alias("bad"))))
    prior = F.struct("mean", "strength")
    hosts = (hosts.join(known.domains.select("domain", prior.alias("_of_domain")), "domain", "left")
             .join(small_side(known.suffixes.select("suffix", prior.alias("_of_suffix"))), "suffix", "left"))
    near = F.coalesce("_of_domain", "_of_suffix", F.struct(F.lit(known.mean).alias("mean"), F.lit(known.strength).alias("strength")))
    hosts = hosts.withColumn("_near", near)
    size = F.col("_near.strength") + F.col("n")
    mean = _mean(F.col("_near.strength"), F.col("_near.mean"))
    hosts = hosts.select("host", "n", "bad", mean.alias("mean"), size.alias("_size"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_size") + 1))
    return hosts.select("host", "n", "bad", "mean", (F.col("mean") - bound_sd * sd).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, bad_rate: float | None = None,
          bound_sd: float = BOUND_SD) -> DataFrame:
    """Per row of *pages* (page_id, url): page_id, host, path, rule, verdict, bad_low.

    A fitting rule decides; else the host is blocked if the lower bound of its bad rate
    is above *bad_rate* (default: RATE_FACTOR times the fitted rate of all pages, at most
    BAD_RATE); a host without outcomes is judged by its domain, suffix or all pages. Urls
    without a host are allowed and have no bound. Null urls, or urls without ``://``, have
    an empty host and path.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "_rule", rule_of(F.col("host"), F.col("path"), rules))
    fitted = fit(outcomes.where("host <> ''"))
    known = reputation(fitted, bound_sd, found.where("host <> ''"))
    judged = found.join(known.select("host", "low"), "host", "left")
    limit = min(BAD_RATE, RATE_FACTOR * fitted.mean) if bad_rate is None else bad_rate
    by_host = F.when(F.col("low") > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.name").alias("rule"),
                         F.coalesce("_rule.verdict", by_host).alias("verdict"), F.col("low").alias("bad_low"))


def page_outcomes(pages: DataFrame) -> DataFrame:
    """(host, bad) from the pages themselves: bad if symbols are a twentieth of the visible text.

    Pages without html, or without visible text, have no outcome.
    """
    tagless = F.regexp_replace(F.regexp_replace(F.col("html"), "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    plain = pages.select(host_of(F.col("url")).alias("host"), F.regexp_replace(tagless, "&[a-z]+;", " ").alias("_plain"))

    def others(pattern: str) -> Column:
        # The little that matches is taken away, by runs.
        return F.length(F.regexp_replace("_plain", pattern, ""))

    whole = F.length("_plain")
    counted = plain.select("host", others("[ \t\r\n]+").alias("_n"), (whole - others("[#*$%&|<>!]+")).alias("_symbols"))
    return counted.select("host", F.when(F.col("_n") > 0, (20 * F.col("_symbols") >= F.col("_n")).cast("int")).alias("bad"))
