"""URL filter: fixed rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages (good or bad) are counted per host, registered
domain and public suffix. Each level's beta prior has the mean of the level
above and a strength estimated from the spread among that level's own members
(by moments of the beta-binomial). The posterior of a host is its counts on top
of its domain's prior, and so on up; a prior leaves out the member's own labels,
so that none counts twice. A page is blocked if the upper posterior bound of its host's good share lies
below ``min_good``: a host goes only on evidence. A host without labels has zero
counts on top of its domain's prior and is held to the same bound, as are
domains and suffixes without labels; its spread is then that of all levels it is
taken from, so that an unknown domain is not taken for as well known as its hosts
are alike. A prior never weighs more than ``PRIOR_SHARE`` of the labels that
stand behind its mean, so of two hosts of a domain with as many labels the one
with more good ones always ranks higher.

Registered domains follow rules in the form of the public suffix list (names,
``*.name`` and ``!name``), a parameter; without a rule the last label is the
suffix. A port is no part of the domain. An address in numbers is its own
domain, and all of them share one level above.

Only counts and the hosts of pages are shuffled before the join, combined per
task first. The join by host is an ordinary equi join, whose hot hosts adaptive
execution splits.

A null url, or one without ``://``, has an empty host and path and no labels of
its own. Null outcomes are no labels. An empty table of outcomes gives the
prior ``DEFAULT_GOOD`` everywhere, which blocks nothing. Repeated rows are
judged alike; equal rules are settled by the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.runtime import materialize

# Good share and strength of the prior above all suffixes.
DEFAULT_GOOD = 0.9
DEFAULT_STRENGTH = 2.0
STRENGTH_RANGE = (1.0, 1000.0)
PRIOR_SHARE = 0.5
MIN_GOOD = 0.5
Z = 1.645
ADDRESSES = "(address)"

# Suffixes of two labels under which names are registered; a whole list can be given instead.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx",
                      "com.tr", "gov.uk", "net.au", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


# The contract's rules.
RULES = (
    Rule("allow", "com", ""),
    Rule("block", "example.com", "en/"),
    Rule("allow", "www.example.com", "en/"),
    Rule("block", "net", "es/"),
    Rule("block", "net", "fr/"),
)


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")


def suffix_of(host: Column, rules: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix of a host: an exception's own suffix, else the longest rule of up to three labels, else the last label."""
    name = name_of(host)
    last = {n: F.substring_index(name, ".", -n) for n in (1, 2, 3)}
    plain = [r for r in rules if r[0] not in "*!"]
    wild, never = [r[2:] for r in rules if r.startswith("*.")], [r[1:] for r in rules if r.startswith("!")]
    one_of = lambda column, values: column.isin(*values) if values else F.lit(False)
    return (
        F.when(is_address(name), ADDRESSES)
        .when(one_of(last[2], never), last[1])
        .when(one_of(last[3], never), last[2])
        .when(one_of(last[3], plain) | (one_of(last[2], wild) & (last[3] != last[2])), last[3])
        .when(one_of(last[2], plain) | (one_of(last[1], wild) & (last[2] != last[1])), last[2])
        .otherwise(last[1])
    )


def domain_of(host: Column, rules: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more; an address is its own domain."""
    name, suffix = name_of(host), suffix_of(host, rules)
    labels = F.size(F.split(suffix, r"\.")) + 1
    longer = F.concat_ws(".", F.slice(F.reverse(F.split(name, r"\.")), F.lit(1), labels))
    return F.when(is_address(name), name).otherwise(F.concat_ws(".", F.reverse(F.split(longer, r"\."))))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (host == rule.host) | host.endswith(f".{rule.host}")
        fits = fits & path.startswith(f"/{rule.path}") if rule.path else fits
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Prior:
    """Mean and strength above all suffixes, and the strengths of the levels below."""

    mean: float
    suffix: float
    domain: float
    host: float


def strength_of(excess: float | None, trials: float | None) -> float:
    """Strength of a beta prior from a level's spread.

    ``excess`` sums n (p - P)^2 / (P (1 - P)) - 1 over members, P the mean of
    the level above; its expectation is rho (n - 1), summed in ``trials``, and
    the strength is 1 / rho - 1. Without any spread to see it is the largest.
    """
    if not trials:
        return DEFAULT_STRENGTH
    rho = (excess or 0.0) / trials
    low, high = STRENGTH_RANGE
    return high if rho <= 0 else min(max(1 / rho - 1, low), high)


def _others(level: str, strength: Column) -> Column:
    """The shrunken mean of the level above without the member's own counts, so that no label counts twice."""
    good, n = F.col(f"{level}_g") - F.col("g"), F.col(f"{level}_n") - F.col("n")
    return (good + strength * F.col(f"{level}_above")) / (n + strength)


def _bounded(strength: float, level: str, above: Column) -> Column:
    """A strength within its share of the labels that other members of the level have, and of the strength above."""
    return F.least(F.lit(strength), F.lit(PRIOR_SHARE) * (F.col(f"{level}_n") - F.col("n") + above))


def _variance(level: str, strength: Column, above: Column) -> Column:
    """Posterior variance of the members of a level, ``above`` being that of the level above, by the law of total variance."""
    total = F.col(f"{level}_n") + strength
    mean = (F.col(f"{level}_g") + strength * F.col(f"{level}_above")) / total
    weight = strength / total
    return (mean * (1 - mean) + total * weight * weight * above) / (total + 1)


def _level_strength(members: DataFrame) -> float:
    """Members have ``n``, ``g`` and ``above``, the mean of the level above. One row comes to the driver."""
    spread = F.col("n") * (F.col("g") / F.col("n") - F.col("above")) * (F.col("g") / F.col("n") - F.col("above"))
    row = members.where("n > 1").agg(
        F.sum(spread / (F.col("above") * (1 - F.col("above"))) - 1).alias("excess"), F.sum(F.col("n") - 1).alias("trials")
    ).first()
    return strength_of(row["excess"], row["trials"])


def reputations(
    outcomes: DataFrame, host: str = "host", good: str = "good", asked: DataFrame | None = None, suffix_rules: Sequence[str] = TWO_LABEL_SUFFIXES
) -> tuple[DataFrame, Prior]:
    """Hosts with labels and hosts of ``asked``: counts ``n`` and ``g``, prior mean ``above``, posterior ``alpha`` and
    ``beta``; and the priors. Hosts without labels have no part in means and strengths."""
    labels = outcomes.where(F.col(good).isNotNull()).select(
        F.col(host).alias("host"), F.lit(1).cast("long").alias("n"), F.col(good).cast("long").alias("g")
    )
    if asked is not None:
        none = F.lit(0).cast("long")
        labels = labels.unionByName(asked.select(F.col(host).alias("host"), none.alias("n"), none.alias("g")))
    counts = labels.groupBy("host").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    hosts = materialize(counts.withColumns({"domain": domain_of(F.col("host"), suffix_rules), "suffix": suffix_of(F.col("host"), suffix_rules)}))
    totals = F.sum("n").alias("n"), F.sum("g").alias("g")
    row = hosts.agg(*totals).first()
    mean = ((row["g"] or 0) + DEFAULT_GOOD * DEFAULT_STRENGTH) / ((row["n"] or 0) + DEFAULT_STRENGTH)
    unsure = F.lit(mean * (1 - mean) / ((row["n"] or 0) + DEFAULT_STRENGTH + 1))
    suffixes = hosts.groupBy("suffix").agg(*totals).withColumn("above", F.lit(mean))
    top = _level_strength(suffixes)
    above = suffixes.select("suffix", *[F.col(c).alias(f"suffix_{c}") for c in ("n", "g", "above")])
    above = above.withColumn("suffix_v", _variance("suffix", F.lit(top), unsure))
    domains = hosts.groupBy("domain", "suffix").agg(*totals).join(above, "suffix").withColumn("above", _others("suffix", F.lit(top)))
    middle = _level_strength(domains)
    domains = domains.withColumn("strength", _bounded(middle, "suffix", F.lit(top)))
    above = domains.select("domain", "suffix_v", *[F.col(c).alias(f"domain_{c}") for c in ("n", "g", "above", "strength")])
    above = above.withColumn("domain_v", _variance("domain", F.col("domain_strength"), F.col("suffix_v")))
    hosts = hosts.join(above, "domain").withColumn("above", _others("domain", F.col("domain_strength")))
    low = _level_strength(hosts)
    hosts = hosts.withColumn("strength", _bounded(low, "domain", F.col("domain_strength")))
    # Without labels, the strength that gives a beta of mean ``above`` the variance of all levels.
    own, strength = F.col("above") * (1 - F.col("above")), F.col("strength")
    unseen = own / ((own + strength * F.col("domain_v")) / (strength + 1)) - 1
    prior = F.when(F.col("n") > 0, strength).otherwise(unseen)
    alpha, beta = F.col("g") + prior * F.col("above"), F.col("n") - F.col("g") + prior * (1 - F.col("above"))
    return hosts.select("host", "n", "g", "above", alpha.alias("alpha"), beta.alias("beta")), Prior(mean, top, middle, low)


def upper_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Mean of a beta distribution plus ``z`` standard deviations, by its exact moments."""
    total = alpha + beta
    return alpha / total + z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, url: str = "url", good: str = "good", rules: tuple[Rule, ...] = RULES,
    min_good: float = MIN_GOOD, z: float = Z, suffix_rules: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``outcomes`` has a url and a boolean per labelled page.

    Columns of those names are replaced. A host without labels is judged by its domain's prior, or that of the level above.
    """
    asked = pages.select(host_of(F.col(f"`{url}`")).alias("host"))
    labels = outcomes.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{good}`").alias("good"))
    hosts, _ = reputations(labels, "host", "good", asked, suffix_rules)
    blocked = hosts.where(upper_bound(F.col("alpha"), F.col("beta"), z) < min_good).select(F.col("host").alias("__host"))
    base = pages.withColumn("__url", F.col(f"`{url}`")).drop("host", "path", "rule", "verdict")
    base = base.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url"))).drop("__url")
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = base.join(blocked.withColumn("__bad", F.lit(True)), F.col("host") == F.col("__host"), "left")
    return judged.withColumn("rule", name).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("__bad"), "block").otherwise("allow"))
    ).drop("__host", "__bad")
