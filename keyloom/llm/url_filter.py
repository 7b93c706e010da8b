"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted for each host. A beta-binomial prior is shrunk
from the whole corpus to the suffix, from the suffix to the registered domain and from there to the
host; a host is blocked where the upper posterior bound of its share of good pages stays under a
threshold, so that a host with few labels is never blocked on little evidence of its own. A host without
labels is judged by its prior: that of its domain, or of its suffix where the domain has no labels either.

Only DataFrame functions run here: pages are split by one regular expression each, label counts are
summed before they are shuffled, and verdicts are joined back to the pages by Spark's own choice of join
(broadcast where it measures a small side, a skew-splitting sort-merge join else). A domain is listed only
where its verdict differs from its suffix's and a host only where it differs from its domain's, so these
tables are far smaller than the number of hosts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.stage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Rules are literals of the plan, so their number is bounded.
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """z: standard deviations of the posterior bound. least_good: the share of good pages asked for."""

    z: float = 1.645
    least_good: float = 0.5
    max_strength: float = 1000.0


def url_host(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. Of equally long rules
    the one that comes first in text order counts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be part of a plan")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(
            found
        )
    return found


#: Labels that stand for a kind of registration where they precede a country's two letters.
KINDS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ne", "net", "or", "org")
SUFFIX = rf"(?:(?:{'|'.join(KINDS)})\.[a-z]{{2}}|[^.]*)"


def suffix_of(host: Column) -> Column:
    """The last label of a host; the last two where these are a kind and a country, such as co.uk."""
    return F.regexp_extract(host, rf"(?:^|\.)({SUFFIX})\z", 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it, if there is one."""
    return F.regexp_extract(host, rf"(?:^|\.)((?:[^.]*\.)?{SUFFIX})\z", 1)


def _strength(groups: DataFrame, p: Column, limit: float) -> Column:
    """Prior strength (pseudo-counts) of groups (n, k) about their parents' share `p`, by moments.

    The intraclass correlation r of a beta-binomial is estimated from sum n (k/n - p)^2; the strength
    is 1/r - 1, held to [1, limit]. Without spread beyond chance it is the limit.
    """
    q = p * (1 - p)
    spread = F.sum(F.when(q > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / q).otherwise(0.0))
    r = (spread - F.count("*")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    return F.coalesce(F.least(F.lit(limit), F.greatest(F.lit(1.0), 1 / F.greatest(r, F.lit(1e-9)) - 1)), F.lit(limit))


def reputation(outcomes: DataFrame, setting: Reputation = Reputation()) -> DataFrame:
    """outcomes (host, good 0/1), one row per labelled page -> (level, name, parent, n, mean, upper).

    Levels are suffix, domain and host; parent is a domain's suffix and a host's domain. mean is the posterior
    mean of the share of good pages. upper is a host's posterior bound; of a domain or suffix it is the bound of
    a member without labels, whose prior has this mean. Null outcomes, null hosts and empty ones take no part. No outcomes
    give no rows. Repeated rows are outcomes of their own.
    """
    hosts = written(
        outcomes.filter(F.col("good").isNotNull() & (F.col("host") != ""))
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}),
        "hosts",
    )
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    shrink = lambda prior, strength: (F.col("k") + strength * prior) / (F.col("n") + strength)

    domains, top = total(hosts, "domain", "suffix"), total(hosts).first()
    mean = (top.k or 0) / (top.n or 1)
    suffixes = total(domains, "suffix")
    by_suffix = suffixes.agg(_strength(suffixes, F.lit(mean), setting.max_strength).alias("s")).first().s
    suffixes = suffixes.select("suffix", F.col("n").alias("n_suffix"), shrink(F.lit(mean), F.lit(by_suffix)).alias("m_suffix"))
    domains = domains.join(suffixes, "suffix")
    by_domain = domains.agg(_strength(domains, F.col("m_suffix"), setting.max_strength).alias("s")).first().s
    domains = domains.select("domain", "suffix", F.col("n").alias("n_domain"), shrink(F.col("m_suffix"), F.lit(by_domain)).alias("m_domain"))
    hosts = hosts.join(domains.drop("suffix"), "domain")
    by_host = hosts.agg(_strength(hosts, F.col("m_domain"), setting.max_strength).alias("s")).first().s

    def level(rows: DataFrame, kind: str, name: str, parent: Column, n: str, k: Column, own: Column, prior: str, strength: float) -> DataFrame:
        a, b = k + F.lit(strength) * F.col(prior), own - k + F.lit(strength) * (1 - F.col(prior))
        share = a / (a + b)
        upper = share + setting.z * F.sqrt(share * (1 - share) / (a + b + 1))
        return rows.select(F.lit(kind).alias("level"), F.col(name).alias("name"), parent.alias("parent"), n, share.alias("mean"), upper.alias("upper"))

    none = F.lit(0)
    return (
        level(hosts, "host", "host", F.col("domain"), "n", F.col("k"), F.col("n"), "m_domain", by_host)
        .unionAll(level(domains, "domain", "domain", F.col("suffix"), "n_domain", none, none, "m_domain", by_host))
        .unionAll(level(suffixes, "suffix", "suffix", F.lit(None).cast("string"), "n_suffix", none, none, "m_suffix", by_domain))
    )


def verdicts(known: DataFrame, least_good: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host, host_bad), (domain, domain_bad), (suffix, suffix_bad): hosts and domains whose verdict differs from their
    domain's and suffix's, and all suffixes."""
    judged = known.select("level", "name", "parent", (F.col("upper") < least_good).alias("bad"))
    of = lambda kind: judged.filter(F.col("level") == kind)
    suffixes = of("suffix").select(F.col("name").alias("suffix"), F.col("bad").alias("suffix_bad"))
    domains = of("domain").select(F.col("name").alias("domain"), F.col("parent").alias("suffix"), F.col("bad").alias("domain_bad"))
    hosts = of("host").select(F.col("name").alias("host"), F.col("parent").alias("domain"), F.col("bad").alias("host_bad"))
    return (
        hosts.join(domains.drop("suffix"), "domain").filter("host_bad <> domain_bad").select("host", "host_bad"),
        domains.join(suffixes, "suffix").filter("domain_bad <> suffix_bad").select("domain", "domain_bad"),
        suffixes,
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    setting: Reputation = Reputation(),
    *,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Every page with its host, path, the rule that fits and the verdict `allow` or `block`.

    pages (id, url); outcomes (id, good): labels of some pages. A null url or one without `://` has an
    empty host and path; without a host it has no reputation and is allowed. A host without labels has the verdict of its domain's prior, else of its suffix's; one whose
    suffix has no labels is allowed. Repeated pages keep a row each; a page
    that has several labels counts once for each. Other columns of `pages` are not read, whatever
    their names.
    """
    split = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    labelled = outcomes.select(F.col(id_col).alias("page_id"), F.col("good"))
    known = written(reputation(split.select("page_id", "host").join(labelled, "page_id").select("host", "good"), setting), "known")
    # written, so that their sizes are known and, should one be large, Spark can split the rows of a hot host
    hosts, domains, suffixes = (written(x, "verdicts") for x in verdicts(known, setting.least_good))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        split.withColumns({"fit": fit, "domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
        .join(hosts, "host", "left")
        .join(domains, "domain", "left")
        .join(suffixes, "suffix", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce(
                F.col("fit.verdict"),
                F.when(F.coalesce("host_bad", "domain_bad", "suffix_bad"), "block").otherwise("allow"),
            ).alias("verdict"),
        )
    )
