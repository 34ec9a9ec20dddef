"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk through beta-binomial priors along
suffix -> registered domain -> host.  The prior strength of each level is estimated from the data
by moments of the over-dispersion between its groups.  A host is blocked when the lower bound of
its posterior bad rate exceeds ``limit``: few or mixed outcomes never block.

Native: DataFrame functions only.  Labels are counted per host before anything is joined, so a host
with a third of all pages is one row of the reputation table.  Hosts without any labelled outcome take
the bound that the same expression gives for no outcomes of their own from their domain's mean, or
else their suffix's.  Levels meet per host, not per page; the join back is an equi-join on host whose
page side adaptive execution can split.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the
method's verdict on the empty host; null labels are no outcomes; repeated rows count each time;
without any labels everything is allowed by the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr", "edu.au", "edu.cn", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
LIMIT, Z = 0.5, 1.645
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def host_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), host).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), host).when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.  The rules are a parameter, so bounded."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def with_parts(pages: DataFrame, url: str, p: str, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    pages = pages.withColumns({p + "host": host_of(F.col(url)), p + "path": path_of(F.col(url))})
    return pages.withColumns({p + "domain": domain_of(F.col(p + "host"), suffixes), p + "suffix": suffix_of(F.col(p + "host"), suffixes)})


def strength(groups: DataFrame, n: str, bad: str) -> DataFrame:
    """One row (mean, strength): the beta prior that the over-dispersion between groups calls for."""
    s = groups.agg(F.sum(n).cast("double").alias("n"), F.sum(bad).cast("double").alias("b"), F.sum(F.col(n).cast("double") * F.col(n)).alias("n2"), F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n)).alias("b2"), F.count(F.lit(1)).cast("double").alias("g"))
    mean = F.when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(0.0)
    within = F.col("m") * (1 - F.col("m"))
    base = F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1)
    rho = (F.col("b2") - F.col("n") * F.col("m") * F.col("m") - (F.col("g") - 1) * within) / (within * base)
    ok = (F.col("n") > 0) & (within > 0) & (base > 0)
    k = F.when(ok & (rho > 0), F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MOST_STRENGTH))
    return s.withColumn("m", mean).select(F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce(k, F.lit(MOST_STRENGTH)).alias("strength"))


def posterior(n: Column, bad: Column, prior: Column, k: Column, z: float) -> list[Column]:
    """posterior mean and bound of a beta prior of mean ``prior`` and strength ``k`` after n outcomes."""
    a, c = bad + k * prior, n - bad + k * (1 - prior)
    total = a + c
    mean = a / total
    return [mean.alias("posterior"), (mean - z * F.sqrt(a * c / (total * total * (total + 1)))).alias("bound")]


def reputation(labelled: DataFrame, z: float = Z) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posterior and bound per host with outcomes, and those of a host without any per domain and per suffix.

    labelled: (host, domain, suffix, bad) with one row per outcome, bad 0 or 1.
    """
    hosts = labelled.where(F.col("bad").isNotNull()).groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    ks = strength(suffixes, "sn", "sb").select(F.col("mean").alias("g_mean"), F.col("strength").alias("s_k"))
    kd = strength(domains, "dn", "db").select(F.col("strength").alias("d_k"))
    kh = strength(hosts, "n", "b").select(F.col("strength").alias("h_k"))
    levels = F.broadcast(ks.crossJoin(kd).crossJoin(kh))  # one row
    s_mean = (F.col("sb") + F.col("s_k") * F.col("g_mean")) / (F.col("sn") + F.col("s_k"))
    d_mean = (F.col("db") + F.col("d_k") * F.col("s_mean")) / (F.col("dn") + F.col("d_k"))
    of_suffix = suffixes.crossJoin(levels).withColumn("s_mean", s_mean)
    of_domain = domains.join(of_suffix, ["suffix"]).withColumn("d_mean", d_mean)
    of_host = hosts.join(of_domain.select("suffix", "domain", "d_mean", "h_k"), ["suffix", "domain"])
    none, k = F.lit(0), F.col("h_k")
    return (
        of_host.select("host", "n", F.col("b").alias("bad"), F.col("d_mean").alias("prior"), *posterior(F.col("n"), F.col("b"), F.col("d_mean"), k, z)),
        of_domain.select("domain", *posterior(none, none, F.col("d_mean"), k, z)),
        of_suffix.select("suffix", *posterior(none, none, F.col("s_mean"), k, z)),
    )


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", bad: str = "bad", *, rules=RULES, suffixes=TWO_LABEL_SUFFIXES, limit: float = LIMIT, z: float = Z, prefix: str = "") -> DataFrame:
    """``pages`` with host, path, rule, posterior, bound and verdict (named with ``prefix``).

    suffixes: the public suffixes of two labels (one label is a suffix anyhow); pass a full list for wide crawls.
    outcomes: (key, bad) labels of pages.  A host without outcomes has the posterior bound of its
    domain, or else its suffix; without outcomes there either it has none and is allowed.  Labels
    meet only the url's parts of labelled pages, never the page bodies.
    """
    p = "__url_"
    parts = with_parts(pages.select(F.col(key).alias(p + "key"), F.col(url).alias(p + "url")), p + "url", p, suffixes)
    named = outcomes.where(F.col(bad).isNotNull()).select(F.col(key).alias(p + "key"), F.col(bad).cast("long").alias("bad"))
    places = [F.col(p + c).alias(c) for c in ("host", "domain", "suffix")]
    labelled = parts.join(named, p + "key").select(*places, "bad")
    known = parts.select(*places).distinct()
    for level, table in zip(("host", "domain", "suffix"), reputation(labelled, z)):
        known = known.join(table.select(level, F.struct("posterior", "bound").alias(p + level)), level, "left")
    best = F.coalesce(*[F.col(p + c) for c in ("host", "domain", "suffix")])
    known = known.select(F.col("host").alias(p + "known"), best["posterior"].alias(p + "posterior"), best["bound"].alias(p + "bound"))
    own = pages.columns
    full = pages.withColumns({p + "host": host_of(F.col(url)), p + "path": path_of(F.col(url))})
    rule, said = rule_for(F.col(p + "host"), F.col(p + "path"), rules)
    method = F.when(F.col(p + "bound") > limit, "block").otherwise("allow")
    joined = full.join(known, F.col(p + "host") == F.col(p + "known"), "left")
    return joined.select(*own, F.col(p + "host").alias(prefix + "host"), F.col(p + "path").alias(prefix + "path"), rule.alias(prefix + "rule"), F.col(p + "posterior").alias(prefix + "posterior"), F.col(p + "bound").alias(prefix + "bound"), F.coalesce(said, method).alias(prefix + "verdict"))


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("bad", T.LongType())])
