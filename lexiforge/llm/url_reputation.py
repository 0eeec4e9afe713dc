"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (good or not) are counted by host, registered domain and
public suffix. Each level is a beta-binomial whose prior mean is the shrunk
rate of the level above and whose strength comes from the data: with rates
``p`` of groups of ``n`` outcomes around prior means ``q``, the expected value
of ``n (p - q)^2 / (q (1 - q))`` is ``1 + rho (n - 1)``, which gives the
intra-class correlation ``rho`` and the strength ``1 / rho - 1``. A host is
blocked when even the upper bound of its posterior rate is below ``least``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]  # verdict, host/path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    parts = r"^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, parts, 1), UPPER, LOWER), F.regexp_extract(rest, parts, 2)


def domain_suffix(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix: the last label, or the longest of ``suffixes`` (like ``co.uk``)."""
    suffix = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(suffix)
    dots = F.length(suffix) - F.length(F.replace(suffix, F.lit("."))) + 2
    return F.call_function("substring_index", host, F.lit("."), -dots), suffix


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``size``, ``rule`` and ``verdict``; null without one."""
    fits = []
    for verdict, text in rules:
        h, slash, p = text.partition("/")
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fits.append(F.when(fit, F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"),
                                         F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def _shrink(groups: DataFrame, prior: Column, strongest: float, z: float) -> DataFrame:
    """``groups`` (n, good) with ``rate`` (posterior mean), ``low`` and ``high`` under the prior mean ``prior``."""
    g = groups.withColumn("q", F.least(F.greatest(prior, F.lit(1e-3)), F.lit(1 - 1e-3)))
    gap = F.col("good") / F.col("n") - F.col("q")
    chi = F.sum(F.when(F.col("n") > 0, F.col("n") * gap * gap / (F.col("q") * (1 - F.col("q")))))
    rho = (chi - F.count(F.when(F.col("n") > 0, 1))) / F.sum(F.when(F.col("n") > 0, F.col("n") - 1))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1 / (strongest + 1))), F.lit(0.5))
    strength = g.agg(rho.alias("rho")).select(1 / F.col("rho") - 1).scalar()
    g = g.withColumn("s", strength)
    a = F.col("good") + F.col("q") * F.col("s")
    total = F.col("n") + F.col("s")
    spread = z * F.sqrt(a * (total - a) / (total * total * (total + 1)))
    return (g.withColumn("rate", a / total).withColumn("low", F.greatest(a / total - spread, F.lit(0.0)))
            .withColumn("high", F.least(a / total + spread, F.lit(1.0))).drop("q", "s"))


def host_reputation(outcomes: DataFrame, url_col: str = "url", good_col: str = "good", suffixes: Sequence[str] = (),
                    strongest: float = 1000.0, z: float = 1.645) -> DataFrame:
    """One row per host of ``outcomes``: ``host, domain, suffix, n, good, rate, low, high``.

    ``good_col`` is 1 (good), 0 (not) or null (no label: the row only names its
    host). Repeated rows are separate outcomes. Without any label all rates are
    one half; an empty input gives no rows. Strength is at most ``strongest``.
    """
    host, _ = host_path(F.col(f"`{url_col}`"))
    good = F.col(f"`{good_col}`").cast("int")
    hosts = (outcomes.select(host.alias("host"), good.alias("y")).groupBy("host")
             .agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")))
    domain, suffix = domain_suffix(F.col("host"), suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    overall = hosts.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(0.5)).alias("m")).scalar()
    by_suffix = _shrink(hosts.groupBy("suffix").agg(*sums), overall, strongest, z)
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(
        by_suffix.select("suffix", F.col("rate").alias("above")), "suffix")
    by_domain = _shrink(domains, F.col("above"), strongest, z)
    found = hosts.join(by_domain.select("domain", "suffix", F.col("rate").alias("above")), ["domain", "suffix"])
    return _shrink(found, F.col("above"), strongest, z).select(
        "host", "domain", "suffix", "n", "good", "rate", "low", "high")


def judge_urls(pages: DataFrame, reputation: DataFrame, rules: Sequence[Rule] = (), least: float = 0.5,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, high`` of every page.

    A rule decides where one fits, else the reputation; hosts that
    ``reputation`` does not have are allowed. Null ids stay null, repeated rows
    get a row each, an empty table gives no rows.
    """
    host, path = host_path(F.col(f"`{url_col}`"))
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    p = p.join(reputation.select("host", "rate", "high"), "host", "left")
    earned = F.when(F.col("high") < least, "block").otherwise("allow")
    return p.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", earned).alias("verdict"), "rate", "high")
