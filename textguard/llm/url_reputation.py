"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. Beta-binomial priors pass from the suffix to the
registered domain to the host: each level is shrunk towards its parent's mean, with a strength
estimated by the method of moments over all groups of that level. A page is blocked when the
lower posterior bound of its host's bad rate is above a limit, the mean rate of all labelled pages
unless one is given: a host is blocked only when it is proven worse than the corpus, so hosts
without evidence stay, however high that mean is.

Defined results: a null url or one without ``://`` has an empty host and path; hosts without
labelled pages get their parent's mean; repeated page ids are judged row by row and their outcomes
are pooled; an empty table gives no rows; columns other than the named ones are not carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. Rules are few: one CASE, no join."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is None else (text, verdict)


def _strength(groups: DataFrame, least: float, most: float) -> float:
    """Prior strength s of a level, from E (x - nm)^2 = nm(1-m)(1 + (n-1)/(s+1)) summed over its groups."""
    v = F.col("m") * (1 - F.col("m"))
    row = groups.where("n > 0").agg(
        F.sum((F.col("x") - F.col("n") * F.col("m")) ** 2).alias("s"),
        F.sum(F.col("n") * v).alias("a"),
        F.sum(F.col("n") * (F.col("n") - 1) * v).alias("b"),
    ).first()
    if not row["b"]:
        return most
    rho = min(max((row["s"] - row["a"]) / row["b"], 1 / (most + 1)), 1 / (least + 1))
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """``hosts`` has host, n (labelled pages) and x (bad ones); returns host, alpha, beta and the mean of all pages."""
    hosts = stored(
        hosts.select("host", "n", "x", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix")),
        "hosts",
    )
    n, x = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("x"), F.lit(0))).first()
    parents, above = None, (x + 1) / (n + 2)
    for level in LEVELS:
        keys = LEVELS[: LEVELS.index(level) + 1]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        if parents is None:
            groups = groups.withColumn("m", F.lit(float(above)))
        else:
            groups = groups.join(parents, list(keys[:-1]), "left")
        s = _strength(groups, least, most)
        alpha, beta = F.col("x") + s * F.col("m"), F.col("n") - F.col("x") + s * (1 - F.col("m"))
        groups = groups.select(*keys, alpha.alias("alpha"), beta.alias("beta"))
        parents = groups.select(*keys, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m"))
    return groups.select("host", "alpha", "beta", F.lit(float((x + 1) / (n + 2))).alias("mean"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], page_col: str = "page_id", url_col: str = "url",
               z: float = 1.645, limit: float | None = None) -> DataFrame:
    """Verdict per page row. ``outcomes`` has (page, bad): bad 1 for a bad page, 0 for a good one.

    Returns ``page_col``, host, path, rule, verdict, bad_rate (posterior mean), bound (lower bound).
    A hot host is one row of the reputation table; adaptive execution splits its pages in the join.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(page_col).alias("page"), host.alias("host"), path.alias("path"))
    seen = outcomes.where("bad is not null").groupBy("page").agg(F.count("*").alias("n"), F.sum("bad").alias("x"))
    hosts = urls.join(seen, "page", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")
    )
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    bound = mean - z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    judged = urls.join(host_reputation(hosts).select("host", mean.alias("bad_rate"), bound.alias("bound"), F.col("mean") if limit is None else F.lit(limit).alias("mean")), "host", "left")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("bound") > F.col("mean"), "block").otherwise("allow"))
    return judged.select(F.col("page").alias(page_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_rate", "bound")
