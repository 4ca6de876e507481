"""URL rules, and for what they leave open personalised PageRank over the host graph.

Rules ``(allow|block, host/path)`` fit a host and all its subdomains if the url's
path starts with the rule's; the longest fitting rule decides.  Pages that rules
allow make their host a trusted seed, pages that rules block make it a distrusted
one.  Trust flows along the edges (a linked host is vouched for), distrust flows
against them (linking to a bad host is telling).  A host is blocked where its
distrust, as a share of all distrust, times ``bias`` exceeds its share of trust.

Edges: links with a host in the page's html, one per page and target, weighted by
the pages that hold them; and, as sites share their owner, one between a host
and each of its parent domains among the hosts seen.  Links within a host say nothing.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and the verdict of a host without mass; null html has no links; repeated rows
are judged alike and add to the seeds; ties of trust and distrust allow; an empty
table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import stored

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Summed distance of either mass from its limit at which the power steps end, and the steps between two looks at it.
TOLERANCE = 1e-6
STEPS = 8
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest fitting rule, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w) from ``pages(host, html)`` and the hosts seen."""
    links = (pages.where("html is not null")
             .select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
             .select("host", F.translate("dst", _UP, _LOW).alias("dst")).where("host <> '' and dst <> host")
             .groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("w")))
    labels = F.split("host", r"\.")
    parents = (hosts.where("host <> ''").select(F.col("host").alias("child"), labels.alias("l"))
               .where("size(l) > 2")
               .select("child", F.explode(F.expr("transform(sequence(2, size(l) - 1), i -> array_join(slice(l, i, size(l)), '.'))")).alias("host"))
               .join(hosts.select("host"), "host"))
    ties = parents.select(F.col("host").alias("src"), F.col("child").alias("dst")).unionByName(
        parents.select(F.col("child").alias("src"), F.col("host").alias("dst"))).withColumn("w", F.lit(1.0))
    return links.unionByName(ties).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank; ``seeds``: (host, trusted, blocked) page counts.

    Both directions run in one pass, as rows of kind +1 (trust, along the edges)
    and -1 (distrust, against them).  Mass at a host without edges stays with the
    host's own seed share: it ends there.  Without ``rounds`` the steps go on until the
    limit is within TOLERANCE: each shortens the distance by ``damping``, which is below 1.
    """
    both = edges.select(F.lit(1).alias("kind"), "src", "dst", "w").unionByName(
        edges.select(F.lit(-1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out_of = both.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    steps = stored(both.join(out_of, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("w") / F.col("total")).alias("p")), "steps")
    start = seeds.select("host", F.expr("stack(2, 1, cast(trusted as double), -1, cast(blocked as double)) as (kind, mass)")).where("mass > 0")
    sums = start.groupBy("kind").agg(F.sum("mass").alias("all"))  # two rows
    start = stored(start.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass")), "seeds")
    kept = start.select("kind", "host", (F.lit(1.0 - damping) * F.col("mass")).alias("mass"))

    def moved(now: DataFrame, times: int) -> DataFrame:
        for _ in range(times):
            there = now.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("p")).alias("mass"))
            now = there.unionByName(kept).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        return now

    now, linked = start, not steps.isEmpty()
    if linked and rounds is not None:
        now = moved(now, rounds)
    short = damping ** STEPS
    while linked and rounds is None:
        before, now = now, stored(moved(now, STEPS), "mass")
        change = now.unionByName(before.withColumn("mass", -F.col("mass"))).groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("x")).groupBy("kind").agg(F.sum("x").alias("x")).agg(F.max("x")).first()[0]
        if (change or 0.0) * short / (1 - short) <= TOLERANCE:
            break
    return now.groupBy("host").agg(F.sum(F.when(F.col("kind") == 1, F.col("mass")).otherwise(0.0)).alias("trust"),
                                   F.sum(F.when(F.col("kind") == -1, F.col("mass")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url",
          html: str = "html", bias: float = 1.0, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust."""
    seen = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    seen = seen.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = stored(seen.groupBy("host").agg(F.count_if(F.col("hit.verdict") == "allow").alias("trusted"), F.count_if(F.col("hit.verdict") == "block").alias("blocked")), "hosts")
    edges = stored(host_edges(seen.select("host", "html"), seeds), "edges")
    ranks = propagate(edges, seeds.where("host <> ''"), rounds, damping)
    ranks = stored(ranks.withColumn("bad", F.col("distrust") * bias > F.col("trust")).withColumnRenamed("host", "_host"), "ranks")
    return (seen.drop("html").join(ranks, F.col("host") == F.col("_host"), "left")
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce(F.col("hit.verdict"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLES: dict[str, str] = {}
