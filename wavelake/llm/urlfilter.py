"""URL filter: rules first, then trust and distrust over the graph of hosts.

A rule ``(host, path, verdict)`` fits its host and all subdomains if the url's path
starts with the rule's; the longest rule (host and path together) wins, of equally long ones that with the
longer host, and of one rule given with both verdicts ``block``.  Urls without a rule get their
host's verdict: personalised PageRank spreads trust from trusted seeds along links,
and distrust from blocked seeds against them (who links to a blocked host becomes
suspect).  Seeds are the hosts of which the rules judge more than half of the
pages one way.  A host is blocked when its distrust is more than ``threshold`` of
trust and distrust together; hosts that neither reaches are allowed.

Rules are a table of any size: a url's host suffixes meet the hosts of the rules, and
the prefixes of its path, in the lengths that rules of such a host have, meet the rules, both in
hash joins.  Links are counted per pair of hosts before they are shuffled, so a host with a
third of all pages is a few rows a task; ranks are written tables after each round.  Rounds
go on until all ranks together change by less than ``tolerance`` (with damping 0.85 and
1e-6 that takes at most 97 rounds); if ``max_rounds`` don't suffice, an error is raised.

Edge cases: a null url, or one without ``://``, has an empty host and path and no
rule, and joins no graph; null html has no links; links without a scheme (``//host``) count; very long
pages and urls are read whole; repeated rows add to the counts; an
empty table gives an empty result, an empty rule table judges nothing; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.llm.storage import materialize, scratch

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rules`` as a table ``(r_host, r_path, r_verdict)``, one row per host and path."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    return rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(j_host, j_path, rule, ruled)`` of the distinct ``urls (host, path)`` that a rule fits."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    tried = urls.groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path", F.explode(suffixes).alias("r_host"))
    tried = tried.join(lengths, "r_host").select("host", "path", "r_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    fits = tried.withColumn("r_path", F.substr("path", F.lit(1), F.col("n"))).join(rules, ["r_host", "r_path"])
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), "r_verdict")).alias("best")
    return fits.groupBy(F.col("host").alias("j_host"), F.col("path").alias("j_path")).agg(best).select("j_host", "j_path", "best.rule", F.col("best.r_verdict").alias("ruled"))


def _rank(edges: DataFrame, seeds: DataFrame, name: str, damping: float, max_rounds: int, tolerance: float) -> DataFrame:
    """``(host, score)``: personalised PageRank along ``edges (src, dst, n)``."""
    start = materialize(seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("score")), f"{name}_start")
    if edges.isEmpty():
        return start
    total = edges.groupBy(F.col("src").alias("from")).agg(F.sum("n").alias("out"))
    parts = materialize(edges.join(total, F.col("src") == F.col("from")).select("src", "dst", (F.col("n") / F.col("out")).alias("part")), f"{name}_parts")
    score = start
    for k in range(max_rounds):
        moved = score.join(parts, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("part")).alias("score"), F.lit(0.0).alias("old"))
        rest = start.select("host", "score", F.lit(0.0).alias("old")).union(score.select("host", F.lit(0.0), "score"))
        new = materialize(moved.union(rest).groupBy("host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")), f"{name}_{k + 1}")
        score = new.select("host", "score")
        if (new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0) < tolerance:
            return score
    raise RuntimeError(f"{name} still changes by {tolerance} or more after {max_rounds} rounds")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]] = RULES,
    threshold: float = 0.5,
    damping: float = 0.85,
    max_rounds: int = 300,
    tolerance: float = 1e-6,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, trust, distrust``."""
    with scratch(pages.sparkSession) as keep:
        urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        found = keep(judge(urls.where(F.col("host") != ""), rule_table(pages, rules)), "ruled")
        judged = urls.join(found, (F.col("host") == F.col("j_host")) & (F.col("path") == F.col("j_path")), "left").drop("j_host", "j_path")
        count = lambda v: F.count(F.when(F.col("ruled") == v, 1))
        hosts = judged.where(F.col("host") != "").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
        hosts = materialize(hosts, "hosts")

        links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^\"'\s>]+)"), F.lit(1))
        edges = pages.select(url_host(F.col("url")).alias("src"), F.explode(links).alias("link"))
        edges = edges.select("src", url_host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
        edges = edges.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        edges = materialize(edges, "host_links")

        def seeds(which: str) -> DataFrame:
            chosen = hosts.where(2 * F.col(which) > F.col("pages"))
            number = chosen.count()
            return chosen.select("host", F.lit(1.0 / max(1, number)).alias("seed"))

        trust = _rank(edges, seeds("allowed"), "trust", damping, max_rounds, tolerance)
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        distrust = _rank(back, seeds("blocked"), "distrust", damping, max_rounds, tolerance)
        scored = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), F.col("score")))
        scored = scored.groupBy(F.col("host").alias("scored_host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        scored = keep(scored, "host_scores")

    out = judged.join(scored, F.col("host") == F.col("scored_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust > 0) & (distrust > F.lit(threshold) * (trust + distrust))
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
