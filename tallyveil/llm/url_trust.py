"""URL filters: explicit rules first, then trust and distrust that spread over the links between hosts.

Trust is personalised PageRank from hosts with allowed pages along links; distrust is the same from hosts with blocked pages
against the links. Both run in one table keyed by (direction, host): an iteration is one join with the edges and one
pre-aggregated sum. Scores are sums of ever longer walks from the seeds, so they only grow, and the growth of their total is
the whole change; iterations end when it is at most TOLERANCE. What ends at a host without onward links goes back to the
seeds, which is the same as scaling the scores of a direction to the sum 1 at the end. Edges are host pairs with the number of pages that link, counted before any iteration, so copies of a
link cost nothing later. A host is blocked when its distrust is at least MARGIN times its trust, and more than the noise
floor of FLOOR times the mean share of a host.

Nulls: a null url or one without `://` has empty host and path, which no rule fits; its verdict comes from the scores of
the empty host, which has none: allow. A null html links nowhere. Repeated rows count as pages of their own. Where distrust
equals trust (MARGIN 1) the host is blocked. An empty table, or one without seeds, has no scores. Html of any length is
searched whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import discard, saved

DAMPING = 0.85
TOLERANCE = 1e-5  # growth of all scores of a direction, whose sum is 1 at most, that ends the iterations
SAVE_EVERY = 6  # iterations between written tables
MARGIN = 1.0
FLOOR = 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host_ == name) | F.endswith(host_, F.lit(f".{name}"))) & F.startswith(path_, F.lit(prefix))
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def link_host(link: Column, own: Column) -> Column:
    """The host a link leads to: its own for relative links, null for what is no page (mail, script, place in the page)."""
    return (F.when(link.contains("://"), host(link)).when(F.startswith(link, F.lit("//")), host(F.concat(F.lit("x:"), link)))
            .when(F.startswith(link, F.lit("#")) | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).otherwise(own))


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, pages: how many pages of a host link to a host. Links inside a host count, they keep its score there."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    found = pages.select(F.col("host").alias("source"), F.explode(F.array_distinct(F.transform(links, lambda x: link_host(x, F.col("host"))))).alias("target"))
    return found.where("source <> '' AND target <> ''").groupBy("source", "target").agg(F.count("*").alias("pages"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust. `seeds` has host, allowed, blocked (numbers of pages); each kind of seed shares one unit."""
    both = edges.select(F.lit(0).alias("way"), F.col("source").alias("at"), F.col("target").alias("to"), "pages").union(
        edges.select(F.lit(1).alias("way"), F.col("target").alias("at"), F.col("source").alias("to"), "pages"))
    out = both.groupBy("way", "at").agg(F.sum("pages").alias("all"))
    flow = saved(both.join(out, ["way", "at"]).select("way", "at", "to", (F.col("pages") / F.col("all") * DAMPING).alias("part")), "host-edges")
    sums = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    start = saved(seeds.where("allowed > 0").select(F.lit(0).alias("way"), F.col("host").alias("at"), (F.col("allowed") / F.lit(float(sums["a"] or 1)) * (1 - DAMPING)).alias("score")).union(
        seeds.where("blocked > 0").select(F.lit(1).alias("way"), F.col("host").alias("at"), (F.col("blocked") / F.lit(float(sums["b"] or 1)) * (1 - DAMPING)).alias("score"))), "seeds")
    rank, before = start, None
    while True:
        totals = {r["way"]: r["total"] for r in rank.groupBy("way").agg(F.sum("score").alias("total")).collect()}
        if before is not None and max((totals[w] - before[w] for w in totals), default=0.0) <= tolerance:
            break
        before, last = totals, rank
        for _ in range(SAVE_EVERY):
            moved = rank.join(flow, ["way", "at"]).select("way", F.col("to").alias("at"), (F.col("score") * F.col("part")).alias("score"))
            rank = moved.union(start).groupBy("way", "at").agg(F.sum("score").alias("score"))
        rank = saved(rank, "host-scores")
        if last is not start:
            discard(last)
    of = lambda way: F.sum(F.when(F.col("way") == way, F.col("score") / F.lit(float(totals.get(way) or 1))).otherwise(0.0))
    return rank.groupBy(F.col("at").alias("host")).agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    placed = pages.select("page_id", h.alias("host"), p.alias("path"), "html").withColumn("rule", rule).withColumn("__says", verdict)
    edges = saved(host_edges(placed), "host-links")
    seeds = saved(placed.groupBy("host").agg(F.count_if(F.col("__says") == "allow").alias("allowed"), F.count_if(F.col("__says") == "block").alias("blocked")), "host-seeds")
    hosts = max(1, seeds.count())
    scores = saved(spread(edges, seeds, tolerance), "host-scores")
    bad = (F.col("distrust") >= MARGIN * F.col("trust")) & (F.col("distrust") > F.lit(FLOOR / hosts))
    judged = scores.select(F.col("host").alias("__host"), "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("__method"))
    joined = placed.drop("html").join(judged, F.col("host") == F.col("__host"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("__says", "__method", F.lit("allow")).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
