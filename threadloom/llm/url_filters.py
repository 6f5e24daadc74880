"""URL filters: rules on host and path, and verdicts that links carry from host to host.

A rule judges the pages it fits. Hosts of which rules allow, or block, more than half of the
pages are the seeds. Trust starts at the allowed seeds and follows links (personalised
PageRank); distrust starts at the blocked seeds and follows links backwards, to the hosts that
link there. A host is blocked where its distrust exceeds its trust and a share of the mean
rank of all hosts; its pages without a rule take its verdict.

Links are the ``a`` elements whose target names a host; relative ones stay on their host and
carry nothing. Scores are a table of hosts, written to the shared folder every round. A host
with very many links sends its score in pieces.

A null url or one without ``://`` has an empty host and path and is allowed, unless a rule
fits. Null or empty html has no links; of repeated rows each counts and is returned. An empty table gives
an empty one. Columns of the input stay, but for those that have a result's name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, joined_by_weight, stored

DAMPING = 0.85
#: Rounds end when the scores of all hosts together change by less.
TOLERANCE = 1e-4
MAX_ROUNDS = 60
#: A host is blocked only where its distrust reaches this share of the mean rank.
FLOOR = 0.1
#: Links of a host that are sent from one row.
PIECE = 100_000
RESULTS = ["host", "path", "rule", "verdict", "trust", "distrust"]

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*+=\s*+["']?\s*+(?:https?:)?//([^/?#"'\s<>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, the first of equally long ones, or null.

    Rules become one expression, so this is for lists of some hundred.
    """
    found = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): how often pages of one host link to another."""
    targets = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
    found = found.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> dst and src <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, piece: int = PIECE,
               tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(host, trust, distrust) of all hosts of ``links`` and of ``seeds`` (host, trusted, blocked).

    Each score is a personalised PageRank: its seeds hold equal shares of one, and what hosts
    without links receive starts anew at the seeds. Without seeds a score is nought throughout.
    """
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("taker"), "links")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("taker"), "links")
    flows = forward.unionByName(back)
    givers = stored(flows.groupBy("kind", "giver").agg(
        F.sum("links").alias("all_links"), F.ceil(F.count("*") / piece).cast("int").alias("pieces")), "givers")
    parts = F.pmod(F.xxhash64("taker"), F.col("pieces")).cast("int")
    flows = stored(flows.join(givers, ["kind", "giver"]).select(
        "kind", "giver", "taker", parts.alias("part"), (F.col("links") / F.col("all_links")).alias("share")), "flows")

    named = seeds.select("host", F.col("trusted").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust"))
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = linked.join(named, "host", "full_outer").fillna(0.0, ["trust", "distrust"])
    long = hosts.unpivot("host", ["trust", "distrust"], "kind", "seed")
    sums = {r["kind"]: r["s"] for r in long.groupBy("kind").agg(F.sum("seed").alias("s")).collect()}
    norm = F.when(F.col("kind") == "trust", sums.get("trust") or 1.0).otherwise(sums.get("distrust") or 1.0)
    pieces = givers.select("kind", F.col("giver").alias("host"), "pieces")
    state = stored(long.withColumn("seed", F.col("seed") / norm).join(pieces, ["kind", "host"], "left").select(
        "kind", "host", "seed", "pieces", F.col("seed").alias("score")), "ranks")

    for _ in range(max_rounds):
        given = state.filter("pieces is not null and score > 0").select(
            "kind", F.col("host").alias("giver"), "score", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"))
        taken = flows.join(given, ["kind", "giver", "part"]).groupBy("kind", F.col("taker").alias("host")).agg(
            F.sum(F.col("score") * F.col("share")).alias("taken"))
        state = stored(state.join(taken, ["kind", "host"], "left").fillna(0.0, ["taken"]), "ranks")
        moved = {r["kind"]: r["s"] for r in state.groupBy("kind").agg(F.sum("taken").alias("s")).collect()}
        anew = F.when(F.col("kind") == "trust", 1 - damping * moved.get("trust", 0.0)).otherwise(
            1 - damping * moved.get("distrust", 0.0))
        score = damping * F.col("taken") + anew * F.col("seed")
        state = state.withColumn("before", F.col("score")).withColumn("score", score).drop("taken")
        change = state.agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("c")).first()["c"]
        state = state.drop("before")
        if not change or change < tolerance:
            break
    scores = [F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust")]
    return state.groupBy("host").agg(*scores)


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html",
           floor: float = FLOOR) -> DataFrame:
    """``pages`` with ``RESULTS``; ``rule`` is the text of the rule that decides, or null."""
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    own = fresh(pages, "own")
    parted = pages.withColumns({own: F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))})
    host, path = F.col(f"{own}.host"), F.col(f"{own}.path")
    known = parted.select(
        *kept, host.alias("host"), path.alias("path"),
        matching(rules, host, path, lambda r: r.text).alias("rule"),
        matching(rules, host, path, lambda r: r.verdict).alias("verdict"),
    )

    def of(verdict: str) -> Column:
        return F.count(F.when(F.col("verdict") == verdict, 1))

    hosts = stored(known.groupBy("host").agg(
        F.count("*").alias("many"), of("allow").alias("allowed"), of("block").alias("barred")), "hosts")
    seeds = hosts.filter("host <> ''").select(
        "host", (F.col("allowed") * 2 > F.col("many")).cast("int").alias("trusted"),
        (F.col("barred") * 2 > F.col("many")).cast("int").alias("blocked"))
    scores = stored(propagated(stored(host_links(pages, url, html), "links"), seeds), "scores")
    mean = 1.0 / max(scores.count(), 1)
    lookup = hosts.select("host", "many").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    weight = fresh(known, "many")
    joined = joined_by_weight(known, lookup.withColumnRenamed("many", weight), "host", weight)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= floor * mean)
    verdict = F.coalesce(F.col("verdict"), F.when(bad, "block").otherwise("allow"))
    return joined.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
