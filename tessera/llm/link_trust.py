"""URL filters: rules, and for the rest trust and distrust that spread over links between hosts.

Rules name a host with its subdomains and the start of a path; the longest rule that fits a
page decides. Hosts of pages that a rule allows are trusted seeds, hosts of pages that a rule
blocks are distrusted ones, each by the share of its rule-decided pages. Personalised PageRank
spreads trust along links and distrust against them (who links to a blocked host is suspect).
All scores of a kind sum to one, and what further rounds can still move shrinks with each round, so
rounds go on until that is less than `RESIDUAL`, at most log(RESIDUAL) / log(damping) rounds whatever
the graph. A host is blocked when its distrust exceeds `ratio` times its trust, and `FLOOR`: less
distrust than that, as of a host some 120 links behind a blocked one, counts as none. Hosts that
distrust does not reach are allowed.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule
and is allowed; null html has no links; links within a host and relative links count for
nothing; repeated pages count again as links but not as further seeds; a walk ends at a host
without outgoing links. Only page_id, url and html are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_space, stored, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

DAMPING, RATIO = 0.85, 1.0
#: What all scores of a kind together may still move, and the distrust that counts.
RESIDUAL, FLOOR = 1e-11, 1e-9
#: Targets from which a host's links are dealt over salts, and hosts of that kind up to which
#: they are broadcast (some megabytes; there are at most links / HUB of them).
HUB, SALTS, FEW_HUBS = 100_000, 64, 50_000
#: Rounds between two writes of the scores, which cut the lineage.
WRITE_EVERY = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "(?i)href\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]+)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def decide(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the longer host, then block."""
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(order):
        rule = F.when(fits(r, host, path), r.text).otherwise(rule)
        verdict = F.when(fits(r, host, path), r.verdict).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts, counted before they are shuffled on."""
    targets = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))
    rows = pages.where("host <> ''").select(F.col("host").alias("source"), targets.alias("target"))
    rows = rows.withColumn("target", F.translate("target", UPPER, LOWER))
    return rows.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def flows(edges: DataFrame) -> DataFrame:
    """(kind, source, target, share, salt, salts): trust follows links, distrust goes against them.

    The links of a host with very many targets are dealt over `SALTS` salts.
    """
    both = edges.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n")
    )
    # written, so that the join is between plain shuffles, which can be split
    total = stored(both.groupBy("kind", "source").agg(F.sum("n").alias("total"), F.count("*").alias("targets")), "out-links")
    salts = F.when(F.col("targets") > HUB, SALTS).otherwise(1)
    shares = both.join(total, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("total")).alias("share"), salts.alias("salts"))
    return shares.withColumn("salt", F.pmod(F.xxhash64("target"), F.col("salts")).cast("int"))


def seeds(judged: DataFrame) -> DataFrame:
    """(kind, host, seed): the shares of a host's rule-decided pages, each kind summing to one."""
    decided = judged.where("host <> '' AND decided IS NOT NULL").groupBy("host").agg(F.avg((F.col("decided") == "allow").cast("double")).alias("good"))
    both = decided.select(F.lit("trust").alias("kind"), "host", F.col("good").alias("seed")).unionByName(decided.select(F.lit("distrust").alias("kind"), "host", (1 - F.col("good")).alias("seed")))
    both = both.where("seed > 0")
    total = both.groupBy("kind").agg(F.sum("seed").alias("total"))
    return both.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed"))  # two rows at most


def propagate(start: DataFrame, flow: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """(kind, host, score): both PageRanks at once, until no kind's scores can move by more than the residual in all.

    A round moves the scores by at most `damping` times what the round before moved them by.
    """
    hubs = stored(flow.where("salts > 1").groupBy("kind", "source").agg(F.max("salts").alias("__salts")), "hubs")
    n_hubs = hubs.count()
    near = F.broadcast(hubs) if n_hubs <= FEW_HUBS else hubs

    def sent(scores: DataFrame) -> DataFrame:
        """The scores of sources, those of hubs once for each salt."""
        out = scores.withColumnRenamed("host", "source")
        if not n_hubs:
            return out.withColumn("salt", F.lit(0))
        out = out.join(near, ["kind", "source"], "left")
        return out.select("kind", "source", "score", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("salt"))

    restart = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("gain"))
    scores = written = start.select("kind", "host", F.col("seed").alias("score"))
    left = damping**WRITE_EVERY / (1 - damping**WRITE_EVERY)
    while True:
        for _ in range(WRITE_EVERY):
            moved = sent(scores).join(flow, ["kind", "source", "salt"]).select("kind", F.col("target").alias("host"), (F.col("score") * F.col("share") * damping).alias("gain"))
            scores = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("gain").alias("score"))
        scores = stored(scores, "scores")
        both = written.select("kind", "host", (-F.col("score")).alias("d")).unionByName(scores.select("kind", "host", F.col("score").alias("d")))
        change = both.groupBy("kind", "host").agg(F.abs(F.sum("d")).alias("d")).groupBy("kind").agg(F.sum("d").alias("d"))
        if change.where(F.col("d") * left > residual).isEmpty():
            return scores
        written = scores


def hosts(judged: DataFrame, ratio: float = RATIO, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that trust or distrust reaches."""
    flow = stored(flows(stored(links(judged), "links")), "flows")
    start = stored(seeds(judged), "seeds")
    scores = propagate(start, flow, damping) if not flow.isEmpty() else start.select("kind", "host", F.col("seed").alias("score"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    out = scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    return out.withColumn("blocked", (F.col("distrust") > F.col("trust") * ratio) & (F.col("distrust") > FLOOR))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, decided = decide(F.col("host"), F.col("path"), rules)
    judged = rows.withColumns({"rule": rule, "decided": decided})
    with scratch_space(pages.sparkSession) as keep:
        blocked = keep(stored(hosts(judged, ratio).where("blocked").select("host", F.lit("block").alias("spread")), "blocked-hosts"))
    out = judged.drop("html").join(blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", "spread", F.lit("allow")).alias("verdict"))


def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
