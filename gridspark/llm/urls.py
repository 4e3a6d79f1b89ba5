"""URL filter: rules by host and path, and for all other pages trust and distrust carried along links.

Hosts that rules allow are the seeds of a personalised PageRank along links; hosts that rules block
are the seeds of the same on reversed links, so that a host is distrusted if it links to distrusted
ones. A host is blocked if its distrust exceeds its trust by a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import stage
from gridspark.operators.joins import fits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Absolute and protocol-relative links; relative ones stay on their host.
LINK = r"""(?:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.6, 10, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for null or a url without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    parts = r"^([^/?#]*+)([^?#]*+)"
    return F.translate(F.regexp_extract(rest, parts, 1), UPPER, LOWER), F.regexp_extract(rest, parts, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(size, name, verdict) of the longest rule that fits, else null. Rules are a short list given by the caller."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
            for r in rules]
    none = F.lit(None).cast("struct<size:int,name:string,verdict:string>")
    return F.greatest(none, none, *fits)


def edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts; counted before the shuffle, so a hot host is one row per target."""
    links = pages.where("host <> ''").select(
        F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("target"))
    return (links.withColumn("target", F.translate("target", UPPER, LOWER)).where("target <> source")
            .groupBy("source", "target").agg(F.count("*").alias("links")))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after so many rounds; ``seeds`` is (host, trust, distrust), ``links`` is staged.

    A value is (1 - damping) * seed + damping * what comes in, over (1 - damping): a host without
    links keeps its seed. Trust goes along links, each host giving its value in equal parts per link. Distrust goes
    against them: a host takes over its targets' distrust by the share of its own links that go there, so
    it does not matter how many others link to the same target. Every round joins two narrow tables and adds up per host with
    partial sums first; it is staged, so a lost executor costs a round at most.
    """
    shares = stage(links.join(links.groupBy("source").agg(F.sum("links").alias("all")), "source")
                   .select("source", "target", (F.col("links") / F.col("all")).alias("share")), "shares")
    along = shares.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "share")
    against = shares.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "share")
    steps = stage(along.unionByName(against), "steps")
    values = seed = stage(seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "value"))
                          .where("value > 0"), "seeds")
    if not steps.isEmpty():
        for _ in range(rounds):
            came = (steps.join(values, ["host", "kind"])
                    .select(F.col("to").alias("host"), "kind", (F.col("share") * F.col("value") * damping).alias("value")))
            values = stage(came.unionByName(seed).groupBy("host", "kind").agg(F.sum("value").alias("value")), "values")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)
    return values.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[Rule], damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``pages`` (url, html) with host, path, rule, verdict, trust and distrust.

    A rule decides where one fits, the longest if several do. Else a page is blocked if its host's
    distrust is more than its trust by ``threshold`` or more. A host's seeds are the shares of its
    pages that rules allow and block; a host that is only linked to has none. Pages without a host
    (null url, no ``://``) and hosts that nothing is known of are allowed. Null html has no links.
    Columns with the names of the added ones are replaced.
    """
    host, path = split_url(F.col("row.url"))
    rows = (pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row")).withColumn("host", host).withColumn("path", path)
            .withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)))
    decided = lambda verdict: (F.sum(F.when(F.col("rule.verdict") == verdict, 1).otherwise(0)) / F.count("*"))
    seeds = rows.where("host <> ''").groupBy("host").agg(decided("allow").alias("trust"), decided("block").alias("distrust"))
    links = stage(edges(rows.select("host", F.col("row.html").alias("html"))), "links")
    scores = stage(propagate(seeds, links, damping, rounds), "hosts")
    scored = rows.join((F.broadcast(scores) if fits(scores) else scores).withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")
    distrusted = F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule.name"),
           "verdict": F.coalesce("rule.verdict", F.when(distrusted, "block").otherwise("allow")),
           "trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))}
    return scored.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in new], *[c.alias(k) for k, c in new.items()])
