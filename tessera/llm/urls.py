"""URL filters: rules by host and path, and trust and distrust that spread over the graph of hosts.

Rules decide the pages they fit, the longest fitting rule winning. What they say about a host's pages makes it a
seed: the share allowed is its trust, the share blocked its distrust. Trust flows along links (personalised
PageRank: each host keeps a part of its seed and passes the rest evenly to the hosts that it links to), distrust against
them (to the hosts that link there, as linking to bad hosts speaks against a host). Pages without a rule get their
host's verdict: block where distrust exceeds trust by a threshold.

All in Spark: one join and one partial aggregation a round over distinct host edges; hub hosts are aggregated before the
shuffle and split by the adaptive join. Rules are a parameter (a map literal in the plan: thousands, not millions).

Edge cases: a null url or one without ``://`` has an empty host and path, no rule and no part in the graph, and
is allowed; html that is null or without absolute links gives no edges; links within a host are no edges; repeated
pages count as often as they occur and get a row each; a very long page is searched for links where it lies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 12, 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule of the host or a domain above it whose path begins the url's, as a struct (rule, verdict)."""
    by_host: dict[str, list] = {}
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        by_host.setdefault(name.translate(str.maketrans(_UPPER, _LOWER)), []).append((rule, "/" + rest, verdict))
    kind = "array<struct<size:int,rule:string,path:string,verdict:string>>"
    entries = [(F.lit(h), F.array(*(F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for r, p, v in rs)).cast(kind)) for h, rs in by_host.items()]
    if not entries:
        return F.lit(None).cast("struct<size:int,rule:string,path:string,verdict:string>")
    table = F.create_map(*(x for e in entries for x in e))
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(above, lambda h: F.coalesce(F.try_element_at(table, h), F.array().cast(kind))))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) of links from a page's host to another host."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("link"))
    dst = host_of(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")))
    return found.select("src", dst.alias("dst")).where("src != '' and dst != '' and src != dst").distinct()


def spread(hosts: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust and distrust after ``rounds`` rounds, from ``hosts`` (host, trust, distrust) and ``edges`` (src, dst)."""
    edges = scratch.write(edges)
    keep = 1 - damping
    seeds = hosts.select("host", (F.col("trust") * keep).alias("t0"), (F.col("distrust") * keep).alias("d0"))
    if edges.isEmpty():
        return seeds.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    # trust goes from src to dst, distrust from dst to src, shared evenly
    out = edges.join(edges.groupBy("src").count(), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(True).alias("ahead"), (damping / F.col("count")).alias("share"))
    back = edges.join(edges.groupBy("dst").count(), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(False).alias("ahead"), (damping / F.col("count")).alias("share"))
    flows = scratch.write(out.union(back))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    seeds = scratch.write(seeds.join(linked, "host", "full").select("host", F.coalesce("t0", F.lit(0.0)).alias("t0"), F.coalesce("d0", F.lit(0.0)).alias("d0")))
    ranks = seeds.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    for _ in range(rounds):
        sent = flows.join(ranks, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.when(F.col("ahead"), F.col("share") * F.col("trust"))).alias("t"),
            F.sum(F.when(~F.col("ahead"), F.col("share") * F.col("distrust"))).alias("d"),
        )
        got = seeds.join(sent, "host", "left")
        new = scratch.write(got.select("host", (F.col("t0") + F.coalesce("t", F.lit(0.0))).alias("trust"), (F.col("d0") + F.coalesce("d", F.lit(0.0))).alias("distrust")))
        scratch.drop(ranks)
        ranks = new
    return ranks


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, **args) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = cut.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    ruled = scratch.write(ruled.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.col("fits.verdict").alias("said")))
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    hosts = scratch.write(ruled.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    ranks = spread(hosts, host_edges(pages), scratch, **args)
    judged = ruled.join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.round(F.col("distrust") - F.col("trust"), 9) >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
