"""URL filter: rules, and link-graph propagation of trust and distrust between hosts.

Rules decide the urls that they fit. For all others the host decides: hosts with
urls that rules allow are trusted seeds, hosts with urls that rules block are
distrusted ones, each by the share of its judged urls. Trust follows the links
between hosts as personalised PageRank from the trusted seeds; distrust follows them
backwards from the distrusted ones, as who links to a blocked host earns distrust.
A host is blocked if its distrust is at least ``MIN_SCORE`` and above its trust.

Edges come from the ``href`` of ``a`` and ``area`` tags that name another host
(``http://``, ``https://`` or ``//``), counted per pair of hosts, and from a host to
the host of the domain above it where both are known (``sub.site.org`` to
``site.org``). Links within a host are no edges. Links to hosts without a page
count in a host's number of links, but carry nothing on.

A null url, or one without ``://``, has an empty host and path: no rule fits, it is
no seed, and it is allowed. Null html has no links. Rows are judged one by one:
repeated rows and null page ids stay. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.joins import lookup_join
from loadlens.session import snapshot

ALLOW, BLOCK = "allow", "block"
DAMPING = 0.85
SNAPSHOT_EVERY = 5
TOLERANCE = 1e-6
MIN_SCORE = 0.01

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """A rule for a host with all its subdomains, and for the paths that begin alike."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]


RULES = (
    Rule(ALLOW, "org/"),
    Rule(BLOCK, "example.org/es/"),
    Rule(BLOCK, "example.org/en/1"),
    Rule(ALLOW, "com/fr/"),
    Rule(BLOCK, "com/de/"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """(pattern, verdict) of the longest rule that fits, or null; of equal ones a block."""
    order = sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != BLOCK, r.pattern))
    found = F.lit(None).cast("struct<pattern: string, verdict: string>")
    for rule in reversed(order):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        found = F.when(
            fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))
        ).otherwise(found)
    return found


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, rule_verdict) of every page."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return parts.select(
        "page_id", "host", "path", rule["pattern"].alias("rule"), rule["verdict"].alias("rule_verdict")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links): how often pages of one host link to another host."""
    host, _ = url_parts(F.col("url"))
    found = F.regexp_extract_all(F.col("html"), F.lit(_HREF), F.lit(1))
    targets = F.array_distinct(F.transform(found, lower_ascii))
    return (
        pages.where(F.col("html").isNotNull()).select(
            host.alias("src"), F.explode(targets).alias("dst")
        )
        .where((F.col("src") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.count("*").alias("links"))
    )


def host_seeds(rows: DataFrame) -> DataFrame:
    """(host, trust, distrust, pages): the share of a host's judged urls that are allowed, blocked."""
    allowed = F.count_if(F.col("rule_verdict") == ALLOW)
    blocked = F.count_if(F.col("rule_verdict") == BLOCK)
    return (
        rows.where(F.col("host") != "").groupBy("host")
        .agg(allowed.alias("_allowed"), blocked.alias("_blocked"), F.count("*").alias("pages"))
        .select(
            "host", "pages",
            F.coalesce(F.try_divide("_allowed", F.col("_allowed") + F.col("_blocked")), F.lit(0.0)).alias("trust"),
            F.coalesce(F.try_divide("_blocked", F.col("_allowed") + F.col("_blocked")), F.lit(0.0)).alias("distrust"),
        )
    )


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(node, score) by personalised PageRank from (node, seed) over (src, dst, share).

    ``share`` is the part of a node's score that an edge carries. Scores are
    s = (1 - damping) * seed + damping * (what the edges bring), which is linear in
    the seeds, so trust and distrust stay comparable. A round adds at most ``damping``
    to its power times the seeds, so after as many rounds as bring that below
    ``tolerance`` no score lacks more than that share of all seeds; it ends before if the
    sum has settled. Each few rounds are one table in the shared folder.
    """
    rounds = math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping))
    base = seeds.select("node", "seed")
    now = base.select("node", ((1 - damping) * F.col("seed")).alias("score"))
    before = None
    for n in range(1, rounds + 1):
        brought = (
            edges.join(now.withColumnRenamed("node", "_node"), F.col("src") == F.col("_node"))
            .groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("_in"))
        )
        now = base.join(brought, base["node"] == brought["dst"], "left").select(
            "node",
            ((1 - damping) * F.col("seed") + damping * F.coalesce("_in", F.lit(0.0))).alias("score"),
        )
        if n % SNAPSHOT_EVERY == 0:
            now = snapshot(now, "host-scores")
            total = now.agg(F.sum("score")).first()[0] or 0.0
            # Scores only grow from the seeds on, so their sum tells when they have settled.
            if before is not None and abs(total - before) <= tolerance * max(total, 1.0):
                break
            before = total
    return now


def host_verdicts(
    pages: DataFrame, rows: DataFrame, damping: float = DAMPING, min_score: float = MIN_SCORE
) -> DataFrame:
    """(host, trust, distrust, verdict) of every host with a page."""
    hosts = snapshot(host_seeds(rows), "host-seeds")
    above = hosts.select(
        F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"),
        F.lit(1).cast("bigint").alias("links"),
    ).where(F.col("src") != F.col("dst")).join(
        hosts.select(F.col("host").alias("dst")), "dst", "left_semi"
    ).select("src", "dst", "links")
    edges = snapshot(
        host_links(pages).unionByName(above).groupBy("src", "dst").agg(F.sum("links").alias("links")),
        "host-links",
    )
    forward = edges.join(
        edges.groupBy("src").agg(F.sum("links").alias("_all")), "src"
    ).select("src", "dst", (F.col("links") / F.col("_all")).alias("share"))
    backward = edges.join(
        edges.groupBy("dst").agg(F.sum("links").alias("_all")), "dst"
    ).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("_all")).alias("share"))
    known = hosts.select("host")
    within = lambda e: e.join(known.withColumnRenamed("host", "dst"), "dst", "left_semi")
    trust = propagate(
        hosts.select(F.col("host").alias("node"), F.col("trust").alias("seed")),
        snapshot(within(forward), "host-shares"), damping,
    )
    distrust = propagate(
        hosts.select(F.col("host").alias("node"), F.col("distrust").alias("seed")),
        snapshot(within(backward), "host-shares"), damping,
    )
    scores = known.join(
        trust.select(F.col("node").alias("host"), F.col("score").alias("trust")), "host"
    ).join(distrust.select(F.col("node").alias("host"), F.col("score").alias("distrust")), "host")
    bad = (F.col("distrust") >= min_score) & (F.col("distrust") > F.col("trust"))
    return scores.withColumn("verdict", F.when(bad, BLOCK).otherwise(ALLOW))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    rows = judged(pages, rules)
    hosts = snapshot(host_verdicts(pages, rows), "host-verdicts")
    met = lookup_join(
        rows, hosts.select(
            F.col("host").alias("_host"), "trust", "distrust", F.col("verdict").alias("_verdict")
        ), ("host", "_host"), "left", spread_by="row",
    )
    return met.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "_verdict", F.lit(ALLOW)).alias("verdict"), "trust", "distrust",
    )
