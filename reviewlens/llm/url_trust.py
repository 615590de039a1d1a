"""URL filters by rules, and for the rest by trust and distrust over the host graph.

Hosts link to each other where a page of one has an anchor to the other; an edge
weighs as many pages as hold one.  Trust starts at hosts by the share of their pages that
rules allow and runs along the links (personalised PageRank); distrust starts by the
share that rules block and runs against them, from a host to those that link to it.  A
host is blocked where its distrust exceeds its trust; a host that neither reaches is
allowed.

Both are summed as power series, one join of hosts and edges a round: what is left
to pass on shrinks by ``FOLLOW`` each round, so after ``ROUNDS`` rounds about one
hundredth is missing.  Pages are counted per host before anything moves, so a host with
a third of all pages is a few rows; only the final look-up meets pages, by broadcast
where the measured table of blocked hosts is small, else by a join that the
skew rule splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import discard, fresh, saved, table

FOLLOW = 0.85
ROUNDS = 28                                          # 0.85 ** 28 is 0.0106
EVERY = 4                                            # rounds between written tables
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"[\x09-\x0D\x20]"
ANCHOR = (rf"<[aA](?:{_WS}[^<>]*?)?{_WS}[hH][rR][eE][fF]{_WS}*={_WS}*[\x22\x27]?{_WS}*(?:[hH][tT][tT][pP][sS]?:)?//"
          r"([^/?#\x22\x27<>\x09-\x0D\x20]+)")
# the query's rules: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path of a url; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://(.*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  A rule is a branch of
    one expression, so ``rules`` is for lists of up to some hundred."""
    rule = verdict = None
    for what, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host src with an anchor to another host dst, from (host, html)."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)),
                                         lambda x: F.translate(x, UPPER, LOWER)))
    return (hosts.filter("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
            .filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def _flows(edges: DataFrame) -> DataFrame:
    """(kind, host, to, share): what part of a host's trust (distrust) goes on to which host."""
    both = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
            .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"),
                                      F.col("src").alias("to"), "n")))
    total = both.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    return both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, follow: float = FOLLOW, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    ``seeds``: (host, kind, left) with kind trust or distrust and the mass a host starts
    with; ``edges``: (src, dst, n).  Mass that arrives at a host without links to pass it
    on ends there.  Without edges the seeds alone decide.
    """
    flows = saved(_flows(edges), "flows")
    state = saved(seeds.select("host", "kind", (F.col("left") * (1 - follow)).alias("score"), "left"), "trust")
    if flows.isEmpty():
        rounds = 0
    for k in range(1, rounds + 1):
        passed = (state.filter("left > 0").join(flows, ["kind", "host"])
                  .select(F.col("to").alias("host"), "kind",
                          (F.col("left") * F.col("share") * (follow * (1 - follow))).alias("score"),
                          (F.col("left") * F.col("share") * follow).alias("left")))
        state = (state.select("host", "kind", "score", F.lit(0.0).alias("left")).unionByName(passed)
                 .groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("left").alias("left")))
        if k % EVERY == 0 or k == rounds:
            last, state = state, saved(state, "trust")
            if state.filter("left > 0").isEmpty():
                break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return state.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    A null url, or one without ``://``, has an empty host and path, fits no rule, is in no
    graph and is allowed.  A null or empty html has no links.  Repeated rows are pages of
    their own.  Older columns called host, path, rule or verdict are replaced, other columns
    stay; an empty table stays empty.
    """
    name, key = fresh(pages, "found", "blocked_host")
    own = [f"`{c}`" for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))

    def parsed(df):
        df = df.withColumn(name, F.struct(host.alias("host"), path.alias("path")))
        rule, verdict = rule_of(F.col(name)["host"], F.col(name)["path"], rules)
        return df.withColumn(name, F.struct(f"{name}.host", f"{name}.path", rule.alias("rule"), verdict.alias("verdict")))

    edges = host_edges(pages.select(host.alias("host"), F.col(html).alias("html")))
    share = lambda v: F.count(F.when(F.col("verdict") == v, 1)) / F.count(F.lit(1))
    seeds = (parsed(pages.select(url)).select(f"{name}.*").filter("host <> ''").groupBy("host")
             .agg(share("allow").alias("trust"), share("block").alias("distrust"))
             .select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust")))
                     .alias("kind", "left")).filter("left > 0"))
    blocked = saved(propagate(seeds, edges).filter("distrust > trust").select(F.col("host").alias(key)), "blocked")
    size = blocked.agg(F.sum(F.octet_length(key) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:                      # measured, not guessed
        blocked = F.broadcast(blocked)
    out = parsed(pages)
    out = out.join(blocked, (F.col(f"{name}.host") == F.col(key)) & F.col(f"{name}.verdict").isNull(), "left")
    return out.select(*own, f"{name}.host", f"{name}.path", f"{name}.rule",
                      F.coalesce(f"{name}.verdict", F.when(F.col(key).isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op13(spark, pages: DataFrame) -> DataFrame:
    """Query op13: host, path, rule and verdict of all ``pages``."""
    return judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
