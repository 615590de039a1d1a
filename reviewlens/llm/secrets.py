"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by its SHA-256 (the blob).  The ledger
holds the (blob, rule, version) pairs scanned so far; a run scans only pairs
not in it, each blob once however many paths carry it, and joins the findings
back to all paths.

Matches get their positions without Python: ``split`` gives the pieces between
the matches, ``regexp_extract_all`` the matches, and running sums of both
lengths (code points) the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import fresh, saved, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; a match whose ``group``
    has fewer than ``least`` characters is dropped.  ``hint``: a cheap test that
    holds wherever a match can be."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    hint: str | None = None


# The base kinds in their order, then the kinds this scan adds.
# The hex rule asks for 24 characters in the pattern: maximal runs never overlap,
# so dropping short runs afterwards gives the same spans.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A pem span holds the header line and what follows it as a key does: its own header lines, base64
# lines of 40 characters or more (the last may be shorter) up to 300 (a 16,384-bit key has under
# 300), and the footer behind them.  Anything else ends the span, so prose that mentions a header
# loses the header alone.  Line ends may be written as backslash and n.
HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_GAP = r"(?:[ \t\r\n]|\\[rn])"
_LINE = "[A-Za-z0-9+/]{40,}"
PEM = (HEADER + f"(?:{_GAP}+(?:Proc-Type|DEK-Info):" + r"[^\r\n\\]{0,100}){0,2}"
       f"(?:(?:{_GAP}+{_LINE}=?=?)" "{1,300}"
       f"(?:(?:{_GAP}+[A-Za-z0-9+/]+=?=?)?{_GAP}*-----END [A-Z ]*PRIVATE KEY-----|{_GAP}+" "[A-Za-z0-9+/]+={1,2})?)?")
ADDED = (
    Rule("pem", PEM, 0, 1, version=3, hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, hint="eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, hint="xox"),
)
RULES = BASE + ADDED
# the rules as of the ledger's first increment in the query: pem took the header alone
EARLIER = tuple(Rule("pem", HEADER, 0, 1, version=1, hint=r.hint) if r.kind == "pem" else r for r in RULES)


def _raw(text: Column, rule: Rule, order: int, todo: Column) -> Column:
    """Array of (order, i, gap, len, ok) of a rule's matches in ``text``: the
    characters before match i since the last match, and its own length."""
    pat = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    group = F.regexp_extract_all(text, pat, F.lit(rule.group)) if rule.group else whole
    found = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("w"), group.alias("v")),
        lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(x["g"]).alias("gap"),
                              F.length(x["w"]).alias("len"), (F.length(x["v"]) >= rule.least).alias("ok")))
    test = todo & text.rlike(rule.pattern)
    if rule.hint:
        test = todo & text.contains(rule.hint) & test
    return F.when(test, found).otherwise(F.array().cast("array<struct<ord:int,i:int,gap:int,len:int,ok:boolean>>"))


def spans_of(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, ord, start, end) of all matches in ``blobs`` (blob, text,
    todo: array of the rule names to run).  Only lengths leave the scan; a blob in
    several rows counts once, before the lengths are summed."""
    raw = F.concat(*[_raw(F.col("text"), r, k, F.array_contains("todo", r.kind)) for k, r in enumerate(rules)])
    m = blobs.select("blob", raw.alias("_m")).filter(F.size("_m") > 0).select("blob", F.inline("_m")) \
        .dropDuplicates(["blob", "ord", "i"])
    upto = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return (m.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(upto))
            .filter("ok")
            .select("blob", F.get(kinds, F.col("ord")).alias("kind"), "ord",
                    (F.col("end") - F.col("len")).alias("start"), "end"))


def scan(versions: DataFrame, key: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
         findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, findings) after scanning what the ledger doesn't have.

    paths: (key, blob) of every row of ``versions``; ledger: (blob, rule,
    version) with this run's pairs added; findings: (blob, kind, ord, start,
    end) of all blobs, where a rule's older version gives way to the new one.
    A null text counts as empty; a null key is a key; repeated rows share a
    blob; other columns are not read.  An empty table adds nothing.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(key).alias("key"), text_or_empty(text).alias("text")) \
        .withColumn("blob", F.sha2(F.col("text"), 256))
    paths = saved(rows.select("key", "blob"), "paths")
    want = paths.groupBy("blob").agg(F.min("key").alias("key"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        todo = want.withColumn("todo", names)
    else:
        now = F.array(*[F.concat_ws("@", F.lit(r.kind), F.lit(r.version)) for r in rules])
        had = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("had"))
        new = F.array_except(now, F.coalesce("had", F.array().cast("array<string>")))
        todo = (want.join(had, "blob", "left")
                .withColumn("todo", F.transform(new, lambda x: F.substring_index(x, "@", 1)))
                .filter(F.size("todo") > 0).drop("had"))
        todo = saved(todo, "todo")
    # one row of each unseen blob brings its text; repeated rows and null keys may bring it again
    sent = todo.withColumnsRenamed({"blob": "_blob", "key": "_key"})
    blobs = (rows.join(sent, F.col("key").eqNullSafe(F.col("_key")) & (F.col("blob") == F.col("_blob")))
             .select("blob", "text", "todo"))
    new = spans_of(blobs, rules)
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    pairs = todo.select("blob", F.explode("todo").alias("rule")) \
        .withColumn("version", F.element_at(version, F.col("rule")))
    if ledger is not None:
        again = pairs.select("blob", F.col("rule").alias("kind"))
        if findings is not None:
            new = findings.join(again, ["blob", "kind"], "left_anti").unionByName(new)
        pairs = ledger.unionByName(pairs)
    return paths, pairs, new


def join_back(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, blob, spans) for every path; spans: array of (start, ord, end, kind), sorted.

    The findings of a blob are as many as its text has, so they meet in one row.
    """
    per_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(
        F.struct("start", "ord", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    return (paths.join(per_blob, "blob", "left")
            .withColumn("spans", F.coalesce("spans", none)))


def op3(spark, docs: DataFrame) -> DataFrame:
    """Query op3: spans of secrets in every document, scanned in two increments.

    The first scans half of the blobs under the earlier rules and writes ledger and
    findings; the second sees all documents and scans what the ledger lacks: the other
    half, and the pem rule's new version everywhere.  See ``scan`` for odd rows; repeated
    rows are rows of the result, and an empty table gives none.
    """
    half = F.pmod(F.xxhash64(text_or_empty("text")), F.lit(2)) == 0
    _, ledger, findings = scan(docs.filter(half), rules=EARLIER)
    ledger, findings = saved(ledger, "ledger"), saved(findings, "findings")
    paths, _, findings = scan(docs, ledger=ledger, findings=findings)
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return join_back(paths, findings).select(
        F.col("key").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` and n_chars renewed.

    Overlapping spans count as one.  Rows without a finding stay untouched; a
    null text stays null, repeated rows stay repeated and an empty table empty.  Other
    columns may have any names.  Texts move once, to meet their spans.
    """
    blob, spans = fresh(docs, "blob", "spans")
    _, _, findings = scan(docs)
    per_blob = join_back(findings.select("blob").distinct(), findings).select(
        F.col("blob").alias(blob), F.col("spans").alias(spans))
    out = docs.join(per_blob, F.sha2(F.col("text"), 256) == F.col(blob), "left")
    first = F.struct(F.lit("").alias("s"), F.lit(0).cast("bigint").alias("at"))
    # spans come by start: cut what lies between the last end and this start
    glue = F.aggregate(
        spans, first,
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(
            F.when(x["start"] < acc["at"], acc["s"]).otherwise(F.concat(
                acc["s"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                F.lit(mask))).alias("s"),
            x["end"].alias("at"))),
        lambda acc: F.concat(acc["s"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    new = F.when(F.col(spans).isNotNull(), glue).otherwise(F.col("text"))
    cols = [new.alias(c) if c == "text" else
            F.when(F.col(spans).isNotNull(), F.length(new)).otherwise(F.col(c)).cast("long").alias(c)
            if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)


def _sql_pattern(rule: Rule) -> str:
    """The same pattern for RE2, which limits nested counts: the 40 characters are written out."""
    return rule.pattern.replace(_LINE, "[A-Za-z0-9+/]" * 40 + "[A-Za-z0-9+/]*").replace("'", "''")


_SQL_KIND = """
  SELECT doc_id, {k} AS ord, '{kind}' AS kind,
    string_split_regex(text, '{pat}') AS g, regexp_extract_all(text, '{pat}', 0) AS w,
    regexp_extract_all(text, '{pat}', {group}) AS v, {least} AS least
  FROM documents WHERE regexp_matches(text, '{pat}')"""

ORACLE_SQL = ("WITH raw AS (" + "\n  UNION ALL".join(
    _SQL_KIND.format(k=k, kind=r.kind, pat=_sql_pattern(r), group=r.group, least=r.least)
    for k, r in enumerate(RULES)) + """),
m AS (SELECT doc_id, ord, kind, u.i, length(g[u.i]) + length(w[u.i]) AS step, length(w[u.i]) AS len,
        length(v[u.i]) >= least AS ok
      FROM raw, unnest(range(1, len(w) + 1)) AS u(i)),
e AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e FROM m),
s AS (SELECT doc_id, ord, kind, (e - len)::BIGINT AS s,
        kind || ':' || (e - len)::BIGINT || ':' || e::BIGINT AS span FROM e WHERE ok),
d AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (ord < 3), '') AS base,
        string_agg(span, ',' ORDER BY s, ord) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d USING (doc_id)
""")
