"""The per-store analysis, for every store of a ``reviews`` table at once.

``analysis(reviews)`` returns lazily-built DataFrames that share one cleaned
and tokenized input; ``summary`` flattens them into one record per store.
``write_analysis`` materializes every output in one batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.config import DEFAULT, RATING_BUCKETS, AnalysisConfig
from reviewlens.functions.text import chart_label
from reviewlens.operators import clean as C
from reviewlens.operators import ratings as R
from reviewlens.operators import terms as T

CHART_NAMES = {1: "bm25_unigram", 2: "bm25_2gram", 3: "bm25_3gram"}


class _Parts(dict):
    """Analysis outputs built on first access (queries pay only for what they read)."""

    def __init__(self, makers: dict):
        super().__init__()
        self._makers = makers

    def __getitem__(self, key):
        if not dict.__contains__(self, key):
            dict.__setitem__(self, key, self._makers[key]())
        return dict.__getitem__(self, key)

    def keys(self):
        return self._makers.keys()


def analysis(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT, docs: DataFrame | None = None,
             materialize: bool = True) -> dict:
    """All outputs of the analysis as DataFrames keyed by name (built lazily).

    ``docs`` overrides the default lexical documents, e.g. with documents
    built from model labels (``tokens.segment`` + ``terms.tagged_docs``).
    The stores' totals (one row per store) are one aggregate over the reviews, written
    once to the shared checkpoint folder; guard, ratings, histogram and the list of
    analysed stores all read it.  With ``materialize`` so is the top-word vocabulary
    (at most ``top_words`` rows per store): the word lists and the negative-mention
    count both read it instead of tokenizing the corpus twice.
    """
    from reviewlens.session import broadcast_if, cut_lineage
    cleaned = C.strip_reply_echo(reviews)
    totals = cut_lineage(R.store_totals(cleaned, cfg))
    # the number of stores bounds every per-store side table below
    n_stores, n_bytes = totals.agg(F.count("*"), F.coalesce(F.sum("text_bytes"), F.lit(0))).first()
    fits = totals.where(F.col("with_text") >= cfg.min_docs)
    ok = cleaned.join(broadcast_if(fits.select("slug"), n_stores), "slug", "left_semi")
    dealt = docs is None
    if dealt:
        docs = T.lexical_docs(ok, cfg, clean=False, n_bytes=n_bytes)
    else:
        docs = docs.join(broadcast_if(fits.select("slug"), n_stores), "slug", "left_semi")

    def word_freq():
        wf = T.ranked_words(T.word_freq(T.term_freq(docs, (1,))), cfg.top_words)
        wf = wf.select("slug", "rank", "word", "count")
        return cut_lineage(wf) if materialize else wf

    def bm25():
        own = T.lexical_docs(ok, cfg, clean=False, n_bytes=n_bytes, task_bytes=T.BLOCK_TEXT_BYTES) if dealt else docs
        bm = T.bm25(own, cfg.ngram_sizes, cfg.k1, cfg.b, n_stores, n_bytes if dealt else None, cfg.top_terms)
        terms = T.ranked_terms(bm, cfg.top_terms)
        return terms.select("slug", "n", "rank", "term", F.round("score", 2).alias("score"),
                            F.col("score").alias("score_raw"))

    def neg_word_freq():
        return T.mention_counts(C.negatives(ok, cfg.neg_max_rating),
                                parts["word_freq"].select("slug", "rank", "word"),
                                cfg.top_neg_words, cfg.lower, vocab_rows=n_stores * cfg.top_words)

    parts = _Parts({
        "totals": lambda: totals,
        "guard": lambda: C.guard_status(totals.select("slug", F.col("with_text").alias("count")), cfg.min_docs),
        "word_freq": word_freq,
        "bm25": bm25,
        "neg_word_freq": neg_word_freq,
        "monthly": lambda: R.monthly(ok, cfg),
        "trend": lambda: R.trend(parts["monthly"], cfg),
        "ratings": lambda: R.rating_summary(ok, cfg, fits.where(F.col("slug").isNotNull())),
        "hist": lambda: fits.where(F.col("slug").isNotNull()).select("slug", *[f"r{b}" for b in RATING_BUCKETS]),
    })
    return parts


def _joined_words(df: DataFrame, ks: dict[str, int], word: str = "word") -> DataFrame:
    """(slug, <col>...): for each output column, the first k words of a ranked list joined with '|'.

    One aggregate per list table (at most max(k) rows per store are collected).
    """
    top = max(ks.values())
    arr = (df.where(F.col("rank") <= top).groupBy("slug")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))),
                            lambda x: x[word]).alias("_w")))
    return arr.select("slug", *[F.array_join(F.slice("_w", 1, k), "|").alias(c) for c, k in ks.items()])


def summary(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT, parts: dict | None = None) -> DataFrame:
    """One flattened record per store: counts, averages, histogram, keyword lists, trend.

    Stores failing the small-corpus guard keep only ``with_text`` and ``error``.
    Every piece is a per-store aggregate, so the final joins are on tables
    with one row per store.
    """
    p = parts if parts is not None else analysis(reviews, cfg)
    t = p["totals"]
    status = C.guard_status(t.withColumn("count", F.col("with_text")), cfg.min_docs)
    rated = status.select("slug", "with_text", F.when(F.col("status") != "ok", F.col("status")).alias("error"),
                          *[f"r{b}" for b in RATING_BUCKETS])
    rated = rated.join(R.rating_summary(reviews, cfg, t).drop("with_text", "neg_count"), "slug", "left")
    out = (rated.join(_joined_words(p["word_freq"], {"top_words": cfg.summary_words,
                                                     "top_keywords": cfg.summary_keywords}), "slug", "left")
           .join(_joined_words(p["neg_word_freq"], {"neg_top_words": cfg.summary_neg_words}), "slug", "left")
           .join(p["trend"], "slug", "left"))
    ok = F.col("error").isNull()
    analysed = ok & F.col("slug").isNotNull()        # a store without a name is only counted
    return out.select(
        "slug", F.when(analysed, F.col("total")).alias("total"), "with_text",
        F.when(analysed, F.col("avg_rating")).alias("avg_rating"),
        *[F.when(analysed, F.col(f"r{b}")).alias(f"r{b}") for b in RATING_BUCKETS],
        F.when(analysed, F.col("neg_rate_pct")).alias("neg_rate_pct"),
        F.when(ok, F.coalesce("top_words", F.lit(""))).alias("top_words"),
        F.when(ok, F.coalesce("top_keywords", F.lit(""))).alias("top_keywords"),
        F.when(ok, F.coalesce("neg_top_words", F.lit(""))).alias("neg_top_words"),
        "early_avg", "recent_avg", "direction", "error")


def chart_manifest(parts: dict, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, chart): the chart series each analyzed store gets.

    Word frequency and the BM25 series always; negative words only with more
    than five of them; the monthly series only when it exists.
    """
    ok = parts["guard"].where(F.col("status") == "ok").select("slug")
    fixed = F.array(F.lit("word_freq"), *[F.lit(CHART_NAMES[n]) for n in cfg.ngram_sizes])
    always = ok.select("slug", F.explode(fixed).alias("chart"))
    neg = (parts["neg_word_freq"].groupBy("slug").agg(F.count("*").alias("k"))
           .where(F.col("k") >= cfg.min_neg_chart_words)
           .select("slug", F.lit("neg_word_freq").alias("chart")))
    mon = parts["monthly"].select("slug").distinct().select(
        "slug", F.lit("monthly_volume_rating").alias("chart"))
    return always.unionByName(neg).unionByName(mon)


def chart_series(parts: dict, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, n, rank, label, score, bar): BM25 chart bars, bottom-up plot order.

    Labels keep word characters, whitespace and CJK; ``bar`` = 0 is the bottom
    bar (the series is reversed for a horizontal chart).
    """
    t = parts["bm25"].where(F.col("rank") <= cfg.chart_terms)
    w = Window.partitionBy("slug", "n")
    return t.select("slug", "n", "rank", chart_label(F.col("term")).alias("label"), "score",
                    (F.count("*").over(w) - F.col("rank")).alias("bar"))


def word_freq_chart(parts: dict, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, rank, word, count, bar): the first 30 words, ``bar`` 0 at the bottom."""
    x = parts["word_freq"].where(F.col("rank") <= cfg.chart_words)
    w = Window.partitionBy("slug")
    return x.select("slug", "rank", "word", "count", (F.count("*").over(w) - F.col("rank")).alias("bar"))


def neg_chart(parts: dict, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, rank, word, count, bar): first 25 negative words, only with more than 5."""
    n = parts["neg_word_freq"]
    w = Window.partitionBy("slug")
    x = n.withColumn("k", F.count("*").over(w)).where(F.col("k") >= cfg.min_neg_chart_words)
    x = x.where(F.col("rank") <= cfg.chart_neg_words)
    return x.select("slug", "rank", "word", "count",
                    (F.least(F.col("k"), F.lit(cfg.chart_neg_words)) - F.col("rank")).alias("bar"))


def write_analysis(reviews: DataFrame, root: str, cfg: AnalysisConfig = DEFAULT,
                   fmt: str = "json") -> dict:
    """Compute every output once and write it under ``root`` (one folder per table, run and
    store); the tables of a run are committed together (``sources.results``).

    The tokenized documents and the ranked lists feed several outputs, so they are
    written once to the shared checkpoint folder (``spark.checkpoint.dir``) first; a lost
    executor then re-reads them instead of re-tokenizing everything.
    """
    from reviewlens.session import cut_lineage
    from reviewlens.sources.results import write_results

    parts = analysis(reviews, cfg, docs=cut_lineage(T.lexical_docs(reviews, cfg)))
    parts["bm25"] = cut_lineage(parts["bm25"])       # read by a table per n-gram size and the charts
    parts["neg_word_freq"] = cut_lineage(parts["neg_word_freq"])
    tables = {
        "word_freq": parts["word_freq"],
        "neg_word_freq": parts["neg_word_freq"],
        "monthly": parts["monthly"],
        "summary": summary(reviews, cfg, parts),
        "charts": chart_manifest(parts, cfg),
        "bm25_chart": chart_series(parts, cfg),
        "word_freq_chart": word_freq_chart(parts, cfg),
    }
    for n in cfg.ngram_sizes:
        tables[CHART_NAMES[n]] = parts["bm25"].where(F.col("n") == n).drop("n", "score_raw")
    write_results(tables, root, fmt, reviews.select("slug").distinct())
    return tables
