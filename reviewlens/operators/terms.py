"""Documents, term statistics, corpus BM25, frequencies and mention counts.

Shuffle plan of the BM25 family (per call, all n-gram sizes at once):

1. ``lexical_docs`` deals the cleaned texts out by (slug, pos) once, 4 MB a task, then tokenizes;
   tokenizer and keep rule are one regex evaluated in-row.  A text is smaller than its
   (document, term) pairs, and no store can skew the key, which names one document.
2. ``term_freq`` explodes and aggregates by (slug, n, pos, term).  The documents'
   partitioning already satisfies that key, so no pair crosses the network.
3. ``stats_from_docs``: N and total length per store from document lengths
   (a regex match count, no array, no explode), over the same exchange; one row per
   store, broadcast when the store count bounds it.
4. ``bm25_terms`` aggregates by (slug, n, term) with a partial aggregate per
   map task, so a term that is hot in a huge store is pre-combined before the
   shuffle.  The idf factor is constant per term and is applied after the sum.
5. ``top_k`` ranks inside each store; Spark inserts a ``WindowGroupLimit``
   below the shuffle so each map task sends at most k rows per store.

Documents that ``lexical_docs`` dealt out take another way through 2 and 4 (``term_blocks``): the
terms are counted over Arrow buffers, leave the task in compressed blocks and are merged by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.config import DEFAULT, AnalysisConfig
from reviewlens.functions.text import keep_tokens, lexical_count, lexical_words, ngrams, token_words
from reviewlens.operators.clean import strip_reply_echo, with_text
from reviewlens.operators.patterns import pattern_counts
from reviewlens.operators.term_blocks import REST, WHOLE, merged_terms
from reviewlens.session import BROADCAST_ROWS, broadcast_if, store_count


def _sets(cfg: AnalysisConfig) -> dict:
    return {"stop_words": cfg.stop_words, "punct_tags": cfg.punct_tags,
            "verb_tags": cfg.verb_tags}


# Text that one task explodes into terms.  A task's term table is some 40 times its text, so
# this, not the number of shuffle partitions, bounds the memory of every step up to the terms.
TASK_TEXT_BYTES = 4 << 20

# Text of a task whose terms leave as blocks: one chunk of them (blocks of more terms take less each).
BLOCK_TEXT_BYTES = 16 << 20


def text_bytes(reviews: DataFrame) -> int:
    """Bytes of the reviews' texts, the greater of text and translation (one narrow aggregate)."""
    sizes = [F.octet_length(c) for c in ("text", "text_translated") if c in reviews.columns]
    size = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return reviews.agg(F.sum(size)).first()[0] or 0


def text_tasks(reviews: DataFrame, n_bytes: int, task_bytes: int | None = None) -> int:
    """Number of tasks for ``n_bytes`` of text: ``TASK_TEXT_BYTES`` (or ``task_bytes``) each, one a core at least."""
    return max(reviews.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // (task_bytes or TASK_TEXT_BYTES)))


def lexical_docs(reviews: DataFrame, cfg: AnalysisConfig = DEFAULT,
                 clean: bool = True, n_bytes: int | None = None, task_bytes: int | None = None) -> DataFrame:
    """(slug, pos, words): kept words of every review with text.

    Uses the default lexical tokenizer; every word carries the unknown tag, so
    the keep rule drops one-letter words and stop words.  ``clean`` applies the
    owner-reply echo removal first, as the analysis does.  Rows are dealt out by
    (slug, pos), which the term counts build on, to as many tasks as ``n_bytes`` of text
    (measured when not given) need: the text of a task stays the same on larger tables.
    """
    tasks = text_tasks(reviews, text_bytes(reviews) if n_bytes is None else n_bytes, task_bytes)
    r = strip_reply_echo(reviews) if clean else reviews
    r = with_text(r).select("slug", "pos", "text").repartition(tasks, "slug", "pos")
    # tokenizer and keep rule are one regex; n_words counts the same matches
    # without building them, for statistics that need only lengths
    return r.select(
        "slug", "pos", lexical_words(F.col("text"), cfg.lower, **_sets(cfg)).alias("words"),
        lexical_count(F.col("text"), cfg.lower, **_sets(cfg)).alias("n_words"))


def listed_docs(docs: DataFrame, stop: DataFrame, rows_bound: int | None = None) -> DataFrame:
    """``docs`` (slug, pos, words) without the words of a stop list too long for literals.

    ``stop`` is (word) or (slug, word), where a null slug stands for every store; null and
    repeated words in it do nothing.  The list is broadcast when ``rows_bound`` proves it
    small, else both sides are shuffled by word, and AQE splits frequent words.  Words keep
    their order and repeats; a document of listed words alone stays with none.  (slug, pos)
    must name one document, null slugs included.  Equal to a stop list of literals.
    """
    words = docs.select("slug", "pos", F.posexplode_outer("words").alias("i", "word"))
    stop = stop.filter(F.col("word").isNotNull())
    if "slug" not in stop.columns:
        stop = stop.withColumn("slug", F.lit(None).cast("string"))
    own = broadcast_if(stop.filter("slug is not null").select("slug", "word").distinct(), rows_bound)
    all_stores = broadcast_if(stop.filter("slug is null").select("word").distinct(), rows_bound)
    # listed words are marked, not dropped, so that documents stay
    one = F.lit(True)
    words = (words.join(all_stores.withColumn("_all", one), "word", "left")
             .join(own.withColumn("_own", one), ["slug", "word"], "left"))
    kept = F.when(F.col("i").isNotNull() & F.col("_all").isNull() & F.col("_own").isNull(), F.struct("i", "word"))
    out = words.groupBy("slug", "pos").agg(F.array_sort(F.collect_list(kept)).alias("w"))
    return (out.select("slug", "pos", F.transform("w", lambda x: x["word"]).alias("words"))
            .withColumn("n_words", F.size("words")))


def tagged_docs(tokens: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(slug, pos, words) from a (slug, pos, tokens array<struct<word,tag>>) table."""
    d = tokens.select("slug", "pos",
                      token_words(keep_tokens(F.col("tokens"), **_sets(cfg))).alias("words"))
    return d.withColumn("n_words", F.size("words"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(slug, n_docs, total, avgdl) straight from documents; empty documents count in N."""
    size = F.col("n_words") if "n_words" in docs.columns else F.size("words")
    return (docs.groupBy("slug")
            .agg(F.count("*").alias("n_docs"), F.sum(size).alias("total"))
            .withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs"))
                        .otherwise(F.lit(1.0))))


def term_freq(docs: DataFrame, ns=(1,)) -> DataFrame:
    """(slug, n, pos, term, f, first_i, dl): distinct terms of each n-gram document.

    Exploded and aggregated by (slug, n, pos, term).  Documents that are dealt out by
    (slug, pos), as those of ``lexical_docs`` are, need no further exchange; others
    (``tagged_docs``, whose word arrays outweigh the pairs) shuffle their distinct
    (document, term) pairs.  ``first_i`` is the
    term's first index in the document, ``dl`` the document length.  Empty
    documents yield no rows; their count enters through ``stats_from_docs``.
    """
    ns = tuple(ns)
    if len(ns) == 1:
        levels = docs.select("slug", "pos", F.lit(ns[0]).alias("n"),
                             ngrams(F.col("words"), ns[0]).alias("grams"))
    else:
        arr = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("words"), n).alias("grams"))
                        for n in ns])
        levels = docs.select("slug", "pos", F.inline_outer(arr))
    # dl is computed before the generator so that exploded rows do not carry
    # the whole array along.  The outer generator evaluates the (interpreted)
    # n-gram array once per row; the inner one re-evaluates it per element.
    # Its empty-document row has a NULL position and is dropped.
    x = (levels.select("slug", "n", "pos", F.size("grams").alias("dl"), "grams")
         .select("slug", "n", "pos", "dl", F.posexplode_outer("grams").alias("i", "term"))
         .where(F.col("i").isNotNull()))
    return (x.groupBy("slug", "n", "pos", "term")
            .agg(F.count("*").alias("f"), F.min("i").alias("first_i"), F.max("dl").alias("dl")))


def stats_from_docs(docs: DataFrame, ns=(1,)) -> DataFrame:
    """(slug, n, n_docs, total, avgdl) from the documents themselves.

    The n-gram document length is max(words - n + 1, 0), so no n-gram is
    built and nothing is exploded: one narrow pass and a one-row-per-store
    aggregate.  (Reading the shuffled term table twice instead would rely on
    exchange reuse, which these plans, containing lambda functions, did not
    get in our runs.)
    """
    ns = tuple(ns)
    size = F.col("n_words") if "n_words" in docs.columns else F.size("words")
    lv = F.array(*[F.struct(F.lit(n).alias("n"), F.greatest(size - n + 1, F.lit(0)).alias("dl"))
                   for n in ns])
    return (docs.select("slug", F.inline_outer(lv))
            .groupBy("slug", "n").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total"))
            .withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs"))
                        .otherwise(F.lit(1.0))))


def idf(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1)."""
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(docs: DataFrame, ns=(1,), k1: float = 1.5, b: float = 0.75, n_stores: int | None = None,
         n_bytes: int | None = None, top: int | None = None) -> DataFrame:
    """Corpus BM25 of every term of ``docs`` for each n in ``ns``.

    ``n_bytes`` is given for documents as ``lexical_docs`` deals them out, with that many bytes of
    text: their terms are then counted and sent as blocks (``term_blocks``), if ``n_stores``
    proves the statistics small.  The rows are the same; with ``top`` a bucket of terms gives only those
    that may be among the first ``top`` by score of a store and n.
    """
    ns = tuple(ns)
    stats = stats_from_docs(docs, ns)
    if n_bytes is None or n_stores is None or n_stores * len(ns) > BROADCAST_ROWS:
        return bm25_terms(term_freq(docs, ns), stats, k1, b, n_stores, len(ns))
    return _scored(merged_terms(docs, stats, ns, k1, b, n_bytes, top))


def exact_parts(x: Column) -> list[Column]:
    """A non-negative double as two whole numbers, x = (whole + rest / 2**30) / 2**20
    up to 2**-50; their sums as longs are exact, whatever the order of rows, for
    8 billion rows of a group."""
    scaled = x * F.lit(float(WHOLE))
    whole = F.floor(scaled)
    return [whole, F.floor((scaled - whole) * F.lit(float(REST)))]


def from_parts(whole: Column, rest: Column) -> Column:
    return (whole + rest / F.lit(float(REST))) / F.lit(float(WHOLE))


def bm25_terms(tf: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75,
               n_stores: int | None = None, n_levels: int = 3) -> DataFrame:
    """(slug, n, term, df, tf, n_docs, score, first_pos, first_i): corpus BM25 of every term.

    score = sum over documents of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl)).
    (first_pos, first_i) is the term's first appearance (tie-break).  Documents'
    shares are summed as whole numbers (``exact_parts``), so equal terms have equal
    scores however the rows are partitioned.

    ``stats`` (``stats_from_docs``: one row per store and n) is broadcast when
    ``n_stores`` proves it small; otherwise it is shuffle-joined.
    """
    st = stats
    st = st.select("slug", "n", "n_docs", "avgdl")
    bound = None if n_stores is None else n_stores * n_levels
    t = tf.join(broadcast_if(st, bound), ["slug", "n"])
    f = F.col("f")
    dl = F.col("dl")
    norm = f * F.lit(k1 + 1.0) / (f + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.col("avgdl")))
    whole, rest = exact_parts(F.col("norm"))
    agg = (t.withColumn("norm", norm).groupBy("slug", "n", "term")
           .agg(F.count("*").alias("df"), F.sum("f").alias("tf"),
                F.sum(whole).alias("whole"), F.sum(rest).alias("rest"),
                F.max("n_docs").alias("n_docs"), F.min("pos").alias("first_pos"),
                F.min_by("first_i", "pos").alias("first_i")))
    return _scored(agg)


def _scored(agg: DataFrame) -> DataFrame:
    """Merged terms with their score in place of its two sums."""
    score = F.when(F.col("term").isNotNull(), idf(F.col("n_docs"), F.col("df"))
                   * from_parts(F.col("whole"), F.col("rest")))
    return agg.withColumn("score", score).drop("whole", "rest")


def word_freq(tf: DataFrame) -> DataFrame:
    """(slug, word, count, first_pos, first_i): corpus word counts from unigram ``term_freq``.

    Empty documents give no word.
    """
    return (tf.where(F.col("n") == 1)
            .groupBy("slug", F.col("term").alias("word"))
            .agg(F.sum("f").alias("count"), F.min("pos").alias("first_pos"),
                 F.min_by("first_i", "pos").alias("first_i")))


def top_k(df: DataFrame, k: int, order: list, by=("slug",), rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group in ``order``; adds a 1-based rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def score_order() -> list:
    """Score descending, then first appearance."""
    return [F.col("score").desc_nulls_last(), F.col("first_pos").asc(), F.col("first_i").asc()]


def count_order() -> list:
    return [F.col("count").desc(), F.col("first_pos").asc(), F.col("first_i").asc_nulls_last()]


def ranked_terms(bm: DataFrame, k: int) -> DataFrame:
    """Top k terms per (slug, n) by score; the empty-document group is dropped after ranking."""
    return top_k(bm, k, score_order(), by=("slug", "n")).where(F.col("term").isNotNull())


def ranked_words(wf: DataFrame, k: int) -> DataFrame:
    """Top k words per slug by count; the empty-document group is dropped after ranking."""
    return top_k(wf, k, count_order()).where(F.col("word").isNotNull())


def top_words(docs: DataFrame, k: int = 100, min_docs: int = 0,
              n_stores: int | None = None) -> DataFrame:
    """(slug, rank, word, count): the k most frequent kept words per store.

    Stores with fewer than ``min_docs`` documents are left out (the
    small-corpus guard): the per-store document count is an aggregate over
    the document rows (the word arrays are pruned from it), semi-joined to the
    word counts with a broadcast bounded by ``n_stores``.
    """
    tf = term_freq(docs, (1,))
    wf = word_freq(tf)
    if min_docs > 0:
        ok = (docs.groupBy("slug").agg(F.count("*").alias("n_docs"))
              .where(F.col("n_docs") >= min_docs).select("slug"))
        n_stores = store_count(docs) if n_stores is None else n_stores
        wf = wf.join(broadcast_if(ok, n_stores), "slug", "left_semi")
    return ranked_words(wf, k).select("slug", "rank", "word", "count")


def top_terms(docs: DataFrame, ns=(1,), k: int = 100, cfg: AnalysisConfig = DEFAULT,
              n_stores: int | None = None, n_bytes: int | None = None) -> DataFrame:
    """(slug, n, rank, term, score): BM25 top k per store and n, score rounded to 2.

    Stores with fewer than ``cfg.min_docs`` documents are left out.
    ``n_stores`` (counted when not given) bounds the statistics broadcast.
    ``n_bytes``: see ``bm25``.
    """
    n_stores = store_count(docs) if n_stores is None else n_stores
    bm = bm25(docs, ns, cfg.k1, cfg.b, n_stores, n_bytes, k)
    bm = bm.where(F.col("n_docs") >= cfg.min_docs)
    return (ranked_terms(bm, k)
            .select("slug", "n", "rank", "term", F.round("score", 2).alias("score")))


def mention_counts(neg_reviews: DataFrame, vocab: DataFrame, k: int = 50,
                   lower: bool = False, vocab_rows: int | None = None) -> DataFrame:
    """(slug, rank, word, count): substring hits of vocabulary words in negative texts.

    ``vocab`` is (slug, rank, word), e.g. the top 100 words.  Counts are
    non-overlapping substring occurrences summed over the store's negative
    texts; words with no hit are dropped; ranked by count then vocabulary rank.
    One pass over each text finds all words (``operators.patterns``).
    """
    text = F.lower(F.col("text")) if lower else F.col("text")
    hits = pattern_counts(neg_reviews.select("slug", text.alias("text")),
                          vocab.select("slug", F.col("rank").alias("vrank"), "word"), vocab_rows)
    return (top_k(hits, k, [F.col("count").desc(), F.col("vrank").asc()])
            .select("slug", "rank", "word", "count"))
