"""Counting many fixed words in each text, in one pass.

A text is run through one Aho-Corasick automaton of its store's vocabulary.  The automaton
reports every occurrence by its end; per word, an occurrence counts if it starts
behind the last one counted, which gives the leftmost non-overlapping occurrences,
the same as replacing the word by nothing and comparing lengths.  Texts meet
their vocabulary as one list per store, so there is one row per text, never one per text
and word, and what leaves a task is one row per store and word of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import broadcast_if, ship_package

AUTOMATA = 512                # vocabularies whose automata a task keeps
FLUSH = 100_000               # counts a task holds before it gives them out


class Vocabulary:
    """The words of one store and their automaton; empty words never occur."""

    def __init__(self, words: list[dict]):
        import ahocorasick
        self.rows = [(w["vrank"], w["word"]) for w in words if w["word"]]
        self.size = [len(w) for _, w in self.rows]
        self.automaton = ahocorasick.Automaton()
        for k, (_, w) in enumerate(self.rows):
            same = self.automaton.get(w, ())         # a word may stand at several ranks
            self.automaton.add_word(w, (*same, k))
        if self.rows:
            self.automaton.make_automaton()

    def count(self, text: str) -> dict[int, int]:
        """Word number -> leftmost non-overlapping occurrences in ``text``."""
        if not self.rows or not text:
            return {}
        ends, out = {}, {}
        for at, which in self.automaton.iter(text):
            if ends.get(which[0], -1) <= at - self.size[which[0]]:
                ends[which[0]] = at
                for k in which:
                    out[k] = out.get(k, 0) + 1
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    held: dict = {}

    def flush() -> pa.RecordBatch:
        rows = [(slug, *word, *n) for (slug, word), n in held.items()]
        held.clear()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          names=["slug", "vrank", "word", "n", "texts"])

    for batch in batches:
        texts, words = batch.column(1).to_pylist(), batch.column(2)
        for i, (slug, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
            if slug not in known:
                if len(known) >= AUTOMATA:
                    known.clear()
                known[slug] = Vocabulary(words[i].as_py())
            vocabulary = known[slug]
            for k, n in vocabulary.count(text).items():
                row = held.setdefault((slug, vocabulary.rows[k]), [0, 0])
                row[0] += n
                row[1] += 1
        if len(held) > FLUSH:
            yield flush()
    yield flush()


def pattern_counts(texts: DataFrame, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """(slug, word, vrank, count, texts): occurrences of each store's words in its texts, and
    the texts that hold one; words that occur nowhere have no row.

    ``texts``: (slug, text); ``vocab``: (slug, vrank, word).  Null and empty texts and
    words meet nothing; a null slug is a store like others.  The vocabulary lists (one row per store) are broadcast when
    ``vocab_rows`` bounds them under the limit; otherwise texts and lists meet in a
    shuffle join, where AQE splits a store that holds many texts.
    """
    ship_package(texts.sparkSession)
    lists = (vocab.where(F.col("word").isNotNull())
             .groupBy(F.col("slug").alias("store")).agg(F.sort_array(F.collect_list(F.struct(F.col("vrank").cast("int").alias("vrank"), "word"))).alias("words")))
    rows = texts.select("slug", "text").where(F.col("text").isNotNull())
    rows = rows.join(broadcast_if(lists, vocab_rows), F.col("slug").eqNullSafe(F.col("store")))
    parts = rows.select("slug", "text", "words").mapInArrow(
        _counted, "slug string, vrank int, word string, n long, texts long")
    return (parts.groupBy("slug", "word", "vrank")
            .agg(F.sum("n").alias("count"), F.sum("texts").alias("texts")))
