"""HTML pages -> one row per repeated card, and review cards -> the ``reviews`` table.

Parsing HTML has no Spark built-in, so each task parses its pages with the
standard-library ``html.parser`` over Arrow batches (one parser per page, nothing leaves
the partition), or, in SQL, through a table function joined ``LATERAL``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewlens.config import REVIEW_CARD, REVIEW_CARD_BLOCKS, REVIEW_CARD_FIELDS, REVIEW_CARD_PHOTOS
from reviewlens.functions.text import detect_lang, parse_rating, pick_text
from reviewlens.session import ship_package

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "source", "track", "wbr"}
# An opening tag ends an open element of these names, unless one of the containers opened in between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROWS_AT_ONCE = 2_000          # cards a task holds before it gives them out


def _match(sel: str, tag: str, classes: set[str]) -> bool:
    """Simple selectors: ``tag``, ``.class``, ``tag.class`` (classes all required)."""
    parts = sel.split(".")
    want_tag, want_cls = parts[0], parts[1:]
    return (not want_tag or want_tag == tag) and all(c in classes for c in want_cls)


class _Cards(HTMLParser):
    """Collects every element that matches ``card``, also inside another card.

    A card has the trimmed text (or, with ``sel@attr``, the attribute) of its first
    descendant per field, of all descendants per list, in document order, and the number of
    descendants per count.  A descendant of a nested card is one of the outer card too.
    An element's text is a stretch of the page's pieces of text, cut when it ends.
    """

    def __init__(self, card: str, fields: dict[str, str], counts: dict[str, str], lists: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.card = card
        self.wanted = [(k, *sel.partition("@")[::2], False) for k, sel in fields.items()] \
            + [(k, *sel.partition("@")[::2], True) for k, sel in lists.items()]
        self.counts, self.fields, self.lists = counts, fields, lists
        self.stack: list[str] = []
        self.cards: list[dict] = []                  # in the order they open
        self.open: list[tuple[int, dict]] = []       # (depth, card)
        self.texts: list[tuple[int, int, list]] = []  # (depth, first piece, places that take the text)
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth] in within:
                    break
                if self.stack[depth] in ends:
                    self._close(depth)
                    break
        attrs = dict(attrs)
        classes = set((attrs.get("class") or "").split())
        places = []
        for _, c in self.open:
            for k, sel in self.counts.items():
                c[k] += _match(sel, tag, classes)
            for k, sel, attr, many in self.wanted:
                if (many or c[k] is None) and _match(sel, tag, classes):
                    value = (attrs.get(attr) or "").strip() if attr else ""
                    if many:
                        c[k].append(value)
                        places += [] if attr else [(c[k], len(c[k]) - 1)]
                    else:
                        c[k] = value
                        places += [] if attr else [(c, k)]
        depth = len(self.stack)
        if _match(self.card, tag, classes):
            new = {k: None for k in self.fields} | {k: [] for k in self.lists} | {k: 0 for k in self.counts}
            self.cards.append(new)
            if tag not in VOID:
                self.open.append((depth, new))
        if tag not in VOID:
            self.stack.append(tag)
            if places:
                self.texts.append((depth, len(self.pieces), places))

    def _close(self, depth: int) -> None:
        """Ends the element at ``depth`` and all inside it."""
        while self.texts and self.texts[-1][0] >= depth:
            _, first, places = self.texts.pop()
            text = "".join(self.pieces[first:]).strip()
            for at, k in places:
                at[k] = text
        while self.open and self.open[-1][0] >= depth:
            self.open.pop()
        if not self.texts:
            self.pieces.clear()
        del self.stack[depth:]

    def handle_endtag(self, tag):
        # closes up to the matching tag (tolerates unclosed children); a tag that is not open is ignored
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        if self.texts:
            self.pieces.append(data)

    def close(self):
        super().close()
        self._close(0)


def parse_cards(html: str | None, card: str, fields: dict[str, str], counts: dict[str, str],
                lists: dict[str, str] | None = None) -> list[dict]:
    """The cards of a page in the order they open; a field without a match is ''."""
    p = _Cards(card, fields, counts, lists or {})
    p.feed(html or "")
    p.close()
    return [{k: "" if v is None else v for k, v in c.items()} for c in p.cards]


def _columns(fields, counts, lists) -> list[tuple[str, str, pa.DataType]]:
    return ([(k, "string", pa.string()) for k in fields] + [(k, "int", pa.int32()) for k in counts]
            + [(k, "array<string>", pa.list_(pa.string())) for k in lists])


def extract_cards(pages: DataFrame, card: str, fields: dict[str, str],
                  counts: dict[str, str] | None = None, key: str | list[str] = "page_id",
                  html: str = "html", lists: dict[str, str] | None = None) -> DataFrame:
    """(key, card, <fields...>, <counts...>, <lists...>): one row per card element of each page.

    ``fields`` maps an output column to a selector (text, trimmed) or
    ``selector@attribute`` of the first match; ``lists`` to one whose matches are all
    kept, in order; ``counts`` to a selector whose matches are counted.  ``key`` names one
    or more columns of any type that are carried along.  Cards inside cards are rows of
    their own.  ``card`` numbers a page's cards from 0 in the order they open.  A null or
    empty page has none.  Rows leave a task in pieces of some thousand.
    """
    counts, lists = counts or {}, lists or {}
    keys = [key] if isinstance(key, str) else list(key)
    made = _columns(fields, counts, lists)
    schema = pages.select(*[F.col(k) for k in keys]).schema
    schema = StructType([*schema.fields, *StructType.fromDDL(
        ", ".join(["card int", *(f"`{name}` {kind}" for name, kind, _ in made)])).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i) for i in range(len(keys))]
            at, rows = [], []

            def flush() -> pa.RecordBatch:
                take = pa.array([i for i, _ in at], pa.int64())
                cols = [c.take(take) for c in own] + [pa.array([n for _, n in at], pa.int32())]
                cols += [pa.array([r[name] for r in rows], kind) for name, _, kind in made]
                at.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(cols, names=[*keys, "card", *(name for name, _, _ in made)])

            for i in range(batch.num_rows):          # one page's text at a time
                for n, c in enumerate(parse_cards(batch.column(len(keys))[i].as_py(), card, fields, counts, lists)):
                    at.append((i, n))
                    rows.append(c)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield flush()
            if rows:
                yield flush()

    ship_package(pages.sparkSession)
    return pages.select(*keys, html).mapInArrow(run, schema)


def register_cards(spark: SparkSession, name: str, card: str, fields: dict[str, str],
                   counts: dict[str, str] | None = None, lists: dict[str, str] | None = None) -> None:
    """Makes ``extract_cards`` a SQL table function of one argument, for
    ``SELECT ... FROM pages p, LATERAL <name>(p.html) c``."""
    counts, lists = counts or {}, lists or {}
    made = _columns(fields, counts, lists)
    ship_package(spark)

    class Cards:
        def eval(self, html: str):
            for n, c in enumerate(parse_cards(html, card, fields, counts, lists)):
                yield (n, *(c[k] for k, _, _ in made))

    spark.udtf.register(name, F.udtf(Cards, returnType=", ".join(["card int", *(f"`{k}` {t}" for k, t, _ in made)])))


# Cards a store's page may hold; positions of the next page begin behind them.
PAGE_STRIDE = 1 << 32


def page_reviews(pages: DataFrame) -> DataFrame:
    """The ``reviews`` rows of review pages: (slug, page, html) -> slug, pos, name, rating, text,
    text_translated, lang, date, owner_reply, photos.

    ``pos`` follows the pages' numbers (from 0) and the cards' order on them, so it is the
    card's number on a store's only page.  Absent parts are '' (rating and photos 0).
    """
    cards = extract_cards(pages, REVIEW_CARD, REVIEW_CARD_FIELDS, {"photos": REVIEW_CARD_PHOTOS}, ["slug", "page"],
                          lists={"blocks": REVIEW_CARD_BLOCKS})
    text = pick_text(F.col("blocks"))
    rows = cards.withColumn("t", text)
    return rows.select(
        "slug", (F.col("page").cast("long") * PAGE_STRIDE + F.col("card")).alias("pos"), "name",
        parse_rating(F.col("stars")).alias("rating"), "t.text", "t.text_translated",
        detect_lang(F.col("t.text")).alias("lang"), "date", "owner_reply", "photos")
