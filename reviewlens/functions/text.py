"""Column functions for review text, labels and URLs.

Every function returns a ``Column`` built only from Spark built-ins, so the
work stays inside whole-stage code generation (higher-order array functions
run interpreted but still JVM-side, one row at a time, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.config import (PUNCT_TAGS, REPLY_AGE_RE, REPLY_HEADER_RE,
                               STOP_WORDS, UNKNOWN_TAG, VERB_TAGS)

# --- fixed values -----------------------------------------------------------
# Place-URL rewrite that opens the review pane: (old, new) literal pairs, in
# order, then the suffix.
REVIEW_URL_REWRITES = (("!4m6!3m5", "!4m8!3m7"), ("!16s", "!9m1!1b1!16s"))
REVIEW_URL_SUFFIX = "?entry=ttu"
# Page-title suffix and address-label prefix removed from resolved places.
TITLE_SUFFIX = " - Google 地圖"
ADDRESS_PREFIX = "地址: "
# Script classes of the language guess (first match wins: ja, ko, en, else zh).
KANA_CLASS = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"
HANGUL_CLASS = r"[\x{AC00}-\x{D7AF}]"
# Latin letters, Latin-1 letters, the whitespace of a browser regex, ASCII
# digits and the listed punctuation.
EN_CLASS = (r"[a-zA-ZÀ-ÿ\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}0-9.,!?'\"()\-:;]")
# CJK block kept in chart labels besides word characters and whitespace.
CJK_RANGE = r"\x{4E00}-\x{9FFF}"
# --- end of fixed values ----------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip Unicode whitespace at both ends (a plain ``trim`` only drops U+0020)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def has_text(c) -> Column:
    """True for a non-NULL, non-empty string (whitespace-only counts as text)."""
    return F.coalesce(F.length(_c(c)), F.lit(0)) > 0


def slugify(c) -> Column:
    """Non-word characters to ``_``, strip ``_``, lower-case, first 30 chars."""
    x = F.regexp_replace(_c(c), r"[^\p{L}\p{N}_]", "_")
    x = F.regexp_replace(x, r"^_+|_+$", "")
    return F.left(F.lower(x), F.lit(30))


def canonical_url(c) -> Column:
    """Drop everything from ``?entry=`` on."""
    return F.regexp_replace(_c(c), r"\?entry=.*$", "")


def review_url(c) -> Column:
    """Place URL -> URL of its review pane."""
    x = _c(c)
    for old, new in REVIEW_URL_REWRITES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.concat(x, F.lit(REVIEW_URL_SUFFIX))


def clean_label(c, remove: str) -> Column:
    """Remove a fixed affix and strip."""
    return ustrip(F.replace(_c(c), F.lit(remove)))


def detect_lang(c) -> Column:
    """Script-based language guess: ja, ko, en or zh (the default)."""
    t = F.coalesce(_c(c), F.lit(""))
    no_nl = F.regexp_replace(t, "\n", "")
    return (F.when(t.rlike(KANA_CLASS), "ja")
            .when(t.rlike(HANGUL_CLASS), "ko")
            .when(no_nl.rlike("^" + EN_CLASS + r"+\z"), "en")
            .otherwise("zh"))


def parse_rating(c) -> Column:
    """First ASCII digit of a rating label, 0 when there is none."""
    d = F.regexp_extract(_c(c), r"(\d)", 1)
    return F.coalesce(d.try_cast("int"), F.lit(0))


def pick_text(blocks) -> Column:
    """Text blocks of a review card -> struct(text, text_translated).

    Two or more blocks: the first is the translation, the second the original;
    one block is the original.  ``text`` is the original, or the translation
    when the original is empty; ``text_translated`` is the translation when it
    differs from ``text``.
    """
    b = _c(blocks)
    n = F.size(b)
    tr = F.when(n >= 2, F.coalesce(F.get(b, 0), F.lit(""))).otherwise(F.lit(""))
    tx = (F.when(n >= 2, F.coalesce(F.get(b, 1), F.lit("")))
          .when(n == 1, F.coalesce(F.get(b, 0), F.lit("")))
          .otherwise(F.lit("")))
    text = F.when(tx != "", tx).otherwise(tr)
    trans = F.when((tr != "") & (tr != text), tr).otherwise(F.lit(""))
    return F.struct(text.alias("text"), trans.alias("text_translated"))


def reply_core(reply) -> Column:
    """Owner reply without its header and relative age, stripped."""
    x = F.regexp_replace(_c(reply), REPLY_HEADER_RE, "")
    x = F.regexp_replace(x, REPLY_AGE_RE, "")
    return ustrip(x)


def is_reply_echo(text, reply) -> Column:
    """True when the review text starts with (the first 15 chars of) the reply."""
    core = reply_core(reply)
    return (has_text(reply) & has_text(text) & (F.length(core) > 0)
            & ustrip(_c(text)).startswith(F.left(core, F.lit(15))))


def chart_label(c) -> Column:
    """Keep word chars, whitespace and CJK; strip; ``?`` when nothing is left."""
    x = ustrip(F.regexp_replace(_c(c), r"(?U)[^\p{L}\p{N}_\s" + CJK_RANGE + "]", ""))
    return F.when(x == "", F.lit("?")).otherwise(x)


def substring_count(text, word) -> Column:
    """Non-overlapping occurrences of ``word`` in ``text`` (0 for NULL text)."""
    t = F.coalesce(_c(text), F.lit(""))
    w = _c(word)
    return ((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("long")


def tokenize(c, lower: bool = False) -> Column:
    """Default lexical tokenizer: maximal runs of letters, in order."""
    t = _c(c)
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(r"\p{L}+"), 0)


def lexical_pattern(tag: str = UNKNOWN_TAG, stop_words=STOP_WORDS, punct_tags=PUNCT_TAGS,
                    verb_tags=VERB_TAGS) -> str:
    """One regex for ``keep_words(tokenize(text))`` when every word has ``tag``.

    Tokens are maximal letter runs; the keep rule then drops one-letter runs
    (unless ``tag`` is a verb tag) and runs equal to a stop word.  Both become
    part of the pattern: a minimum run length, and a negative lookahead over
    the stop words that consist of letters only (others can never be a run).
    The lookbehind keeps matches at run starts.  No per-element lambda runs.
    """
    if tag in punct_tags:
        return r"[^\s\S]"  # matches nothing: every token would be dropped
    min_len = 1 if tag in verb_tags else 2
    words = sorted({w for w in stop_words
                    if len(w) >= min_len and w.isalpha()}, key=lambda w: (-len(w), w))
    stop = ""
    if words:
        alts = "|".join(r"\Q" + w + r"\E" for w in words)
        stop = r"(?!(?:" + alts + r")(?!\p{L}))"
    return r"(?<!\p{L})" + stop + r"\p{L}{" + str(min_len) + ",}"


def lexical_words(c, lower: bool = False, **sets) -> Column:
    """Kept words of the default tokenizer (same result as keep_words(tokenize(c)))."""
    t = _c(c)
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(lexical_pattern(**sets)), 0)


def lexical_count(c, lower: bool = False, **sets) -> Column:
    """Number of kept words of the default tokenizer (no array is built)."""
    t = _c(c)
    if lower:
        t = F.lower(t)
    return F.regexp_count(t, F.lit(lexical_pattern(**sets)))


def keep_rule(word: Column, tag: Column, stop_words=STOP_WORDS,
              punct_tags=PUNCT_TAGS, verb_tags=VERB_TAGS) -> Column:
    """A token is kept unless it is punctuation, a stop word, or a one-char non-verb."""
    return ~(tag.isin(*punct_tags) | word.isin(*stop_words)
             | ((F.length(word) == 1) & ~tag.isin(*verb_tags)))


def keep_tokens(tokens, **sets) -> Column:
    """Filter an ``array<struct<word,tag>>`` with the keep rule."""
    return F.filter(_c(tokens), lambda t: keep_rule(t["word"], t["tag"], **sets))


def keep_words(words, tag: str = UNKNOWN_TAG, **sets) -> Column:
    """Keep rule over untagged words (every word carries the same ``tag``)."""
    return F.filter(_c(words), lambda w: keep_rule(w, F.lit(tag), **sets))


def token_words(tokens) -> Column:
    """``array<struct<word,tag>>`` -> ``array<string>`` of words."""
    return F.transform(_c(tokens), lambda t: t["word"])


def ngrams(words, n: int) -> Column:
    """Space-joined n-grams in order; shorter than n gives an empty array."""
    w = _c(words)
    if n == 1:
        return w
    size = F.size(w)
    k = F.greatest(size - n + 1, F.lit(0))
    # n shifted copies zipped together: the lambda reads only its argument,
    # so the cost is linear in the document length.
    shifted = F.arrays_zip(*[F.slice(w, j + 1, k).alias(f"g{j}") for j in range(n)])
    grams = F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"g{j}"] for j in range(n)]))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))
