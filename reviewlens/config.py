"""Analysis configuration.

The word and tag lists below are fixed values: the results only match the
original tool when they are exactly these sets.  Everything else (BM25
parameters, top-k sizes, thresholds) is a plain argument with the original
default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# Part-of-speech tags that mark punctuation / whitespace tokens (dropped).
PUNCT_TAGS = (
    "PERIODCATEGORY", "COMMACATEGORY", "PARENTHESISCATEGORY", "PAUSECATEGORY",
    "SEMICOLONCATEGORY", "DASHCATEGORY", "COLONCATEGORY", "EXCLAMATIONCATEGORY",
    "QUESTIONCATEGORY", "ETCCATEGORY", "WHITESPACE",
)
# Stop words (dropped whatever their tag).
STOP_WORDS = (
    "有", "是", "的", "了", "在", "都", "也", "就", "很", "會", "不", "我", "他", "她",
    "你", "這", "那", "到", "被", "把", "跟", "和", "與", "或", "但", "而", "所", "以",
    "因", "為", "又", "再", "還", "才", "只", "從", "讓", "給", "對", "向", "比", "等",
    "著", "過", "得", "地", "…", "～", "~", "＾＾", "&", "ＦＢ", "ＩＧ",
)
# Verb tags: a one-character word is kept only when it carries one of these.
VERB_TAGS = (
    "VA", "VAC", "VB", "VC", "VCL", "VD", "VE", "VF", "VG", "VH", "VHC", "VI", "VJ",
    "VK", "VL", "V_2", "Nv",
)
# Tag given to a word whose label is unknown or missing.
UNKNOWN_TAG = "X"
# Owner-reply header and relative-age prefix removed before the echo test.
REPLY_HEADER_RE = r"(?U)^業主回應\s*"
REPLY_AGE_RE = r"(?U)^\d+\s*(年|個月|週|天)前"
# Marker of the review-list API in captured response URLs.
REVIEW_API_MARKER = "listugcposts"
# Anti-hijacking prefix of captured API bodies.
JSON_GUARD_PREFIX = ")]}'"
# Smallest plausible post timestamp (epoch microseconds).
MIN_POST_MICROS = 1_400_000_000_000_000
# First timestamp that no zone writes with a four-digit year any more (a day before the year 10000).
MAX_POST_MICROS = 253_402_214_400_000_000
# Rating buckets of the histogram, highest first.
RATING_BUCKETS = (5, 4, 3, 2, 1)
# --- end of fixed values ----------------------------------------------------


# --- fixed values: the classes that mark a review card's parts on a page
REVIEW_CARD = ".jftiEf"
REVIEW_CARD_FIELDS = {"name": ".d4r55", "stars": ".kvMYJc@aria-label", "date": ".rsqaWe", "owner_reply": ".CDe7pd"}
REVIEW_CARD_BLOCKS = ".wiI7pd"
REVIEW_CARD_PHOTOS = "button.Tya61d"
# --- end of fixed values


@dataclass(frozen=True)
class AnalysisConfig:
    """Parameters of one analysis run (defaults are the original tool's)."""

    k1: float = 1.5
    b: float = 0.75
    ngram_sizes: tuple[int, ...] = (1, 2, 3)
    top_words: int = 100          # stored word-frequency list
    top_terms: int = 100          # stored BM25 list per n
    chart_words: int = 30
    chart_terms: int = 25
    top_neg_words: int = 50
    chart_neg_words: int = 25
    min_neg_chart_words: int = 6  # chart only when more than 5 words
    neg_max_rating: int = 2
    min_docs: int = 3
    min_month_reviews: int = 2
    min_months: int = 3
    trend_months: int = 6
    trend_window: int = 3
    trend_delta: float = 0.2
    summary_words: int = 15
    summary_keywords: int = 10
    summary_neg_words: int = 5
    lower: bool = False           # the original never folds case
    stop_words: tuple[str, ...] = field(default=STOP_WORDS)
    punct_tags: tuple[str, ...] = field(default=PUNCT_TAGS)
    verb_tags: tuple[str, ...] = field(default=VERB_TAGS)


DEFAULT = AnalysisConfig()
