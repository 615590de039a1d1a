"""Column-level functions (no DataFrame in, no DataFrame out)."""

from reviewlens.functions.dates import (micros_to_date, micros_to_local,  # noqa: F401
                                        month_of, ntz_to_micros, year_of)
from reviewlens.functions.text import (canonical_url, chart_label,  # noqa: F401
                                       clean_label, detect_lang, has_text,
                                       is_reply_echo, keep_rule, keep_tokens,
                                       keep_words, lexical_count, lexical_pattern,
                                       lexical_words, ngrams, parse_rating,
                                       pick_text, reply_core, review_url,
                                       slugify, substring_count, token_words,
                                       tokenize, ustrip)
