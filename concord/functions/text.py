"""Text normalisation column functions (formatting for comparison, truncation,
file-name parsing).  All are built-in Spark expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as an explicit class, so Spark (Java regex) and other engines agree.
WS = r"[ \t\n\r\f\x0B]"
# Its runs that are not one space already: most sentences have none, so nothing is copied.
WS_RUN = r"[ \t\n\r\f\x0B]{2,}|[\t\n\r\f\x0B]"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace (Spark's trim strips spaces only, unless told)."""
    return F.btrim(_c(c), F.lit(" \t\n\r\f\x0B"))


def format_sentence(c) -> Column:
    """Strip, put a space before ? . , ! ' unless one is there, collapse whitespace."""
    s = strip_ws(c)
    s = F.regexp_replace(s, r"([?.,!'])", " $1")
    return F.regexp_replace(s, WS_RUN, " ")


def strip_final_punct(c) -> Column:
    """Lower-case and drop one final ' .' / ' ?' / ' !'."""
    return F.regexp_replace(F.lower(_c(c)), r" [.?!]$", "")


def words(c) -> Column:
    """Whitespace tokens with empty strings removed (Python ``str.split()``)."""
    t = F.regexp_replace(strip_ws(_c(c)), WS_RUN, " ")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def first_word(c) -> Column:
    """First whitespace-delimited word, NULL when there is none (one regex, no split)."""
    w = F.regexp_extract(_c(c), rf"^{WS}*([^ \t\n\r\f\x0B]+)", 1)
    return F.when(w != "", w)


def truncate_words(c, n) -> Column:
    """First ``n`` whitespace words joined by single spaces."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.array_join(F.slice(words(c), 1, n), " ")


def eos_truncate(c, k) -> Column:
    """First k+1 words followed by ' [EOS]' (NULL when k is NULL)."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.concat(truncate_words(c, k + 1), F.lit(" [EOS]"))


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def surface(words_arr) -> Column:
    """Join words, capitalise, append a period (sentence surface string)."""
    return F.concat(capitalize(strip_ws(F.array_join(words_arr, " "))), F.lit("."))


def name_prefix(path_col) -> Column:
    """Language of a data file: basename text before the first '-'."""
    base = F.regexp_extract(_c(path_col), r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^(.*?)-", 1)


def dataset_name(path_col) -> Column:
    """Dataset name: basename without a trailing .json.gz."""
    base = F.regexp_extract(_c(path_col), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"\.json\.gz$", "")


def clean_model_name(c) -> Column:
    """Drop single and double quotes from a model name."""
    return F.regexp_replace(_c(c), "[\"']", "")
