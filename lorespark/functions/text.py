"""Text normalisation and matching as Column expressions.

Java's ``\\s`` and ``\\w`` are ASCII-only, so patterns state Unicode classes.
Only the compatibility normal forms need Python, and only for strings that
hold a character outside the ranges known to be stable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
#: white space that has to change: runs, and single characters other than a blank
_UNEVEN_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]{2,}|[\s\x1c-\x1f\x85\p{Z}&&[^ ]]"
_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

# ASCII, Latin-1 letters and common dashes/quotes are fixed points of NFKC;
# this class lists everything else, as a positive class scans faster.
_NEEDS_NFKC = r"[\x{80}-\x{BF}\x{100}-\x{2011}\x{2016}\x{2017}\x{201F}-\x{10FFFF}]"


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii_udf(values: pd.Series) -> pd.Series:
    def fold(value: str) -> str:
        return unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()

    return values.map(fold, na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC; stable strings reach the Python worker only as nulls."""
    # the lengths tell plain ASCII without a scan by pattern
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(_NEEDS_NFKC)
    return F.coalesce(_nfkc_udf(F.when(odd, text)), text)


def fold_ascii(text: Column) -> Column:
    """NFKD then drop everything outside ASCII."""
    return F.coalesce(_ascii_udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def casefold(text: Column) -> Column:
    """Lower case with the sharp s unfolded (other special folds are not covered)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def strip(text: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def unify_newlines(text: Column) -> Column:
    return _replaced(_replaced(text, "\r\n", "\n"), "\r", "\n")


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def runs_replaced(text: Column, least: str, pattern: str, new: str) -> Column:
    """A pattern scan only of texts that hold ``least``, without which the pattern cannot match."""
    return F.transform(
        F.array(text), lambda t: F.when(F.contains(t, F.lit(least)), F.regexp_replace(t, pattern, new)).otherwise(t)
    )[0]


def clean_text(text: Column) -> Column:
    """Tidy raw text: NULs, line ends, blank runs, then at most one empty line."""
    out = _replaced(unify_newlines(_replaced(text, "\x00", " ")), "\t", " ")
    out = runs_replaced(out, "  ", " {2,}", " ")
    # blanks are single ones now
    out = _replaced(_replaced(out, " \n", "\n"), "\n ", "\n")
    out = runs_replaced(out, "\n\n\n", "\n{3,}", "\n\n")
    return strip(out)


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, _UNEVEN_SPACE, " "))


def normalize_whitespace(text: Column) -> Column:
    return collapse_space(nfkc(text))


def key_of(text: Column) -> Column:
    """Comparison key of already space-normalised text: folded words only."""
    return strip(F.regexp_replace(casefold(text), f"{NON_WORD}+", " "))


def normalize_key(text: Column) -> Column:
    return key_of(normalize_whitespace(text))


def slug_of_ascii(text: Column, default: str | None = None) -> Column:
    slug = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    slug = F.nullif(F.regexp_replace(slug, r"^-+|-+$", ""), F.lit(""))
    return slug if default is None else F.coalesce(slug, F.lit(default))


def slugify(text: Column, default: str = "item") -> Column:
    return slug_of_ascii(fold_ascii(text), default)


def normalize_alias(text: Column) -> Column:
    return collapse_space(casefold(nfkc(text)))


def chunk_search_text(text: Column) -> Column:
    """Stored search form of a chunk: keeps line structure, does not strip."""
    out = nfkc(unify_newlines(text))
    out = F.regexp_replace(out, r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]+", " ")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def term_pattern(term: str) -> str:
    """Case-insensitive whole-term pattern for a literal term."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    return f"(?iu)(?<!{WORD}){quoted}(?!{WORD})"


def any_term_pattern(terms: Sequence[str]) -> str:
    """The same pattern for any of several terms; borders are tested once for all."""
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms)
    return f"(?iu)(?<!{WORD})(?:{quoted})(?!{WORD})"


def term_pattern_of(term: Column) -> Column:
    """The same pattern built from a term column, for rule-table joins."""
    quoted = F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit(f"(?iu)(?<!{WORD})"), quoted, F.lit(f"(?!{WORD})"))


def contains_term(text: Column, term: str | Column) -> Column:
    if isinstance(term, str):
        return text.rlike(term_pattern(term))
    return F.regexp_like(text, term_pattern_of(term))


def count_substring(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal, non-empty needle."""
    # lengths in bytes are known without a scan
    removed = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return (removed / F.octet_length(needle)).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NON_SPACE}+")).cast("bigint")


def query_tokens(text: Column) -> Column:
    """Search tokens in order, duplicates kept."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_'-]+)"), 1)
    return F.transform(F.filter(found, lambda t: F.length(t) >= 2), F.lower)


#: A path: a drive or a slash, then text without blank or colon that goes on
#: behind a further separator. Possessive runs, so that time stays linear.
_PATH = r"(?:[A-Za-z]:\\|/)(?=[^ \t:][^ \t:/\\]*+[/\\][^ \t:])[^ \t:]++"


def safe_message(text: Column, default: str = "Parsing failed") -> Column:
    """Failure text fit for users: one line, paths hidden; its length is kept."""
    out = F.regexp_replace(collapse_space(text), _PATH, "[internal path]")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def error_code(text: Column, default: str = "PARSER_ERROR") -> Column:
    out = F.regexp_replace(F.upper(strip(text)), r"[^A-Z0-9_]+", "_")
    out = F.btrim(out, F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))
