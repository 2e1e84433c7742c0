"""Text expressions: stripping, word counts, tokens, stop words and n-grams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.fixed_values import TOKEN_PATTERN, WEB_WHITESPACE, WHITESPACE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all_but(characters: str) -> str:
    """Pattern class of every other character, as plain ranges: several times faster than a negated class."""
    ranges, start = [], 0
    for code in [*sorted(map(ord, characters)), 0x110000]:
        if code > start:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{code - 1:x}}}")
        start = code + 1
    return f"[{''.join(ranges)}]"


WORD_PATTERN = f"{_all_but(WHITESPACE)}+"


def strip_text(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind; ``trim`` would remove blanks only."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def web_trim(c: Column | str) -> Column:
    """The same with the whitespace set of the web application."""
    return F.btrim(_col(c), F.lit(WEB_WHITESPACE))


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated pieces."""
    return F.regexp_count(_col(c), F.lit(WORD_PATTERN))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def tokenise(c: Column | str) -> Column:
    """Lower-cased runs of at least two word characters of any script; null gives no tokens."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def default_stop_words() -> list[str]:
    """Spark's English list, cut into the pieces the tokeniser can produce."""
    words = StopWordsRemover.loadDefaultStopWords("english")
    return sorted({piece for w in words for piece in w.lower().split("'") if len(piece) >= 2})


def remove_words(tokens: Column | str, words: Iterable[str]) -> Column:
    """Drop the given tokens (stop words, masks); a hash look-up per token."""
    words = list(words)
    return F.filter(_col(tokens), lambda t: ~t.isin(words)) if words else _col(tokens)


def ngrams(tokens: str, n: int) -> Column:
    """Runs of ``n`` consecutive tokens joined by one blank; ``sequence`` counts down, hence the guard."""
    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(F.col(tokens), i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def with_tokens(df: DataFrame, text: str = "claim", out: str = "tokens", stop_words: Iterable[str] = ()) -> DataFrame:
    """Add the token array without stop words and masks."""
    return df.withColumn(out, remove_words(tokenise(text), stop_words))


def with_ngrams(df: DataFrame, tokens: str = "tokens", out: str = "terms", low: int = 1, high: int = 2) -> DataFrame:
    """Add the n-grams of ``low``..``high`` tokens."""
    parts = [F.col(tokens) if n == 1 else ngrams(tokens, n) for n in range(low, high + 1)]
    return df.withColumn(out, parts[0] if len(parts) == 1 else F.concat(*parts))


def explode_terms(df: DataFrame, terms: Column | str, out: str, *keep: str) -> DataFrame:
    """One row per array element.

    The outer form is used on purpose: for the inner form Spark adds a ``size(...) > 0`` filter above
    the scan, which would tokenise every text several times.
    """
    return df.select(*keep, F.explode_outer(_col(terms)).alias(out)).where(F.col(out).isNotNull())
