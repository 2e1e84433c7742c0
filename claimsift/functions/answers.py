"""Expressions around tags, requests and answers of an external classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimsift.fixed_values import ALLOWED_TAGS, MIN_REQUEST_CHARS, PROMPT_HEAD, PROMPT_TAIL, UNKNOWN_CATEGORY
from claimsift.functions.text import _col, strip_text, web_trim


def build_prompt(claim: Column | str) -> Column:
    """The fixed frame around the claim; a missing claim gives a missing prompt."""
    return F.concat(F.lit(PROMPT_HEAD), _col(claim), F.lit(PROMPT_TAIL))


def normalise_prediction(answer: Column | str, categories: Sequence[str]) -> Column:
    """First category in alphabetical order contained in the answer, ignoring case; else unknown."""
    low = F.lower(_col(answer))
    hits = [F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in sorted(categories)]
    return F.coalesce(*hits, F.lit(UNKNOWN_CATEGORY))


def normalise_tag(answer: Column | str, allowed: Sequence[str] = ALLOWED_TAGS) -> Column:
    """Equal tag, else first tag in list order containing or contained in the answer, else the first tag.

    An answer that is blank after trimming is contained in every tag, hence also gives the first one.
    """
    low = F.lower(web_trim(answer))
    equal = [F.when(low == t.lower(), F.lit(t)) for t in allowed]
    near = [F.when(F.contains(low, F.lit(t.lower())) | F.contains(F.lit(t.lower()), low), F.lit(t)) for t in allowed]
    return F.coalesce(*equal, *near, F.lit(allowed[0]))


def clean_manual_tag(tag: Column | str) -> Column:
    """Empty or missing clears the tag; anything else is trimmed (blanks only give the empty string)."""
    return F.when(_col(tag) != "", web_trim(tag))


def parse_claim_id(text: Column | str) -> Column:
    """Leading whole number of the text, null when there is none."""
    digits = F.regexp_extract(web_trim(text), r"^([+-]?[0-9]+)", 1)
    return digits.try_cast("bigint")


def request_status(claim: Column | str) -> Column:
    """``too_short`` below three raw characters or missing, ``empty`` when blank, else ``valid``."""
    c = _col(claim)
    return (
        F.when(c.isNull() | (F.char_length(c) < MIN_REQUEST_CHARS), F.lit("too_short"))
        .when(strip_text(c) == "", F.lit("empty"))
        .otherwise(F.lit("valid"))
    )


def confidence(probabilities: Column | str, class_index: Column | str) -> Column:
    """Probability of the predicted class, four decimals."""
    return F.round(F.get(_col(probabilities), _col(class_index).cast("int")), 4)
