"""Text functions as Catalyst expressions: mixed-script tokens, normalisation, markers. `(?U)` makes \\d and \\s Unicode-aware."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin words with inner joins, numbers, runs of Chinese characters (fixed values).
LATIN = r"[A-Za-z]+(?:[-_.][A-Za-z0-9]+)*"
NUMBER_TOKEN = r"\d+(?:\.\d+)?"
CHINESE = r"[一-鿿]+"
#: Runs of up to so many Chinese characters are a token as a whole too.
WHOLE_RUN = 8


def tokenize(text: Column) -> Column:
    """Lower-case tokens in text order; a Chinese run gives its characters, then its bigrams, then itself if short.

    Texts without Chinese, told by one scan, have nothing to expand.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"(?U){LATIN}|{NUMBER_TOKEN}|{CHINESE}"), F.lit(0))

    def expand(raw: Column) -> Column:
        token, n = F.lower(raw), F.length(raw)
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(token, i, 1))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(token, i, 2))).otherwise(F.array().cast("array<string>"))
        whole = F.when(n <= WHOLE_RUN, F.array(token)).otherwise(F.array().cast("array<string>"))
        return F.when(raw.rlike(f"^{CHINESE}$"), F.concat(chars, pairs, whole)).otherwise(F.array(token))

    plain = F.transform(F.regexp_extract_all(text, F.lit(f"(?U){LATIN}|{NUMBER_TOKEN}"), F.lit(0)), F.lower)
    return F.when(text.rlike("[一-鿿]"), F.flatten(F.transform(found, expand))).otherwise(plain)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: bound as a lambda's variable, which no rule of the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """No white space around numbers' punctuation and brackets, else one space for each run."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s*([,.%/（）()])\s*", "$1"), r"(?U)\s+", " ")


def has_any(text: Column, terms: Iterable[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def last_position(text: Column, terms: Iterable[str]) -> Column:
    """0-based place of the last occurrence of any of the terms; -1 without one."""
    places = [F.when(F.instr(text, t) > 0, F.length(text) - F.instr(F.reverse(text), t[::-1]) - len(t) + 1).otherwise(-1) for t in terms]
    return F.greatest(*places) if len(places) > 1 else places[0]


def rejoin_chinese(text: Column) -> Column:
    """White space between two Chinese characters dropped: what line breaks of a page leave."""
    return F.regexp_replace(text, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", "")
