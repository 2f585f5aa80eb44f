"""Column functions on text: tokenisers, normalising, chunk bounds, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word runs: \\w of Unicode, as Java writes it.
WORD_RUN = "(?U)\\w+"


def normalised(text: Column) -> Column:
    """White space runs become one blank; the ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def word_tokens(text: Column) -> Column:
    """Lower-cased word runs in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def word_text(text: Column) -> Column:
    """Lower-cased text in which the word runs are the runs of bytes that are letters, digits or _ of ASCII, or not ASCII: other characters beyond ASCII are blanks."""
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.regexp_replace(low, "(?U)[\\W&&[^\\x00-\\x7F]]", " "))


def clean_tokens(text: Column, stop_words: tuple[str, ...] = (), least: int = 2) -> Column:
    """Lower case, punctuation to blanks, split; short tokens and stop words go."""
    parts = F.split(F.regexp_replace(F.lower(text), "(?U)[^\\w\\s]", " "), "(?U)\\s+")
    keep = F.filter(parts, lambda t: F.length(t) >= least)
    return F.filter(keep, lambda t: ~t.isin(*stop_words)) if stop_words else keep


def blank_tokens(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda t: t != "")


def fixed_chunks(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Pieces of size characters of the normalised text, each starting size - overlap after the one before; the last ends with the text. Empty or null text: none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap

    def cut(t: Column) -> Column:
        n = F.length(t)
        more = F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(float(step))).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), more), lambda i: F.substring(t, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.coalesce(normalised(text), F.lit(""))), cut)[0]


def cache_key(prefix: str, *parts: Column) -> Column:
    """prefix and the digest of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws(":", *parts)))


def token_estimate(text: Column) -> Column:
    """Four characters a token."""
    return F.length(text) / 4.0


def balanced(text: Column, opening: str, closing: str) -> Column:
    """As many opening as closing marks."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return count(opening) == count(closing)
