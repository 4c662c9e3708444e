"""Text expressions: trimming, word counts, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.names import MISSING_TOKENS, TEXT_PLACEHOLDER, TITLE_PLACEHOLDER

# The code points that count as whitespace when text is trimmed or split.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)
WORD_BREAK = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace at both ends (plain ``trim`` only knows the space).

    Trimming a set of characters costs a pass over the whole text, which is spared where both ends
    are printable ASCII characters.
    """
    data = col(c).cast("binary")
    inner = lambda at: F.substring(data, at, 1).between(F.lit(b"!"), F.lit(b"~"))
    return F.when(inner(1) & inner(-1), col(c).cast("string")).otherwise(F.btrim(col(c), F.lit(WHITESPACE)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def missing_token_to_null(c: Column | str) -> Column:
    """Exact match on the raw cell, before any trimming."""
    return F.when(~col(c).isin(*MISSING_TOKENS), col(c))


def word_count(c: Column | str) -> Column:
    """Whitespace-separated words; missing, blank and placeholder texts have none."""
    text = strip(c)
    empty = text.isNull() | text.isin("", TEXT_PLACEHOLDER, TITLE_PLACEHOLDER)
    return F.when(empty, F.lit(0)).otherwise(F.size(F.split(text, WORD_BREAK))).cast("int")


def text_key(c: Column | str) -> Column:
    """Digest under which two texts are the same: trimmed and case-folded, 32 bytes."""
    return F.unhex(F.sha2(F.lower(strip(c)), 256))


def spelling(c: Column | str) -> Column:
    """Digest of a text as it stands, 32 bytes."""
    return F.unhex(F.sha2(col(c), 256))


def haystack(text: Column | str, title: Column | str) -> Column:
    return F.lower(F.concat(col(text), F.lit(" "), col(title)))


def cut(c: Column | str, limit: int, trim_end: bool = False) -> Column:
    """At most ``limit`` characters, ending in three dots when something was cut off."""
    head = F.substring(col(c), 1, limit - 3)
    if trim_end:
        head = F.rtrim(head, F.lit(WHITESPACE))
    return F.when(F.length(col(c)) > limit, F.concat(head, F.lit("..."))).otherwise(col(c))


def excerpt(c: Column | str) -> Column:
    return cut(c, 260, trim_end=True)


def sample_cell(c: Column | str) -> Column:
    return cut(c, 70)
