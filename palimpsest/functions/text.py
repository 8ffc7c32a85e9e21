"""Text functions as Column expressions."""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import rules as R


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed, null to ''."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def has_zero_width(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{R.ZERO_WIDTH}]")


def has_bidi(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{R.BIDI}]")


_HIDDEN = re.compile(f"[{R.ZERO_WIDTH}{R.BIDI}]")


def normalized_value(text: str | None) -> str:
    """NFKC, zero-width and bidi characters to spaces, case folded, white space collapsed."""
    if is_plain_value(text or ""):
        return " ".join((text or "").lower().split())
    spaced = _HIDDEN.sub(" ", unicodedata.normalize("NFKC", text or ""))
    return " ".join(spaced.casefold().split())


def _plain_class() -> str:
    """ASCII and those Latin letters and marks that NFKC leaves alone and that fold to their lower case, as a character class.

    Java looks up single characters below 256 in one table, and tries ranges one by one.
    """
    single = [*range(0x80), *(i for i in range(0xA1, 0x100) if _folds_to_lower(chr(i)))]
    kept = [i for i in [*range(0x100, 0x180), *range(0x2010, 0x2028)] if _folds_to_lower(chr(i))]
    starts, ends = [i for i in kept if i - 1 not in kept], [i for i in kept if i + 1 not in kept]
    return "".join(f"\\x{i:02x}" for i in single) + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def _folds_to_lower(c: str) -> bool:
    return unicodedata.normalize("NFKC", c) == c and c.casefold() == c.lower() and len(c.lower()) == 1 and c not in R.ZERO_WIDTH + R.BIDI


PLAIN = _plain_class()


_OTHER = re.compile(f"[^{PLAIN}]")


def is_plain_value(text: str) -> bool:
    return text.isascii() or not _OTHER.search(text)


def is_plain(text: Column) -> Column:
    """Is lower case all that normalizing changes, but for white space? Where bytes and characters are as many, the text is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) == F.length(text)) | ~text.rlike(f"[^{PLAIN}]")


@F.pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalized_value, na_action="ignore")


# Catalyst would otherwise plan it once for the filter and once for the projection.
normalized_once = _normalized.asNondeterministic()


def normalized_others(text: Column) -> Column:
    """normalized_value of texts that aren't plain, by Python; null for the others."""
    return normalized_once(F.when(~is_plain(text), text))


def normalized_plain(text: Column) -> Column:
    """normalized_value of plain texts, in whole-stage code."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x1c-\x1f]+", " "))


def normalized(text: Column) -> Column:
    return F.coalesce(normalized_others(text), normalized_plain(text))


def rot13(text: Column) -> Column:
    low, high = string.ascii_lowercase, string.ascii_uppercase
    return F.translate(text, high + low, high[13:] + high[:13] + low[13:] + low[:13])


def printable_ratio(text: Column) -> Column:
    """Share of characters that are ASCII printable or ASCII white space; null for ''."""
    kept = F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r\x0b\x0c]", ""))
    return kept / F.nullif(F.length(text), F.lit(0))


def mostly_printable(text: Column) -> Column:
    return F.coalesce(printable_ratio(text) >= R.PRINTABLE_RATIO, F.lit(False))


def either(*values: Column) -> Column:
    """The first value that isn't null or ''; else ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def blob(*parts: Column) -> Column:
    """Parts joined by ' | ', with spaces and bars trimmed off both ends."""
    return F.btrim(F.concat_ws(" | ", *(F.coalesce(p, F.lit("")) for p in parts)), F.lit(" |"))


def token_candidates(text: Column, pattern: str) -> Column:
    """Non-overlapping matches, each cut to the candidate limit."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.substring(t, 1, R.CANDIDATE_CHARS))


def base64_text(token: Column) -> Column:
    """The decoded text, invalid UTF-8 replaced; null if the token isn't base64."""
    return F.substring(F.make_valid_utf8(F.try_to_binary(token, F.lit("base64")).cast("string")), 1, R.DECODED_CHARS)


def hex_text(token: Column) -> Column:
    """The decoded text, invalid UTF-8 replaced; null for an odd number of digits."""
    return F.when(F.length(token) % 2 == 0, F.substring(F.make_valid_utf8(F.unhex(token).cast("string")), 1, R.DECODED_CHARS))
