"""Stable ids, fingerprints, canonical keys, cursors and name normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def joined(*parts: Column, by: str = "|") -> Column:
    """Parts joined by a separator; a null part is empty, not left out."""
    return F.concat_ws(by, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 32 hex digits that follow from the parts alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined(*parts), 256), 1, 32))


def fingerprint(document: Column) -> Column:
    """Digest of a JSON document that doesn't depend on its keys' order."""
    return F.sha2(F.to_json(F.parse_json(document)), 256)


def squeezed(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def normalized_name(text: Column) -> Column:
    """NFKC form of a name, squeezed. Spark has no NFKC; ASCII names, which it leaves alone, go to Python as nulls."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return squeezed(F.when(plain, text).otherwise(_nfkc(F.when(~plain, text))))


def cursor(key: Column) -> Column:
    """URL-safe base64 of a key, without padding."""
    return F.rtrim(F.translate(F.base64(key.cast("string").cast("binary")), "+/", "-_"), F.lit("="))


def key_of(cursor_text: Column) -> Column:
    plain = F.translate(cursor_text, "-_", "+/")
    padding = F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int"))
    return F.unbase64(F.concat(plain, padding)).cast("string")
