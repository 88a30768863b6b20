"""Names: routes, places and file stems."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of place names that say what the place is.
PLACE_SUFFIXES = ("방면", "방향", "쪽", "행", "시", "군", "IC", "JC", "나들목", "분기점", "톨게이트", "TG")


def parse_route(name: Column) -> Column:
    """The route in ``[route] rest``; blank or missing is null."""
    return F.nullif(F.trim(F.regexp_extract(name, r"^\[([^\]]*)\]", 1)), F.lit(""))


def normalise_place(name: Column) -> Column:
    """A place name without blanks, digits, dots, brackets and any run of kind suffixes at its end."""
    bare = F.regexp_replace(name, r"[\s·()\[\]0-9.]+", "")
    return F.regexp_replace(bare, "(" + "|".join(PLACE_SUFFIXES) + ")+$", "")


def composed(name: Column) -> Column:
    """Unicode normal form C, which Spark has no function for: names of files may come decomposed."""

    @F.pandas_udf("string")
    def nfc(names: pd.Series) -> pd.Series:
        return names.map(lambda n: n if n is None or n.isascii() else unicodedata.normalize("NFC", n))

    return nfc(name)


def match_key(name: Column) -> Column:
    """Base name without extension in normal form C, blanks as underscores, lower case; folders end with either slash."""
    path = F.translate(composed(name), "\\", "/")
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(F.trim(base), r"\s+", "_"))
