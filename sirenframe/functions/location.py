"""Location text -> territory, place name, street address and apartment."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sirenframe.schemas import TERRITORY_SUFFIXES


def _territory_pattern(suffixes: Sequence[str]) -> str:
    """The territory at the start of a text, as group 1. Possessive: it never gives back a word."""
    words = "|".join(re.escape(s) for s in suffixes)
    second = rf"(?:\s+(?:{words})(?=\s|\z))?+" if suffixes else ""
    return rf"(?s)^\s*+(\S++{second})\s*+"


def _extract(raw: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(raw, pattern, group)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def location_territory(raw: Column, suffixes: Sequence[str] = TERRITORY_SUFFIXES) -> Column:
    """The first word, or the first two where the second is a municipal suffix."""
    return _filled(_extract(raw, _territory_pattern(suffixes), 1))


def location_segments(raw: Column, suffixes: Sequence[str] = TERRITORY_SUFFIXES) -> Column:
    """struct(location_name, street_address, apartment) of what follows the territory.

    `/` parts a place name from an address; without it `&` makes the whole rest
    an intersection; `#` parts an address from an apartment. Each part is one
    pattern over the raw text, so that none is built on another.
    """
    start = _territory_pattern(suffixes)
    name = start + r"([^/]*?)\s*/"
    crossing = start + r"([^/]*&[^/]*?)\s*\z"
    street = start + r"(?![^/]*&[^/]*\z)(?:[^/]*/\s*)?+([^#]*?)\s*(?:#.*)?\z"
    apartment = start + r"(?:[^/]*/[^#]*|(?=[^/&]*\z)[^#]*)#\s*(.*?)\s*\z"
    return F.struct(
        _filled(_extract(raw, name, 2)).alias("location_name"),
        _filled(F.concat(_extract(raw, crossing, 2), _extract(raw, street, 2))).alias(
            "street_address"
        ),
        _filled(_extract(raw, apartment, 2)).alias("apartment"),
    )


def parse_location(raw: Column, suffixes: Sequence[str] = TERRITORY_SUFFIXES) -> Column:
    """struct(raw, territory, location_name, street_address, apartment); null stays null."""
    segments = location_segments(raw, suffixes)
    return F.when(
        raw.isNotNull(),
        F.struct(
            raw.alias("raw"),
            location_territory(raw, suffixes).alias("territory"),
            *[segments[f].alias(f) for f in ("location_name", "street_address", "apartment")],
        ),
    )
