"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

FENCE = "```"
JSON_FENCE = "```json"


def strip_space(text: Column) -> Column:
    """Text without white space at either end.

    Most texts have none there: the trim, which looks up every character, is
    left to those that do.
    """
    first, last = F.left(text, F.lit(1)), F.right(text, F.lit(1))
    has_space = first.isin(*WHITE_SPACE) | last.isin(*WHITE_SPACE)
    return F.when(has_space, F.btrim(text, F.lit(WHITE_SPACE))).otherwise(text)


def contains_ignore_case(text: Column, needle: str) -> Column:
    """True where `needle` occurs in `text` in any letter case; null is ''."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(F.lit(needle)))


def bound_text(text: Column, max_chars: int) -> Column:
    """The first `max_chars` characters; null stays null."""
    return F.left(text, F.lit(max_chars))


def without_fences(stripped: Column) -> Column:
    """A stripped text that begins with a fence without all its fences; any other as it is."""
    without_fence = F.replace(stripped, F.lit(FENCE), F.lit(""))
    without_json_fence = F.replace(
        F.replace(stripped, F.lit(JSON_FENCE), F.lit("")), F.lit(FENCE), F.lit("")
    )
    return (
        F.when(F.startswith(stripped, F.lit(JSON_FENCE)), without_json_fence)
        .when(F.startswith(stripped, F.lit(FENCE)), without_fence)
        .otherwise(stripped)
    )


def strip_code_fences(text: Column) -> Column:
    """A model response without its Markdown code fence.

    Only a text that begins with a fence is touched, and then every fence in it
    is removed. Prose before the fence stays, and so does the fence. Over many rows
    the three steps are better columns of their own, each computed once.
    """
    return strip_space(without_fences(strip_space(text)))
