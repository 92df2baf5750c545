"""Model responses: cleaning, parsing and routing.

Columns used: doc_id, response_text, token_usage (struct of three counters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.functions.text import strip_space, without_fences
from sirenframe.operators.barrier import computed_once
from sirenframe.operators.variants import kind

# --- fixed values -----------------------------------------------------------
PARSE_FAILED = "Failed to parse JSON response: "
CALL_FAILED = "API call failed: "
LIST_ITEM = "list indices must be integers or slices, not str"
ITEM_ASSIGNMENT = "object does not support item assignment"

NOT_JSON = "the text is not one JSON value"


# Only what the JSON grammar allows (and NaN and Infinity, which are let pass).
_STRICT = {"allowSingleQuotes": "false"}


def is_whole_json(text: Column) -> Column:
    """True where all of the text is one JSON value.

    The parser stops after the first value and ignores what follows. The text
    is therefore read as the first of two array items, the second being a hash
    of the text: that hash is the second item only if nothing else stands in
    the text.
    """
    mark = F.xxhash64(text).cast("string")
    pair = F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]"))
    items = F.from_json(pair, "array<string>", _STRICT)
    return F.coalesce((F.size(items) == 2) & (F.get(items, 1) == mark), F.lit(False))


def parse_response(responses: DataFrame) -> DataFrame:
    """Add `content` (JSON text of the record), or `error` and `raw_response`.

    A text that is no JSON, and JSON that is no object, are errors.
    """
    # strip_code_fences in steps: every one of them reads its input several times.
    stripped = responses.withColumn("_stripped", strip_space(F.col("response_text")))
    bare = stripped.withColumn("_bare", without_fences(F.col("_stripped")))
    cleaned = bare.withColumn("_clean", strip_space(F.col("_bare"))).drop("_stripped", "_bare")
    checked = cleaned.withColumn("_whole", is_whole_json(F.col("_clean")))
    whole, clean = F.col("_whole"), F.col("_clean")
    is_object = F.startswith(clean, F.lit("{"))
    not_object = F.when(F.startswith(clean, F.lit("[")), F.lit(CALL_FAILED + LIST_ITEM)).otherwise(
        F.concat(
            F.lit(CALL_FAILED + "'"), kind(F.try_parse_json(clean)), F.lit(f"' {ITEM_ASSIGNMENT}")
        )
    )
    return computed_once(
        checked,
        {
            "content": F.when(whole & is_object, clean),
            "error": F.when(~whole, F.lit(PARSE_FAILED + NOT_JSON)).when(~is_object, not_object),
            "raw_response": F.when(~whole, clean),
        },
    ).drop("_clean", "_whole")


def has_error_key(content: Column) -> Column:
    """True where the record has the key `error`, even with a null value.

    The keys are read only where the text holds the word, or an escape that
    might spell it.
    """
    may_have = F.contains(content, F.lit('"error"')) | F.contains(content, F.lit("\\u"))
    has = F.array_contains(F.json_object_keys(content), "error")
    return F.coalesce(may_have & has, F.lit(False))


def flag_errors(parsed: DataFrame) -> DataFrame:
    """Set `error` also where the record has an `error` key, whatever its value."""
    stated = F.coalesce(F.get_json_object("content", "$.error"), F.lit("None"))
    return parsed.withColumn(
        "error", F.when(has_error_key(F.col("content")), stated).otherwise(F.col("error"))
    )


def route_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) documents. Reported `parsingErrors` do not make a document bad."""
    flagged = flag_errors(parsed)
    return (
        flagged.filter(F.col("error").isNull()).drop("error", "raw_response"),
        flagged.filter(F.col("error").isNotNull()),
    )


def attach_token_usage(content: Column, usage: Column) -> Column:
    """Record JSON with the three counters as its last key `_token_usage`."""
    body = F.rtrim(F.left(content, F.length(content) - 1))
    comma = F.when(F.endswith(body, F.lit("{")), F.lit("")).otherwise(F.lit(","))
    return F.when(
        usage.isNotNull(),
        F.concat(body, comma, F.lit('"_token_usage":'), F.to_json(usage), F.lit("}")),
    ).otherwise(content)


def drop_token_usage(content: Column) -> Column:
    """Record JSON without the key `_token_usage`; other records as they stand."""
    members = F.from_json(content, "map<string, variant>")
    rest = F.map_filter(members, lambda key, _: key != "_token_usage")
    return F.when(F.contains(content, F.lit('"_token_usage"')), F.to_json(rest)).otherwise(content)


def token_usage(responses: DataFrame) -> DataFrame:
    """The three counters of each response as columns."""
    return responses.select("doc_id", "token_usage.*")

