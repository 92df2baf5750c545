"""Types of JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Type of a JSON value -> its name in the error texts.
_KINDS = {
    "OBJECT": "dict",
    "ARRAY": "list",
    "STRING": "str",
    "BOOLEAN": "bool",
    "VOID": "NoneType",
    "BIGINT": "int",
    "DECIMAL": "float",
    "DOUBLE": "float",
}


def kind(value: Column) -> Column:
    """Type name as the error texts spell it; null for a missing value."""
    schema = F.schema_of_variant(value)
    base = F.substring_index(F.substring_index(schema, "<", 1), "(", 1)
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    integral = F.endswith(schema, F.lit(",0)"))
    return F.when(integral, F.lit("int")).otherwise(F.try_element_at(names, base))
