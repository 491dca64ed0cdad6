"""Type names of the SQL dialect, and coercion of written values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Unsupported

#: fixed values: spellings of each type; all integers have 64 bits
SPELLINGS = {
    "INTEGER": ("INT", "INTEGER", "BIGINT"),
    "FLOAT": ("FLOAT", "DOUBLE", "REAL"),
    "TEXT": ("TEXT", "VARCHAR", "CHAR", "STRING"),
    "BOOLEAN": ("BOOLEAN", "BOOL"),
    "TIMESTAMP": ("TIMESTAMP",),
    "DATE": ("DATE",),
    "UUID": ("UUID",),
    "JSON": ("JSON", "JSONB"),
}
SPARK = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "UUID": T.StringType(), "JSON": T.StringType()}
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def named(spelling: str) -> str:
    """The type's own name: INTEGER, FLOAT, ..., or ARRAY<that>."""
    s = spelling.strip().upper()
    if s.endswith("[]"):
        return f"ARRAY<{named(s[:-2])}>"
    if s.startswith("ARRAY"):
        inner = s[5:].strip()
        return f"ARRAY<{named(inner[1:-1])}>" if inner.startswith("<") else "ARRAY<TEXT>"
    base = s.split("(")[0].split()[0]
    base = "DOUBLE" if base == "DOUBLE" else base
    for name, spellings in SPELLINGS.items():
        if base in spellings:
            return name
    raise Unsupported(f"type {spelling}")


def spark_type(name: str) -> T.DataType:
    return T.ArrayType(spark_type(name[6:-1])) if name.startswith("ARRAY<") else SPARK[name]


def coerce(value: Column, name: str, is_text: bool) -> Column:
    """The value as it is stored in a column of that type."""
    if name.startswith("ARRAY<") and is_text:
        bare = F.regexp_replace(F.trim(value), r"^[{\[]|[}\]]$", "")
        parts = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s*,\s*"))
        return F.transform(parts, lambda p: coerce(F.trim(p), name[6:-1], True))
    if name == "TIMESTAMP" and is_text:
        bare = F.regexp_replace(value, r" UTC$", "")
        return F.coalesce(F.try_to_timestamp(bare), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss")), value.cast("timestamp"))
    if name == "UUID":
        return F.when(value.isNull() | value.cast("string").rlike(UUID), F.lower(value.cast("string"))).otherwise(F.raise_error(F.concat(F.lit("not a uuid: "), value.cast("string"))).cast("string"))
    return value.cast(spark_type(name))
