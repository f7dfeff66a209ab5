"""Property types: what a property may be, how types unify, and their Spark side.

A type is a short string.  Storable ones are those of ``SPARK``; ``null``, ``node`` and
``rel`` exist only while a query is lowered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables.errors import GraphError

BOOL, INT, FLOAT, STRING, DATE, UTC, LOCAL = "boolean", "int64", "float64", "string", "date", "datetime_utc", "datetime_local"
NULL, NODE, REL = "null", "node", "rel"
LISTS = {BOOL: "list_boolean", INT: "list_int64", FLOAT: "list_float64", STRING: "list_string"}
ELEMENTS = {v: k for k, v in LISTS.items()}
NUMERIC = (INT, FLOAT)
SPARK: dict[str, T.DataType] = {
    BOOL: T.BooleanType(),
    INT: T.LongType(),
    FLOAT: T.DoubleType(),
    STRING: T.StringType(),
    DATE: T.DateType(),
    UTC: T.TimestampType(),
    LOCAL: T.TimestampNTZType(),
    **{LISTS[k]: T.ArrayType(t) for k, t in ((BOOL, T.BooleanType()), (INT, T.LongType()), (FLOAT, T.DoubleType()), (STRING, T.StringType()))},
}


def is_list(t: str) -> bool:
    return t in ELEMENTS


def unify(a: str, b: str) -> str:
    """The narrowest type that holds both."""
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if {a, b} == {INT, FLOAT}:
        return FLOAT
    if {a, b} == {LISTS[INT], LISTS[FLOAT]}:
        return LISTS[FLOAT]
    return LISTS[STRING] if is_list(a) and is_list(b) else STRING


def of_spark(t: T.DataType, name: str = "") -> str:
    """The property type of a Spark type."""
    match t:
        case T.BooleanType():
            return BOOL
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return INT
        case T.DecimalType() if t.scale == 0 and t.precision == 20:
            return INT  # unsigned 64-bit integers of Parquet files
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return FLOAT
        case T.StringType() | T.CharType() | T.VarcharType():
            return STRING
        case T.DateType():
            return DATE
        case T.TimestampType():
            return UTC
        case T.TimestampNTZType():
            return LOCAL
        case T.ArrayType():
            inner = of_spark(t.elementType, name)
            return LISTS.get(inner, LISTS[STRING])
        case T.NullType():
            return STRING
    raise GraphError(f"property `{name}` has the type {t.simpleString()}, which no property can have")


def to_json(t: str) -> object:
    return {"datetime": {"utc": t == UTC}} if t in (UTC, LOCAL) else t


def from_json(x: object) -> str:
    if isinstance(x, dict):
        return UTC if x["datetime"]["utc"] else LOCAL
    return str(x)


def typed_null(t: str) -> Column:
    return F.lit(None).cast(SPARK[STRING if t == NULL else t])


def float_text(x: Column) -> Column:
    """Shortest decimal without exponent; integral values with ``.0``; ``inf``, ``-inf``, ``NaN``."""
    plain = F.abs(x).cast("string")
    mantissa = F.split_part(plain, F.lit("E"), F.lit(1))
    exponent = F.try_to_number(F.split_part(plain, F.lit("E"), F.lit(2)), F.lit("S999")).cast("int")
    whole = F.split_part(mantissa, F.lit("."), F.lit(1))
    part = F.split_part(mantissa, F.lit("."), F.lit(2))
    part = F.when(part == "0", "").otherwise(part)
    zeros = F.greatest(exponent - F.length(part), F.lit(0))
    large = F.concat(whole, F.substr(part, F.lit(1), exponent), F.repeat(F.lit("0"), zeros), F.lit("."), F.when(F.length(part) > exponent, F.substr(part, exponent + 1)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), whole, part)
    number = F.when(~plain.contains("E"), plain).when(plain.contains("E-"), small).otherwise(large)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, number))


def text(x: Column, t: str) -> Column:
    """The text of a value, as used where a property is widened to string."""
    if t == STRING:
        return x
    if t == FLOAT:
        return float_text(x)
    if t in (UTC, LOCAL):
        local = x.cast("timestamp_ntz") if t == UTC else x
        whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.pmod(F.unix_micros(x if t == UTC else F.to_utc_timestamp(x.cast("string").cast("timestamp"), "UTC")), F.lit(1_000_000))
        digits = F.lpad(micros.cast("string"), 6, "0")
        part = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.substr(digits, F.lit(1), F.lit(3)))).otherwise(F.concat(F.lit("."), digits))
        return F.concat(whole, part, F.lit("Z" if t == UTC else ""))
    if is_list(t):
        return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: text(e, ELEMENTS[t])), ", "), F.lit("]")))
    return x.cast("string")


def convert(x: Column, given: str, wanted: str) -> Column:
    """A column of one property type as another that it unifies to."""
    if given == wanted:
        return x.cast(SPARK[wanted])
    if given == NULL:
        return typed_null(wanted)
    if wanted == STRING:
        return text(x, given)
    if is_list(given) and is_list(wanted):
        inner = ELEMENTS[wanted]
        return F.transform(x, lambda e: convert(e, ELEMENTS[given], inner))
    return x.cast(SPARK[wanted])
