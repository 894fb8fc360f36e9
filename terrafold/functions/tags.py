"""Tag values. A map keeps every value as text; which texts count as numbers is a rule, not a type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical decimals of up to three places; they print back as they are.
CANONICAL = r"\A-?(0|[1-9][0-9]*)(\.[0-9]{1,3})?\z"
#: The longest number that a text begins with.
LEADING = r"^[\x00-\x20]*(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
# Range of the digits of a value stored as a number.
LEAST_DIGITS, MOST_DIGITS = -256, (1 << 30) - 257


def tag(key: str) -> Column:
    """Null where the key is absent."""
    return F.col("tags")[key]


def value(key: str) -> Column:
    """Empty where the key is absent."""
    return F.coalesce(tag(key), F.lit(""))


def has_tag(key: str, wanted: str | None = None) -> Column:
    found = tag(key)
    return found.isNotNull() if wanted is None else F.coalesce(found == wanted, F.lit(False))


def stored_number(v: Column) -> Column:
    """Whether a value counts as a number, so that text comparisons don't apply to it. Null for null."""
    digits = F.replace(v, F.lit("."), F.lit("")).try_cast("bigint")
    fits = F.coalesce(digits.between(LEAST_DIGITS, MOST_DIGITS), F.lit(False))
    return v.rlike(CANONICAL) & ~v.rlike(r"\A-0(\.0*)?\z") & fits


def number(v: Column) -> Column:
    """The number a value begins with, or null."""
    return F.nullif(F.regexp_extract(v, LEADING, 1), F.lit("")).try_cast("double")


def to_double(v: Column) -> Column:
    """0 for what isn't a number, and for null."""
    return F.coalesce(number(v), F.lit(0.0))


def to_long(v: Column) -> Column:
    return to_double(v).cast("long")


def to_decimal(v: Column) -> Column:
    """Null unless the value is a canonical decimal of any length that fits."""
    return F.when(v.rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?\z") & ~v.rlike(r"\A-0(\.0*)?\z"), v.try_cast("decimal(38,15)"))


def truthy(v: Column) -> Column:
    """False for absent and empty values, "no" and numbers equal to 0."""
    zero = stored_number(v) & (number(v) == 0)
    return F.coalesce((v != "") & (v != "no") & ~zero, F.lit(False))


def tag_count() -> Column:
    return F.coalesce(F.size("tags"), F.lit(0))


def sorted_tags() -> Column:
    """Array of (key, value), by key."""
    return F.array_sort(F.map_entries("tags"))


def label() -> Column:
    """What a feature is, by its first truthy tag in key order, and its name in quotes."""
    first = F.get(F.filter(sorted_tags(), lambda e: truthy(e["value"])), F.lit(0))
    what = (
        F.when(first.isNull(), "feature").when(first["key"].startswith("addr:"), "address")
        .when(first["value"] == "yes", first["key"]).otherwise(first["value"])
    )
    name = tag("name")
    bare = first.isNotNull() & first["key"].startswith("addr:")
    return F.when(truthy(name) & ~bare, F.concat(what, F.lit(' "'), name, F.lit('"'))).otherwise(what)


def type_name(kind: Column) -> Column:
    return F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), kind.cast("int") + 1)


def feature_string() -> Column:
    """As "node/123"."""
    return F.concat(type_name(F.col("type")), F.lit("/"), F.col("id").cast("string"))


def short_id() -> Column:
    """As "N123"."""
    return F.concat(F.substring(F.lit("NWR"), F.col("type").cast("int") + 1, F.lit(1)), F.col("id").cast("string"))
