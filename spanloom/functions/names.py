"""Column expressions over symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_name(qualname: Column) -> Column:
    """What stands after the last ``.`` or ``::``."""
    return F.regexp_extract(qualname, r"([^.:]*)$", 1)


def short_name(qualname: Column) -> Column:
    """The last two dotted segments."""
    return F.substring_index(qualname, ".", -2)


def orphan_target(name: Column) -> Column:
    """The name that a test's name points to; the name itself if it has no test affix."""
    return (
        F.when(name.startswith("test_"), F.substring(name, 6, 1 << 30))
        .when(name.startswith("Test"), F.substring(name, 5, 1 << 30))
        .when(name.endswith("_test"), F.left(name, F.length(name) - 5))
        .when(name.endswith("Tests"), F.left(name, F.length(name) - 5))
        .when(name.endswith("Test"), F.left(name, F.length(name) - 4))
        .otherwise(name)
    )


def test_target(name: Column) -> Column:
    """What a test is about, by six naming patterns; null if none fits."""
    lower, tail, head = F.lower(name), lambda n: F.substring(name, n + 1, 1 << 30), lambda n: F.left(name, F.length(name) - n)
    long = F.length(name) > 4
    return (
        F.when(lower.startswith("test_"), F.substring(lower, 6, 1 << 30))
        .when(lower.endswith("_test"), F.left(lower, F.length(lower) - 5))
        .when(name.rlike(r"^test\p{Lu}"), tail(4))
        .when(name.startswith("Test") & long, tail(4))
        .when(name.endswith("Test") & long, head(4))
        .when(lower.endswith("spec") & long, head(4))
    )


def stable_id(qualname: Column, signature: Column, kind: Column) -> Column:
    """An identity that survives moves: of name, signature and kind alone."""
    text = F.concat_ws("\0", qualname, F.coalesce(signature, F.lit("")), kind)
    return F.concat(F.lit("sym_"), F.left(F.sha2(text, 256), F.lit(16)))
