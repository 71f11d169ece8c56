"""Metric names: parts, pattern matching and the identities they carry.

A metric name reads ``metrics:name=<name>,type=<gauges|counters>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_IDENTITY = "struct<application_name: string, id: string, failure: string>"


def bean_name(mbean: Column) -> Column:
    """Text of ``name=`` without the ``type=`` part; null where either is missing."""
    name = F.substring_index(F.substring_index(mbean, ",type=", 1), "metrics:name=", -1)
    return F.when(mbean.startswith("metrics:name=") & mbean.contains(",type="), name)


def bean_type(mbean: Column) -> Column:
    """Text of ``type=``."""
    return F.when(mbean.contains(",type="), F.substring_index(mbean, ",type=", -1))


def last_token(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def split_pattern(pattern: str) -> tuple[str, str, str]:
    """Literal head, middle and tail of a pattern with up to two ``*``."""
    parts = pattern.split("*")
    if len(parts) == 1:
        return pattern, "", ""
    if len(parts) == 2:
        return parts[0], "", parts[1]
    if len(parts) == 3:
        return parts[0], parts[1], parts[2]
    raise ValueError(f"more than two '*' in {pattern!r}")


def matches_pattern(
    name: Column, exact: Column, head: Column, middle: Column, tail: Column
) -> Column:
    """Whether ``name`` fits a pattern given by its literal parts (no regex per row)."""
    between = F.length(name) - F.length(head) - F.length(tail)
    inner = F.substring(name, F.length(head) + 1, between)
    return F.when(exact, name == head).otherwise(
        (between >= 0) & name.startswith(head) & name.endswith(tail) & inner.contains(middle)
    )


def _named_identity(mbean: Column) -> tuple[Column, Column, Column]:
    """(applies, application, id): text after the first ``=``, its first two dotted parts.

    Worker and application names are left alone; master names are not, as in the
    existing tables.
    """
    applies = (
        mbean.isNotNull() & ~mbean.contains("name=worker.") & ~mbean.contains("name=application.")
    )
    parts = F.split(F.try_element_at(F.split(mbean, "="), F.lit(2)), "[.]")
    return applies, F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def _identity(mbean: Column, accept_driver: bool, refusal: str) -> Column:
    applies, application, owner = _named_identity(mbean)
    missing = F.lit("no application and id in metric name")
    accepted = (owner == "driver") if accept_driver else (owner != "driver")
    nothing = F.lit(None).cast("string")
    shown_id = nothing if accept_driver else owner
    return (
        F.when(~applies, F.lit(None).cast(NO_IDENTITY))
        .when(
            owner.isNull(),
            F.struct(
                nothing.alias("application_name"), nothing.alias("id"), missing.alias("failure")
            ),
        )
        .when(
            accepted,
            F.struct(
                application.alias("application_name"),
                shown_id.alias("id"),
                nothing.alias("failure"),
            ),
        )
        .otherwise(
            F.struct(
                nothing.alias("application_name"),
                nothing.alias("id"),
                F.lit(refusal).alias("failure"),
            )
        )
    )


def driver_identity(mbean: Column) -> Column:
    """Application of a driver-stream row; any id but ``driver`` fails."""
    return _identity(mbean, True, "executor id in the driver stream")


def executor_identity(mbean: Column) -> Column:
    """Application and id of an executor-stream row; the id ``driver`` fails."""
    return _identity(mbean, False, "driver id in the executor stream")


def application_identity(mbean: Column) -> Column:
    """Second and third dotted parts of an application's metric name.

    Empty when ``name=application`` is not in the first part, failure when there are
    fewer than three parts.
    """
    parts = F.split(mbean, "[.]")
    in_first = F.element_at(parts, F.lit(1)).contains("name=application")
    third = F.try_element_at(parts, F.lit(3))
    nothing = F.lit(None).cast("string")
    name = F.when(~in_first, F.lit("")).when(
        third.isNotNull(), F.concat_ws(".", F.try_element_at(parts, F.lit(2)), third)
    )
    failure = F.when(in_first & third.isNull(), F.lit("no application in metric name"))
    return F.when(
        mbean.contains("name=application"),
        F.struct(
            name.alias("application_name"), nothing.alias("id"), failure.alias("failure")
        ),
    )
