"""Encoders from raw columns to non-negative integers of a schema, and back from bounds of these to predicates on raw columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthobox.schema import PointSchema


def day_number(ts: Column) -> Column:
    """A date as yyyymmdd."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts)).cast("long")


def scaled(value: Column, factor: int) -> Column:
    """value * factor, rounded half away from zero."""
    return F.round(value * factor).cast("long")


def tenths(value: Column) -> Column:
    """Ten times a 32-bit float, cut towards zero."""
    return (value.cast("float") * F.lit(10.0).cast("float")).cast("long")


def code(value: Column, categories: list[str]) -> Column:
    """The position of a category; null for others."""
    at = F.array_position(F.array(*map(F.lit, categories)), value)
    return F.when(at > 0, at - 1).cast("long")


@dataclass(frozen=True)
class Source:
    """Where an attribute comes from: a raw column and how it is encoded. implied(column, low, high) gives predicates on the
    bare raw column that every row satisfies whose encoded value lies within the bounds (None is open); a scan can push them
    down, while the encoded value cannot be pushed. They may let more rows through, never fewer."""

    column: str
    encoded: Callable[[Column], Column]
    implied: Callable[[Column, int | None, int | None], list[Column]]


def _bounds(c: Column, low, high) -> list[Column]:
    return ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])


def integers(column: str) -> Source:
    return Source(column, lambda c: c.cast("long"), lambda c, lo, hi: _bounds(c, *(None if v is None else F.lit(v).cast("long") for v in (lo, hi))))


def scaled_by(column: str, factor: int) -> Source:
    """Half a unit and a margin for rounding of doubles are added on both sides."""
    wide = lambda v, by: None if v is None else F.lit((v + by) / factor)
    return Source(column, lambda c: scaled(c, factor), lambda c, lo, hi: _bounds(c, wide(lo, -0.51), wide(hi, 0.51)))


def days(column: str) -> Source:
    """A timestamp or date, as yyyymmdd. Bounds that are no dates widen to the next that are."""

    def first(number: int) -> dt.datetime | None:
        """The first day whose number is at least this one."""
        if number > 99991231:
            return None
        y, m, d = max(1, number // 10000), number // 100 % 100, number % 100
        if number < 10101:
            return dt.datetime(1, 1, 1)
        if m > 12:
            return dt.datetime(y + 1, 1, 1) if y < 9999 else None
        m, d = (1, 1) if m == 0 else (m, max(1, d))
        try:
            return dt.datetime(y, m, d)
        except ValueError:  # past the month's end
            return dt.datetime(y + (m == 12), m % 12 + 1, 1) if (y, m) < (9999, 12) else None

    def implied(c: Column, lo: int | None, hi: int | None) -> list[Column]:
        low = None if lo is None else first(lo)
        after = None if hi is None else first(hi + 1)
        if lo is not None and low is None:
            return [F.lit(False)]
        out = [] if low is None else [c >= F.lit(low).cast("timestamp_ntz")]
        return out if after is None else [*out, c < F.lit(after).cast("timestamp_ntz")]

    return Source(column, day_number, implied)


def computed(column: str, encoded: Callable[[Column], Column]) -> Source:
    """Any other encoding: nothing is implied but that the raw value is there."""
    return Source(column, encoded, lambda c, lo, hi: [c.isNotNull()] if lo is not None or hi is not None else [])


def categories(column: str, values: list[str]) -> Source:
    def implied(c: Column, lo: int | None, hi: int | None) -> list[Column]:
        if lo is None and hi is None:
            return []
        kept = [v for k, v in enumerate(values) if (lo is None or k >= lo) and (hi is None or k <= hi)]
        return [c.isin(kept)] if kept else [F.lit(False)]

    return Source(column, lambda c: code(c, values), implied)


def raw_predicate(schema: PointSchema, sources: dict[str, Source], bounds: dict[str, tuple[int | None, int | None]]) -> Column:
    """What a box's bounds, in stored units, imply for the raw columns."""
    parts = []
    for a, (lo, hi) in bounds.items():
        up = lambda v, a=a: None if v is None else v + schema.at(a).offset
        parts += sources[a].implied(F.col(sources[a].column), up(lo), up(hi))
    return reduce(lambda x, y: x & y, parts) if parts else F.lit(True)


def encode(df: DataFrame, schema: PointSchema, columns: dict[str, Column], pk: Column | None = None, on_overflow: str = "error", keep: list[str] | None = None) -> DataFrame:
    """Points: pk (if given) and the schema's attributes, each its column less the attribute's offset, and the columns to keep.

    on_overflow: what becomes of values that the attribute's bits can't hold: "error" fails the query, "mask" keeps the low
    bits, "null" makes the value null, "drop" leaves the row out, "trust" does not look: for reading tables whose loader has
    looked, as a test in the way keeps filters from the scan. Nulls stay null."""
    out: dict[str, Column] = {}
    for a in schema.attributes:
        v = (columns[a.name] - a.offset).cast("long")
        fits = (v >= 0) & (v <= a.largest)
        if on_overflow == "mask":
            v = v.bitwiseAND(F.lit(a.largest).cast("long"))
        elif on_overflow in ("null", "drop"):
            v = F.when(fits, v)
        elif on_overflow == "error":
            v = F.when(~fits, F.raise_error(F.concat(F.lit(f"{a.name} out of range: "), v.cast("string"))).cast("long")).otherwise(v)
        elif on_overflow != "trust":
            raise ValueError(f"unknown overflow policy {on_overflow}")
        out[a.name] = v
    points = df.select(*(keep or []), *([pk.alias("pk")] if pk is not None else []), *[v.alias(k) for k, v in out.items()])
    return points.dropna(subset=list(out)) if on_overflow == "drop" else points


def checked(points: DataFrame, schema: PointSchema) -> DataFrame:
    """Points as they are; a value that its attribute's bits can't hold fails the query. For loaders."""
    return encode(points, schema, {a.name: F.col(a.name) + a.offset for a in schema.attributes}, keep=[c for c in points.columns if c not in schema.names])
