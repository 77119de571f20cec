"""Point schemas: which integer attributes a point has, how many bits of each are kept, and how they interleave."""

from __future__ import annotations

from dataclasses import dataclass, replace

WORD_BITS = 60  # bits of a Morton key in one long; the sign bit stays clear


@dataclass(frozen=True)
class Attribute:
    """width - start bits of the value are kept; in the key it takes part in levels start .. width - 1. offset is subtracted
    on the way in. low and high are the profile's bounds, used for open bounds on request."""

    name: str
    width: int
    start: int = 0
    offset: int = 0
    low: int = 0
    high: int | None = None
    index: int | None = None  # the number that query lines use, if it isn't the position

    def __post_init__(self):
        if not 0 <= self.start < self.width <= 62:
            raise ValueError(f"{self.name}: needs 0 <= start < width <= 62")

    @property
    def bits(self) -> int:
        return self.width - self.start

    @property
    def largest(self) -> int:
        return (1 << self.bits) - 1


@dataclass(frozen=True)
class PointSchema:
    name: str
    attributes: tuple[Attribute, ...]
    scaled: frozenset[int] = frozenset()  # query numbers whose bounds are given in tenths of the stored unit's inverse
    query_shift: tuple[int, int] = (1 << 30, 0)  # query numbers above the first are lowered by the second

    def __post_init__(self):
        if not self.attributes or len({a.name for a in self.attributes}) < len(self.attributes):
            raise ValueError("attributes need distinct names")

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    @property
    def depth(self) -> int:
        return max(a.width for a in self.attributes)

    @property
    def total_bits(self) -> int:
        return sum(a.bits for a in self.attributes)

    @property
    def n_words(self) -> int:
        return -(-self.total_bits // WORD_BITS)

    def at(self, name: str) -> Attribute:
        return next(a for a in self.attributes if a.name == name)

    def numbered(self, number: int) -> Attribute | None:
        """The attribute that query lines call `number`; None if this schema lacks it."""
        if number > self.query_shift[0]:
            number -= self.query_shift[1]
        return next((a for k, a in enumerate(self.attributes) if (k if a.index is None else a.index) == number), None)

    def level_members(self, level: int) -> list[Attribute]:
        return [a for a in self.attributes if a.start <= level < a.width]

    def level_widths(self) -> list[int]:
        """How many attributes give a bit to each level."""
        return [len(self.level_members(level)) for level in range(self.depth)]

    def key_bits(self) -> list[tuple[str, int]]:
        """(attribute, bit of its value) from the key's most significant bit on."""
        return [(a.name, a.width - level - 1) for level in range(self.depth) for a in self.level_members(level)]

    def prefix_bits(self, level: int) -> dict[str, int]:
        """How many leading bits of each attribute the levels 0 .. level hold."""
        return {a.name: max(0, min(level + 1, a.width) - a.start) for a in self.attributes}

    def truncate(self, dims: int) -> "PointSchema":
        """The first dims attributes only."""
        if not 1 <= dims <= len(self.attributes):
            raise ValueError(f"dims must be between 1 and {len(self.attributes)}")
        return replace(self, name=f"{self.name}_{dims}d", attributes=self.attributes[:dims])

    def holding(self, largest: dict[str, int]) -> "PointSchema":
        """The same attributes with as many bits more as these stored values need. Its keys are not those of this schema where
        it is wider: a store is searched with the schema that it was written with."""
        return replace(self, attributes=tuple(replace(a, width=max(a.width, a.start + largest.get(a.name, 0).bit_length())) for a in self.attributes))

    def plain(self) -> "PointSchema":
        """The same attributes without staggered start levels: all take part from level 0."""
        return replace(self, name=f"{self.name}_plain", attributes=tuple(replace(a, width=a.bits, start=0) for a in self.attributes))


def _many(*rows: tuple) -> tuple[Attribute, ...]:
    return tuple(Attribute(*r) for r in rows)


# Widths, start levels, offsets and bounds of the published datasets.
TPCH9 = PointSchema("tpch9", _many(
    ("quantity", 8, 0, 0, 1, 50), ("extendedprice", 32, 0, 0, 90000, 10494950), ("discount", 16, 8, 0, 0, 10), ("tax", 24, 16, 0, 0, 8),
    ("shipdate", 20, 0, 19000000, 19920102, 19981201), ("commitdate", 20, 0, 19000000, 19920131, 19981031), ("receiptdate", 20, 0, 19000000, 19920103, 19981231),
    ("totalprice", 32, 0, 0, 81300, 58063825), ("orderdate", 20, 0, 19000000, 19920101, 19980802),
))
GITHUB10 = PointSchema("github10", _many(
    ("events_count", 24, 0, 0, 1, 7451541), ("authors_count", 24, 0, 0, 1, 737170), ("forks", 24, 0, 0, 0, 262926), ("stars", 24, 0, 0, 0, 354850), ("issues", 24, 0, 0, 0, 379379),
    ("pushes", 24, 0, 0, 0, 3097263), ("pulls", 24, 0, 0, 0, 703341), ("downloads", 16, 0, 0, 0, 8745), ("start_date", 24, 0, 20110000, 20110211, 20201206), ("end_date", 24, 0, 20110000, 20110211, 20201206),
), query_shift=(10, 3))
NYC15 = PointSchema("nyc15", _many(
    ("pickup_date", 18, 0, 20090000, 20090101, 20160630), ("dropoff_date", 20, 0, 19700000, 19700101, 20221220), ("pickup_longitude", 10, 0, 0, 0, 899), ("pickup_latitude", 10, 0, 0, 0, 898),
    ("dropoff_longitude", 28, 18, 0, 0, 899), ("dropoff_latitude", 28, 18, 0, 0, 898), ("passenger_count", 8, 0, 0, 0, 255), ("trip_distance", 28, 0, 0, 0, 198623000), ("fare_amount", 25, 0, 0, 0, 21474808),
    ("extra", 28, 18, 0, 0, 1000), ("mta_tax", 28, 17, 0, 0, 1312), ("tip_amount", 22, 0, 0, 0, 3950589), ("tolls_amount", 25, 0, 0, 0, 21474836), ("improvement_surcharge", 28, 20, 0, 0, 138), ("total_amount", 25, 0, 0, 0, 21474830),
), scaled=frozenset({2, 3, 4, 5}))

#: Of this repository's own tables. lineitem7 keeps the numbers, widths and bounds of tpch9 where the tables have the column.
LINEITEM7 = PointSchema("lineitem7", tuple(replace(a, index=k) for k, a in enumerate(TPCH9.attributes) if k not in (5, 6)))
ORDERS4 = PointSchema("orders4", _many(("custkey", 14), ("totalprice", 26), ("orderdate", 20, 0, 19000000), ("priority", 3)))
EVENTS5 = PointSchema("events5", _many(("day", 18, 0, 20000000), ("hour", 5), ("user_id", 11), ("value", 16), ("event_type", 3)))

PRESETS = {s.name: s for s in (TPCH9, GITHUB10, NYC15, LINEITEM7, ORDERS4, EVENTS5)}
