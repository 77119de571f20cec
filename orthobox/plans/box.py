"""Box queries: closed ranges of any attributes, all of which must hold; parsing, workloads and key ranges."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.schema import WORD_BITS, PointSchema


@dataclass(frozen=True)
class BoxQuery:
    """bounds: attribute -> (low, high) in stored units, both inclusive; None is open. Attributes left out are open."""

    schema: PointSchema
    bounds: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)

    @classmethod
    def of(cls, schema: PointSchema, **bounds: tuple[int | None, int | None]) -> "BoxQuery":
        """Bounds in raw units; attributes' offsets are subtracted."""
        lowered = lambda a, v: None if v is None else v - schema.at(a).offset
        return cls(schema, {a: (lowered(a, lo), lowered(a, hi)) for a, (lo, hi) in bounds.items()})

    @classmethod
    def parse(cls, line: str, schema: PointSchema) -> "BoxQuery":
        """A line of triples `attribute number,low,high`; -1 leaves a bound open. Attributes the schema lacks are ignored."""
        tokens = [int(t) for t in line.strip().split(",")]
        if len(tokens) % 3:
            raise ValueError(f"not triples: {line!r}")
        out: dict[str, tuple[int | None, int | None]] = {}
        for number, lo, hi in zip(tokens[::3], tokens[1::3], tokens[2::3]):
            a = schema.numbered(number)
            if a is None:
                continue
            factor = 10 if number in schema.scaled else 1
            stored = lambda v, a=a, factor=factor: None if v == -1 else v * factor - a.offset
            out[a.name] = (stored(lo), stored(hi))
        return cls(schema, out)

    def with_profile_bounds(self) -> "BoxQuery":
        """Open bounds, also of attributes left out, become the schema's own."""
        out = {}
        for a in self.schema.attributes:
            lo, hi = self.bounds.get(a.name, (None, None))
            out[a.name] = (a.low - a.offset if lo is None else lo, (a.largest if a.high is None else a.high - a.offset) if hi is None else hi)
        return BoxQuery(self.schema, out)

    def only(self, *names: str) -> "BoxQuery":
        return BoxQuery(self.schema, {a: b for a, b in self.bounds.items() if a in names})

    def predicate(self) -> Column:
        """A conjunction that the Parquet scan can push down; an inverted range holds for no row."""
        parts = []
        for a, (lo, hi) in self.bounds.items():
            if lo is not None:
                parts.append(F.col(a) >= F.lit(lo).cast("long"))
            if hi is not None:
                parts.append(F.col(a) <= F.lit(hi).cast("long"))
        return reduce(lambda x, y: x & y, parts) if parts else F.lit(True)

    def key_ranges(self, most: int = 16) -> list[tuple[int, int]]:
        """Ranges of the key's first word that together hold all points of the box: at most `most`, found by splitting the
        largest open cell first. They are implied by the predicate, and serve to skip files only."""
        bits = self.schema.key_bits()[:WORD_BITS]
        limits = {a.name: (0, a.largest) for a in self.schema.attributes}
        want = {a: (max(0, lo or 0), limits[a][1] if hi is None else min(hi, limits[a][1])) for a, (lo, hi) in self.bounds.items()}
        if any(lo > hi for lo, hi in want.values()):
            return []
        done, cells = [], [(0, 0, limits)]  # (depth, prefix, limits of each attribute)
        while cells and len(done) + len(cells) < most:
            cells.sort(key=lambda c: -c[0])
            depth, prefix, box = cells.pop()
            if depth == len(bits) or all(lo <= box[a][0] and box[a][1] <= hi for a, (lo, hi) in want.items()):
                done.append((depth, prefix))
                continue
            name, bit = bits[depth]
            lo, hi = box[name]
            middle = (lo >> bit | 1) << bit
            for one, part in ((0, (lo, middle - 1)), (1, (middle, hi))):
                if name not in want or part[0] <= want[name][1] and part[1] >= want[name][0]:
                    cells.append((depth + 1, prefix << 1 | one, box | {name: part}))
        out = sorted((p << (len(bits) - d), ((p + 1) << (len(bits) - d)) - 1) for d, p in done + [(d, p) for d, p, _ in cells])
        merged: list[tuple[int, int]] = []
        for lo, hi in out:
            if merged and merged[-1][1] + 1 >= lo:
                merged[-1] = (merged[-1][0], hi)
            else:
                merged.append((lo, hi))
        return merged

    def key_predicate(self, most: int = 16) -> Column:
        ranges = self.key_ranges(most)
        return reduce(lambda x, y: x | y, [F.col("z0").between(lo, hi) for lo, hi in ranges]) if ranges else F.lit(False)


def read_corpus(spark: SparkSession, path: str, schema: PointSchema) -> list[BoxQuery]:
    """The boxes of a query file, one a line, in the order of its lines. A corpus is a workload held by the driver."""
    return [BoxQuery.parse(r["value"], schema) for r in spark.read.text(path).where("length(trim(value)) > 0").toLocalIterator()]


def corpus_frame(spark: SparkSession, path: str) -> DataFrame:
    """A query file as rows (qid, attribute, low, high), open bounds null; for corpora too long for the driver."""
    lines = spark.read.text(path).where("length(trim(value)) > 0").withColumn("qid", F.monotonically_increasing_id())
    tokens = lines.withColumn("t", F.transform(F.split("value", ","), lambda x: F.trim(x).cast("long")))
    each = tokens.select("qid", "t", F.explode(F.sequence(F.lit(0), (F.size("t") / 3).cast("int") - 1)).alias("k"))
    bound = lambda k: F.nullif(F.get("t", F.col("k") * 3 + k), F.lit(-1).cast("long"))
    return each.select("qid", F.get("t", F.col("k") * 3).cast("int").alias("attribute"), bound(1).alias("low"), bound(2).alias("high"))


def random_boxes(schema: PointSchema, n: int, seed: int = 1, names: list[str] | None = None) -> list[BoxQuery]:
    """Boxes with each low uniform between the profile's bounds and each high uniform from there on."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        bounds = {}
        for a in schema.attributes:
            if names is None or a.name in names:
                least, most = a.low - a.offset, a.largest if a.high is None else a.high - a.offset
                lo = rng.randint(max(0, least), most)
                bounds[a.name] = (lo, rng.randint(lo, most))
        out.append(BoxQuery(schema, bounds))
    return out


# Lines of the published query corpora, one of each template and the first ten over line items.
LINEITEM_LINES = [
    "0,1,50,2,8,9,4,19920102,19981201,5,19960101,19971231,6,19940101,19951231,8,19920101,19980802",
    "0,40,46,2,0,10,4,19930101,19971231,5,19920131,19981031,6,19980101,19980731,8,19920101,19980802",
    "0,28,49,2,8,10,4,19920102,19981201,5,19930101,19971231,6,19980101,19980228,8,19920101,19980802",
    "0,1,50,2,5,7,4,19950101,19951231,5,19960101,19971231,6,19960101,19971231,8,19920101,19980802",
    "0,28,32,2,0,10,4,19970101,19971231,5,19960101,19961231,6,19920103,19981231,8,19930101,19971231",
    "0,1,50,2,4,5,4,19920102,19981201,5,19950101,19961231,6,19940101,19941231,8,19920101,19980802",
    "0,49,50,2,9,10,4,19950101,19961231,5,19920131,19981031,6,19940101,19951231,8,19920101,19980802",
    "0,32,47,2,2,9,4,19930101,19961231,5,19960101,19971023,6,19970101,19971231,8,19950101,19961231",
    "0,43,50,2,0,10,4,19960101,19961231,5,19970101,19971231,6,19951101,19971231,8,19920101,19980802",
    "0,33,36,2,6,10,4,19960101,19971231,5,19920131,19981031,6,19920103,19981231,8,19930101,19951231",
]
TAXI_LINES = ["2,7,86,3,66,76", "0,20160109,20160114,1,20150616,20160617", "0,-1,20110924,6,0,0", "7,-1,202,8,89,6129"]
REPOSITORY_LINES = ["11,-1,20181122,12,20190304,-1,3,147,-1", "3,52,-1,2,37,-1", "0,-1,18006,4,5,-1,3,122,-1"]
