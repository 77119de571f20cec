import pytest

from orthobox.plans.box import LINEITEM_LINES, REPOSITORY_LINES, TAXI_LINES, BoxQuery, random_boxes
from orthobox.schema import GITHUB10, LINEITEM7, NYC15, ORDERS4, TPCH9, Attribute, PointSchema


def test_level_widths():
    assert TPCH9.level_widths() == [7] * 20 + [3] * 4 + [2] * 8
    assert GITHUB10.level_widths() == [10] * 16 + [9] * 8
    assert NYC15.level_widths() == [10] * 8 + [9, 9] + [7] * 7 + [8] + [10] * 4 + [9] * 3 + [6] * 3
    assert (TPCH9.total_bits, GITHUB10.total_bits, NYC15.total_bits) == (168, 232, 240)
    assert LINEITEM7.level_widths() == [5] * 20 + [3] * 4 + [2] * 8 and LINEITEM7.total_bits == 128


def test_key_bits_cover_every_bit_once():
    for schema in (TPCH9, GITHUB10, NYC15, ORDERS4):
        bits = schema.key_bits()
        assert len(bits) == len(set(bits)) == schema.total_bits
        for a in schema.attributes:
            assert [b for n, b in bits if n == a.name] == list(range(a.bits - 1, -1, -1))


def test_attributes_are_checked():
    with pytest.raises(ValueError):
        Attribute("a", 4, 4)
    with pytest.raises(ValueError):
        PointSchema("s", (Attribute("a", 4), Attribute("a", 5)))
    with pytest.raises(ValueError):
        ORDERS4.truncate(0)


def test_parse():
    assert BoxQuery.parse(LINEITEM_LINES[0], LINEITEM7).bounds == {"quantity": (1, 50), "discount": (8, 9), "shipdate": (920102, 981201), "orderdate": (920101, 980802)}
    assert BoxQuery.parse(TAXI_LINES[0], NYC15).bounds == {"pickup_longitude": (70, 860), "pickup_latitude": (660, 760)}
    assert BoxQuery.parse(REPOSITORY_LINES[0], GITHUB10).bounds == {"start_date": (None, 71122), "end_date": (80304, None), "stars": (147, None)}
    with pytest.raises(ValueError):
        BoxQuery.parse("1,2", ORDERS4)


def test_profile_bounds():
    box = BoxQuery(LINEITEM7, {"discount": (5, None)}).with_profile_bounds()
    assert box.bounds["discount"] == (5, 10) and box.bounds["shipdate"] == (920102, 981201) and len(box.bounds) == 7


def _key(schema, point):
    out = 0
    for name, bit in schema.key_bits():
        out = out << 1 | point[name] >> bit & 1
    return out


def test_key_ranges_hold_every_point_of_the_box():
    import random

    rng = random.Random(4)
    schema = PointSchema("small", (Attribute("a", 5), Attribute("b", 4, 1), Attribute("c", 3)))
    for box in random_boxes(schema, 60, seed=8):
        for most in (1, 4, 16):
            ranges = box.key_ranges(most)
            assert len(ranges) <= most
            for _ in range(60):
                p = {a.name: rng.randint(0, a.largest) for a in schema.attributes}
                if all(lo <= p[a] <= hi for a, (lo, hi) in box.bounds.items()):
                    assert any(lo <= _key(schema, p) <= hi for lo, hi in ranges)
    assert BoxQuery(schema, {"a": (3, 2)}).key_ranges() == []
