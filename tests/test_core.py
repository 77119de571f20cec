import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from orthobox import queries
from orthobox.functions import encoders, morton
from orthobox.operators import layout, lookup, search
from orthobox.plans.box import LINEITEM_LINES, BoxQuery, corpus_frame, random_boxes, read_corpus
from orthobox.plans.workload import dimension_sweep, file_size_sweep, load, lookups, searches
from orthobox.schema import EVENTS5, LINEITEM7, NYC15, ORDERS4, TPCH9, Attribute, PointSchema
from orthobox.sources import tables
from orthobox.sources.files import read_csv, read_split, synthetic, write_counts, write_metrics, write_numbers
from orthobox.streaming.ingest import run_mixed

SMALL = PointSchema("small", (Attribute("a", 6), Attribute("b", 5, 2), Attribute("c", 4)))


def _rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(k, *(rng.randint(0, a.largest) for a in SMALL.attributes)) for k in range(n)]


def _points(spark, rows):
    return spark.createDataFrame(rows, "pk long, a long, b long, c long")


def _key(schema, values):
    out = 0
    for name, bit in schema.key_bits():
        out = out << 1 | values[name] >> bit & 1
    return out


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, con.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()))


def test_corpus_counts(spark, sf):
    boxes = [BoxQuery.parse(line, LINEITEM7) for line in LINEITEM_LINES]
    counts = search.batch_counts(tables.lineitem7(spark, sf), boxes, LINEITEM7).orderBy("qid").collect()
    assert [r["found"] for r in counts] == [3805, 1986, 2089, 1427, 421, 3704, 53, 1377, 759, 94]


def test_known_counts(spark, sf):
    events, orders = tables.events5(spark, sf), tables.orders4(spark, sf)
    assert search.range_search(events, BoxQuery.parse("0,20240105,20240112,1,8,17", EVENTS5)).count() == 1094
    assert search.range_search(orders, BoxQuery.parse("1,45000000,-1,3,2,-1", ORDERS4)).count() == 1177
    assert [tuple(r) for r in lookup.lookup(orders, 42, ORDERS4).collect()] == [(42, 1053, 14608732, 951012, 3)]


def test_every_synthetic_point_is_found(spark):
    schema = PointSchema("uniform9", tuple(Attribute(f"a{k}", 32) for k in range(9)))
    points = synthetic(spark, 2000, schema)
    assert search.range_search(points, BoxQuery(schema, {a: (0, 65536) for a in schema.names})).count() == 2000
    assert lookup.lookup_many(points, spark.range(2000).withColumnRenamed("id", "pk"), schema).where("a0 = pk").count() == 2000
    assert points.collect() == synthetic(spark, 2000, schema).collect()


def test_boxes_match_brute_force(spark):
    rows = _rows()
    points = _points(spark, rows).cache()
    boxes = random_boxes(SMALL, 25, seed=5) + [BoxQuery(SMALL, {"b": (3, None)}), BoxQuery(SMALL), BoxQuery(SMALL, {"a": (9, 4)})]
    want = {q: sum(all((lo is None or r[1 + SMALL.names.index(a)] >= lo) and (hi is None or r[1 + SMALL.names.index(a)] <= hi) for a, (lo, hi) in b.bounds.items()) for r in rows) for q, b in enumerate(boxes)}
    assert {r["qid"]: r["found"] for r in search.batch_counts(points, boxes, SMALL).collect()} == want
    keyed = morton.with_key(points, SMALL)
    for q, b in enumerate(boxes):
        assert search.range_search(points, b).count() == search.range_search(keyed, b).count() == want[q]


def test_batch_without_broadcast(spark, monkeypatch):
    points = _points(spark, _rows())
    boxes = random_boxes(SMALL, 10, seed=6)
    want = sorted(search.batch_counts(points, boxes, SMALL).collect())
    monkeypatch.setattr(search, "MAX_BROADCAST_BOXES", 0)
    assert sorted(search.batch_counts(points, boxes, SMALL).collect()) == want


def test_key_orders_and_decodes(spark):
    for schema, seed in ((SMALL, 1), (LINEITEM7, 2), (NYC15, 3), (TPCH9, 4)):
        rng = random.Random(seed)
        rows = [tuple(rng.randint(0, a.largest) for a in schema.attributes) for _ in range(60)]
        df = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in schema.names))
        want = sorted(rows, key=lambda r: _key(schema, dict(zip(schema.names, r))))
        got = df.orderBy(*morton.words(schema)).collect()
        assert [_key(schema, r.asDict()) for r in got] == [_key(schema, dict(zip(schema.names, r))) for r in want]
        assert [tuple(r) for r in df.orderBy(morton.binary_key(schema), *schema.names).collect()] == sorted(rows, key=lambda r: (_key(schema, dict(zip(schema.names, r))), r))
        keys = morton.with_key(df, schema)
        back = keys.select(*schema.names, *[c.alias(f"d_{a}") for a, c in morton.decoded(schema).items()])
        assert back.where(" or ".join(f"{a} != d_{a}" for a in schema.names)).count() == 0


def test_level_nodes(spark):
    rows = _rows(80)
    got = {r["level"]: (r["nodes"], r["collapsed"]) for r in layout.level_nodes(_points(spark, rows), SMALL).collect()}

    def cell(r, level):
        kept = SMALL.prefix_bits(level)
        return tuple(v >> (a.bits - kept[a.name]) for a, v in zip(SMALL.attributes, r[1:]))

    for level in range(SMALL.depth):
        cells = {}
        for r in rows:
            cells.setdefault(cell(r, level), set()).add(cell(r, min(level + 1, SMALL.depth - 1)))
        assert got[level] == (len(cells), sum(len(v) == 1 for v in cells.values()))


def test_membership_and_latest(spark):
    points = _points(spark, [(1, 1, 2, 3), (1, 4, 5, 6), (2, 1, 2, 3)])
    assert lookup.check(points, {"a": 4, "b": 5, "c": 6}, SMALL) and not lookup.check(points, {"a": 4, "b": 5, "c": 7}, SMALL)
    both = points.withColumn("seq", F.when(F.col("a") == 4, 2).otherwise(1))
    assert sorted(tuple(r) for r in lookup.latest(both, "seq").select("pk", "a").collect()) == [(1, 4), (2, 1)]
    assert sorted(tuple(r) for r in lookup.lookup(points, 1, SMALL).collect()) == [(1, 1, 2, 3), (1, 4, 5, 6)]
    assert layout.key_lists(points, SMALL.names).where("a = 1").first()["pks"] == [1, 2]


def test_overflow_policies(spark):
    df = spark.createDataFrame([(5,), (70,), (None,), (-1,)], "v long")
    one = PointSchema("one", (Attribute("v", 6),))
    run = lambda policy: [r["v"] for r in encoders.encode(df, one, {"v": F.col("v")}, on_overflow=policy).collect()]
    assert run("mask") == [5, 6, None, 63] and run("null") == [5, None, None, None] and run("drop") == [5]
    with pytest.raises(Exception, match="out of range"):
        run("error")
    with pytest.raises(ValueError):
        run("other")


def test_files(spark, tmp_path):
    (tmp_path / "taxi").mkdir()
    lines = [f"{k},20150{1 + k % 9}01,20160101,73.9{k},40.78,1.25,2.5,1,{k},5,6,7,8,9,10,11" for k in range(5)]
    (tmp_path / "taxi" / "x00.csv").write_text("\n".join(lines[:3]) + "\n")
    (tmp_path / "taxi" / "x01.csv").write_text("\n".join(lines[3:]) + "\n")
    got = read_csv(spark, str(tmp_path / "taxi"), NYC15).orderBy("pk").collect()
    assert len(got) == 5 and got[0]["pickup_longitude"] == 739 and got[0]["dropoff_longitude"] == 12 and got[0]["pickup_date"] == 20150101 - 20090000
    assert [r["pk"] for r in read_csv(spark, str(tmp_path / "taxi"), NYC15, skip=1, limit=2).collect()] == [1, 2]
    assert read_split(spark, str(tmp_path / "taxi"), NYC15).select("part").distinct().count() == 2
    (tmp_path / "corpus").write_text("0,1,5,1,-1,3\n\n2,4,-1\n")
    boxes = read_corpus(spark, str(tmp_path / "corpus"), SMALL)
    assert [b.bounds for b in boxes] == [{"a": (1, 5), "b": (None, 3)}, {"c": (4, None)}]
    assert sorted(tuple(r)[1:] for r in corpus_frame(spark, str(tmp_path / "corpus")).collect()) == [(0, 1, 5), (1, None, 3), (2, 4, None)]
    write_metrics(spark, str(tmp_path / "metrics"), {"a": 1})
    write_numbers(spark.range(3), str(tmp_path / "numbers"))
    write_counts(spark.range(3), str(tmp_path / "counts"))
    assert spark.read.text(str(tmp_path / "metrics")).first()["value"] == '{"a": 1}' and spark.read.text(str(tmp_path / "numbers")).count() == 3


def test_store(spark, tmp_path):
    path, points = str(tmp_path / "store"), layout.with_shard(_points(spark, _rows(400)), 4)
    layout.write_clustered(points, path, SMALL, 8, by_shard=True)
    store = spark.read.parquet(path)
    assert store.count() == 400 and layout.storage_report(spark, path).first()["rows"] == 400
    assert lookup.lookup(store, 7, SMALL, n_shards=4).count() == 1
    plan = lookup.lookup(store, 7, SMALL, n_shards=4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    flat = str(tmp_path / "flat")
    layout.write_clustered(points.drop("shard"), flat, SMALL, 4)
    layout.append(_points(spark, _rows(100, 9)), flat, SMALL)
    layout.compact(spark, flat, str(tmp_path / "compacted"), SMALL, 4)
    assert spark.read.parquet(flat).count() == spark.read.parquet(str(tmp_path / "compacted")).count() == 500
    box = BoxQuery(SMALL, {"a": (0, 7), "b": (0, 1)})
    ranges = layout.file_ranges(spark, str(tmp_path / "compacted"), SMALL)
    assert 1 <= layout.files_met(ranges, box) < ranges.count()


def test_filters_are_pushed_and_no_python_runs(spark, sf):
    plan = search.range_search(tables.events5(spark, sf, BoxQuery(EVENTS5, {"user_id": (10, 20)})), BoxQuery(EVENTS5, {"user_id": (10, 20)}))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(user_id,10)" in plan and "LessThanOrEqual(user_id,20)" in plan
    for name in queries.QUERIES:
        if name in ("box_lineitem_q1", "box_count_batch", "lookup_many", "check_absent", "morton_words", "morton_roundtrip", "level_nodes", "insert_same_pk_latest"):
            assert "Python" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_workloads(spark, tmp_path):
    points = _points(spark, _rows(500)).cache()
    assert load(points, str(tmp_path / "s"), SMALL, 2)["rows"] == 500
    assert lookups(points, SMALL, range(100))["rows"] == 100
    boxes = random_boxes(SMALL, 5, seed=2)
    assert searches(points, boxes, SMALL)["rows"] == searches(points, boxes, SMALL, serial=True)["rows"]
    assert set(dimension_sweep(points, SMALL, 3)) == {3}
    shares = file_size_sweep(spark, points, SMALL, boxes, str(tmp_path / "sweep"), (1, 8))
    assert shares[8] <= shares[1] <= 1
    arriving = _points(spark, [(1000 + k, *r[1:]) for k, r in enumerate(_rows(100, 3))])
    done = run_mixed(spark, points, arriving, SMALL, (1, 5, 1), 28, seed=1, rounds=2, max_pk=499)
    assert done["lookup"]["rows"] == done["lookup"]["operations"] and sum(d["operations"] for d in done.values()) == 28


@pytest.mark.parametrize("read, box, pushed", [
    (tables.events5, BoxQuery(EVENTS5, {"day": (240105, 240112), "value": (100, None), "event_type": (2, 3)}), ["GreaterThanOrEqual(ts,2024-01-05", "LessThan(ts,2024-01-13", "GreaterThanOrEqual(value,", "In(event_type, [purchase,signup])"]),
    (tables.orders4, BoxQuery(ORDERS4, {"custkey": (None, 99), "totalprice": (20000000, None), "orderdate": (950230, 951340)}), ["LessThanOrEqual(o_custkey,99)", "GreaterThanOrEqual(o_totalprice,", "GreaterThanOrEqual(o_orderdate,1995-03-01", "LessThan(o_orderdate,1996-01-01"]),
    (tables.lineitem7, BoxQuery.parse(LINEITEM_LINES[3], LINEITEM7), ["GreaterThanOrEqual(l_quantity,", "LessThanOrEqual(l_discount,", "GreaterThanOrEqual(l_shipdate,1995-01-01", "LessThan(o_orderdate,1998-08-03"]),
])
def test_every_bound_reaches_the_scan(spark, sf, read, box, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    found = search.range_search(read(spark, sf, box), box)
    plan = found._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = " ".join(x.split("PushedFilters: ", 1)[1] for x in plan.split("\n") if "PushedFilters: " in x)
    assert [p for p in pushed if p not in filters] == []
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.range_search(read(spark, sf), box).collect()))


def test_batch_equals_single_with_nulls_and_overflow(spark):
    rows = [(1, 1, 1, 1), (2, None, 2, 3), (3, 500, 3, 4), (4, -7, None, 5), (5, 63, 4, None), (6, None, None, None)] + _rows(60)
    points = _points(spark, rows).cache()
    boxes = [BoxQuery(SMALL, {"b": (0, 5)}), BoxQuery(SMALL, {"a": (None, 40), "b": (1, None)}), BoxQuery(SMALL, {"a": (30, None)}), BoxQuery(SMALL), BoxQuery(SMALL, {"a": (5, 2)}), BoxQuery(SMALL, {"a": (None, None), "c": (2, 9)}), *random_boxes(SMALL, 12, seed=8)]
    want = {q: search.range_search(points, b).count() for q, b in enumerate(boxes)}
    assert {r["qid"]: r["found"] for r in search.batch_counts(points, boxes, SMALL).collect()} == want
    assert {r["qid"]: r["found"] for r in search.batch_counts(points, search.boxes_frame(spark, boxes, SMALL), SMALL).collect()} == want
    found, seen = search.counted(points, boxes[0])
    assert len(found.collect()) == want[0] == seen.get["found"] and seen.get["checked"] == len(rows)


def test_split_files_check_values(spark, tmp_path):
    (tmp_path / "x0.csv").write_text("1,500,1,1\n2,3,1,1\n")
    assert sorted(r["pk"] for r in read_split(spark, str(tmp_path), SMALL, on_overflow="drop").collect()) == [2]
    with pytest.raises(Exception, match="out of range"):
        read_split(spark, str(tmp_path), SMALL).collect()


def test_skip_without_limit(spark, tmp_path):
    ids = [7, 7, 7, 1, 90000, 3, 3, 12, -4]
    (tmp_path / "x0.csv").write_text("".join(f"{i},1,1,1\n" for i in ids))
    for skip in range(len(ids) + 2):
        assert sorted(r["pk"] for r in read_csv(spark, str(tmp_path), SMALL, skip=skip).collect()) == sorted(ids)[skip:]


def test_command_line_workloads(spark, sf, tmp_path):
    from orthobox import cli

    store, done = str(tmp_path / "store"), {}
    for workload in cli.WORKLOADS:
        done[workload] = cli.run(spark, ORDERS4, sf, store, workload, operations=12)
    assert done["insert"]["rows"] == done["storage"]["rows"] == 15000 and done["lookup"]["operations"] == done["zipf"]["operations"] == 12
    assert done["zipf"]["rows"] == 12 and len(done["latency"]["latencies"]) == 12 and done["latency"]["rows"] == done["throughput"]["rows"]
    assert all(sum(x["operations"] for x in done[m].values()) == 12 for m in cli.MIXES)
    assert done["mixed_insert"]["insert"]["rows"] == done["mixed_insert"]["insert"]["operations"] > 0


def test_widths_of_all_presets(spark, tmp_path):
    """Stores of the published profiles, staggered and plain, find the same points."""
    from orthobox.schema import GITHUB10

    for schema in (TPCH9, GITHUB10, NYC15):
        rng = random.Random(len(schema.names))
        rows = [(k, *(rng.randint(0, a.largest) for a in schema.attributes)) for k in range(200)]
        points = spark.createDataFrame(rows, "pk long, " + ", ".join(f"{a} long" for a in schema.names))
        box = BoxQuery(schema, {a.name: (a.largest // 5, None) for a in schema.attributes[:4]})
        want = {r[0] for r in rows if all(r[1 + schema.names.index(a)] >= lo for a, (lo, _) in box.bounds.items())}
        for one in (schema, schema.plain()):
            path = str(tmp_path / one.name)
            layout.write_clustered(points, path, one, 4)
            found = search.range_search(spark.read.parquet(path), BoxQuery(one, box.bounds), mode="rows")
            assert {r["pk"] for r in found.collect()} == want and want


@pytest.fixture(scope="module")
def more_orders(tmp_path_factory):
    """A folder with orders three times over, keys shifted: customers' keys outgrow the bits that ORDERS4 has for them."""
    path = tmp_path_factory.mktemp("more")
    duckdb.sql(f"COPY (SELECT o_orderkey * 3 + k AS o_orderkey, o_custkey + k * 15000 AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM '/root/testdata/sf0.01/orders.parquet', range(3) t(k)) TO '{path}/orders.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["storage_report", "csv_points", "csv_skip_limit", "sharded_store_counts", "mixed_workload"])
def test_values_beyond_the_preset(spark, more_orders, name):
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{more_orders}/orders.parquet'")
    got = queries.QUERIES[name](spark, more_orders)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_fitted_schema(spark):
    points = _points(spark, [(1, 5, 40, 3), (2, None, -1, 15)])
    wide = layout.fitted(points, SMALL)
    assert [a.bits for a in SMALL.attributes] == [6, 3, 4] and [a.bits for a in wide.attributes] == [6, 6, 4]
    assert layout.fitted(points.where("pk = 3"), SMALL) == SMALL
