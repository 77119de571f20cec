"""Registered queries over the star-schema tables, and the same in DuckDB SQL. Queries run over whole tables; limits stand only
where a query is about the first k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthobox.functions import morton
from orthobox.operators import layout, lookup, search
from orthobox.plans.box import LINEITEM_LINES, REPOSITORY_LINES, TAXI_LINES, BoxQuery, corpus_frame, random_boxes
from orthobox.schema import EVENTS5, GITHUB10, LINEITEM7, NYC15, ORDERS4, WORD_BITS, PointSchema
from orthobox.sources import tables
from orthobox.sources.files import synthetic, zipf_keys
from orthobox.streaming.ingest import plan_mixed, run_mixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_DAY = "(year({0}) * 10000 + month({0}) * 100 + day({0}) - {1})::BIGINT"
_POINTS = {
    "lineitem7": f"""p AS (SELECT round(l_quantity)::BIGINT AS quantity, round(l_extendedprice * 100)::BIGINT AS extendedprice, round(l_discount * 100)::BIGINT AS discount, round(l_tax * 100)::BIGINT AS tax,
        {_DAY.format('l_shipdate', 19000000)} AS shipdate, round(o_totalprice * 100)::BIGINT AS totalprice, {_DAY.format('o_orderdate', 19000000)} AS orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "orders4": f"p AS (SELECT o_orderkey AS pk, o_custkey AS custkey, round(o_totalprice * 100)::BIGINT AS totalprice, {_DAY.format('o_orderdate', 19000000)} AS orderdate, left(o_orderpriority, 1)::BIGINT AS priority FROM orders)",
    "events5": f"""p AS (SELECT event_id AS pk, {_DAY.format('ts', 20000000)} AS day, hour(ts)::BIGINT AS hour, user_id, round(value * 100)::BIGINT AS value,
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END::BIGINT AS event_type FROM events)""",
}
_SCHEMAS = {"lineitem7": (LINEITEM7, tables.lineitem7), "orders4": (ORDERS4, tables.orders4), "events5": (EVENTS5, tables.events5)}


def _register(name: str, sql: str | None = None, of: str | None = None):
    """Registers a query; with `of`, the SQL may use p, the points of that preset."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {_POINTS[of]} {sql}" if of else sql
        return f

    return keep


def _where(**bounds) -> str:
    parts = [f"{a} >= {lo}" for a, (lo, hi) in bounds.items() if lo is not None] + [f"{a} <= {hi}" for a, (lo, hi) in bounds.items() if hi is not None]
    return " AND ".join(parts) or "true"


def _box(name: str, of: str, sql_bounds: dict, box: BoxQuery, **options) -> None:
    schema, points = _SCHEMAS[of]
    _register(name, f"SELECT {', '.join(schema.names)} FROM p WHERE {_where(**sql_bounds)}", of)(lambda spark, d: search.range_search(points(spark, d, box), box, **options))


_Q = ("quantity", "discount", "shipdate", "orderdate")
#: The first five corpus lines on the attributes that the tables have, in stored units.
_LINE_BOUNDS = [
    {"quantity": (1, 50), "discount": (8, 9), "shipdate": (920102, 981201), "orderdate": (920101, 980802)},
    {"quantity": (40, 46), "discount": (0, 10), "shipdate": (930101, 971231), "orderdate": (920101, 980802)},
    {"quantity": (28, 49), "discount": (8, 10), "shipdate": (920102, 981201), "orderdate": (920101, 980802)},
    {"quantity": (1, 50), "discount": (5, 7), "shipdate": (950101, 951231), "orderdate": (920101, 980802)},
    {"quantity": (28, 32), "discount": (0, 10), "shipdate": (970101, 971231), "orderdate": (930101, 971231)},
]
for _k, _bounds in enumerate(_LINE_BOUNDS):
    _box(f"box_lineitem_q{_k + 1}", "lineitem7", _bounds, BoxQuery.parse(LINEITEM_LINES[_k], LINEITEM7))

_box("box_open_hi", "events5", {"day": (None, 240115), "event_type": (2, 2)}, BoxQuery.parse("0,-1,20240115,4,2,2", EVENTS5))
_box("box_open_lo", "orders4", {"totalprice": (45000000, None), "priority": (2, None)}, BoxQuery.parse("1,45000000,-1,3,2,-1", ORDERS4))
_box("box_point_eq", "events5", {"hour": (12, 12), "event_type": (0, 0)}, BoxQuery.parse("1,12,12,4,0,0", EVENTS5))
_box("box_profile_bounds", "lineitem7", {"quantity": (1, 50), "extendedprice": (90000, 10494950), "discount": (5, 10), "tax": (0, 8), "shipdate": (920102, 981201), "totalprice": (81300, 58063825), "orderdate": (920101, 980802)}, BoxQuery(LINEITEM7, {"discount": (5, None)}), open_bounds="profile")
_box("box_inverted_empty", "orders4", {"totalprice": (200, 100)}, BoxQuery(ORDERS4, {"totalprice": (200, 100)}))
_box("box_no_bounds", "orders4", {}, BoxQuery(ORDERS4))
_box("box_events_two_dim", "events5", {"day": (240105, 240112), "hour": (8, 17)}, BoxQuery.parse("0,20240105,20240112,1,8,17", EVENTS5))
_box("box_events_value_user", "events5", {"value": (None, 5000), "user_id": (10, 20)}, BoxQuery.parse("3,-1,5000,2,10,20", EVENTS5))
_box("box_orders_price_date", "orders4", {"orderdate": (None, 990101), "priority": (4, None), "totalprice": (20000000, None)}, BoxQuery.parse("2,-1,19990101,3,4,-1,1,20000000,-1", ORDERS4))


@_register("box_bag_duplicates", "SELECT hour, event_type FROM p", "events5")
def box_bag_duplicates(spark, d):
    return search.range_search(tables.events5(spark, d), BoxQuery(EVENTS5)).select("hour", "event_type")


@_register("box_rows_with_pk", "SELECT pk, custkey, totalprice, orderdate, priority FROM p WHERE priority = 1 AND totalprice >= 40000000", "orders4")
def box_rows_with_pk(spark, d):
    return search.range_search(tables.orders4(spark, d), BoxQuery(ORDERS4, {"priority": (1, 1), "totalprice": (40000000, None)}), mode="rows")


def _boxes_sql(boxes: list[BoxQuery]) -> str:
    parts = []
    for qid, b in enumerate(boxes):
        parts.append(f"SELECT {qid}::BIGINT AS qid, count(*)::BIGINT AS found FROM p WHERE {_where(**b.bounds)}")
    return " UNION ALL ".join(parts)


_CORPUS = [BoxQuery.parse(line, LINEITEM7) for line in LINEITEM_LINES]
_RANDOM = random_boxes(ORDERS4, 40, seed=11, names=["totalprice", "orderdate"])


@_register("box_count_batch", _boxes_sql(_CORPUS), "lineitem7")
def box_count_batch(spark, d):
    return search.batch_counts(tables.lineitem7(spark, d), _CORPUS, LINEITEM7)


@_register("box_rows_batch", " UNION ALL ".join(f"SELECT {q}::BIGINT AS qid, {', '.join(LINEITEM7.names)} FROM p WHERE {_where(**b.bounds)}" for q, b in enumerate(_CORPUS)), "lineitem7")
def box_rows_batch(spark, d):
    return search.batch_search(tables.lineitem7(spark, d), _CORPUS, LINEITEM7)


@_register("random_boxes_counts", _boxes_sql(_RANDOM), "orders4")
def random_boxes_counts(spark, d):
    return search.batch_counts(tables.orders4(spark, d), _RANDOM, ORDERS4)


@_register("selective_boxes", f"SELECT qid, found FROM ({_boxes_sql(_RANDOM)}) WHERE found BETWEEN 100 AND 2000", "orders4")
def selective_boxes(spark, d):
    return search.selective_boxes(tables.orders4(spark, d), _RANDOM, ORDERS4, 100, 2000)


def _sweep(dims: int) -> None:
    part = LINEITEM7.truncate(dims)
    boxes = random_boxes(part, 12, seed=dims)
    _register(f"dims_sweep_{dims}", _boxes_sql(boxes), "lineitem7")(lambda spark, d: search.batch_counts(tables.lineitem7(spark, d).select(part.names), boxes, part))


for _k in (4, 5, 6, 7):
    _sweep(_k)


@_register("lookup_one", "SELECT * FROM p WHERE pk = 42", "orders4")
def lookup_one(spark, d):
    return lookup.lookup(tables.orders4(spark, d), 42, ORDERS4)


@_register("lookup_missing", "SELECT * FROM p WHERE pk = -5", "orders4")
def lookup_missing(spark, d):
    return lookup.lookup(tables.orders4(spark, d), -5, ORDERS4)


@_register("lookup_many", "SELECT p.* FROM p JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49) ON pk = l_orderkey", "orders4")
def lookup_many(spark, d):
    keys = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity >= 49").select(F.col("l_orderkey").alias("pk")).distinct()
    return lookup.lookup_many(tables.orders4(spark, d), keys, ORDERS4)


_PROBES = "SELECT custkey, totalprice, orderdate, CASE WHEN pk % 2 = 0 THEN priority ELSE priority % 5 + 1 END AS priority FROM p"


def _probes(spark, d):
    p = tables.orders4(spark, d)
    return p, p.select("custkey", "totalprice", "orderdate", F.when(F.col("pk") % 2 == 0, F.col("priority")).otherwise(F.col("priority") % 5 + 1).alias("priority"))


@_register("check_present", f"SELECT * FROM ({_PROBES}) SEMI JOIN p USING (custkey, totalprice, orderdate, priority)", "orders4")
def check_present(spark, d):
    return lookup.check_many(*_probes(spark, d), ORDERS4)


@_register("check_absent", f"SELECT * FROM ({_PROBES}) ANTI JOIN p USING (custkey, totalprice, orderdate, priority)", "orders4")
def check_absent(spark, d):
    return lookup.check_many(*_probes(spark, d), ORDERS4, present=False)


def _packed_sql(bits: list[tuple[str, int]]) -> str:
    return "(" + " | ".join(f"((({a} >> {b}) & 1) << {len(bits) - 1 - k})" for k, (a, b) in enumerate(bits)) + ")"


def _words_sql(schema: PointSchema) -> list[str]:
    bits = schema.key_bits()
    return [_packed_sql(bits[k : k + WORD_BITS]) for k in range(0, len(bits), WORD_BITS)]


@_register("morton_symbols", "SELECT " + ", ".join(f"{_packed_sql([(a.name, a.width - lv - 1) for a in LINEITEM7.level_members(lv)])} AS s{lv}" for lv in (0, 7, 12, 20, 31)) + ", count(*)::BIGINT AS n FROM p GROUP BY ALL", "lineitem7")
def morton_symbols(spark, d):
    symbols = [morton.level_symbol(LINEITEM7, lv).alias(f"s{lv}") for lv in (0, 7, 12, 20, 31)]
    return tables.lineitem7(spark, d).select(*symbols).groupBy(*[f"s{lv}" for lv in (0, 7, 12, 20, 31)]).agg(F.count("*").alias("n"))


@_register("morton_words", "SELECT p.*, " + ", ".join(f"{w} AS z{k}" for k, w in enumerate(_words_sql(LINEITEM7))) + " FROM p", "lineitem7")
def morton_words(spark, d):
    return morton.with_key(tables.lineitem7(spark, d), LINEITEM7)


@_register("morton_first_k", "SELECT custkey, totalprice, orderdate, priority, " + ", ".join(f"{w} AS z{k}" for k, w in enumerate(_words_sql(ORDERS4))) + f" FROM p ORDER BY {', '.join(f'z{k}' for k in range(ORDERS4.n_words))} LIMIT 100", "orders4")
def morton_first_k(spark, d):
    return search.first_in_order(tables.orders4(spark, d), ORDERS4, 100)


@_register("morton_roundtrip", f"SELECT {', '.join(LINEITEM7.names)} FROM p", "lineitem7")
def morton_roundtrip(spark, d):
    names = morton.word_names(LINEITEM7)
    keys = tables.lineitem7(spark, d).select(*[w.alias(n) for n, w in zip(names, morton.words(LINEITEM7))])
    return keys.select(*[c.alias(a) for a, c in morton.decoded(LINEITEM7).items()])


@_register("morton_binary_order", "SELECT pk, row_number() OVER (ORDER BY " + ", ".join(_words_sql(ORDERS4)) + ", pk)::BIGINT AS place FROM p QUALIFY place <= 50", "orders4")
def morton_binary_order(spark, d):
    from pyspark.sql import Window

    first = tables.orders4(spark, d).withColumn("key", morton.binary_key(ORDERS4)).orderBy("key", "pk").limit(50)
    return first.select("pk", F.row_number().over(Window.orderBy("key", "pk")).cast("long").alias("place"))


@_register("bit_functions", "SELECT pk, (totalprice >> 3) & 1 AS bit3, totalprice | 16 AS set4, totalprice & ~16::BIGINT AS clear4, bit_count(totalprice)::BIGINT AS ones, length(ltrim(bin(totalprice), '0'))::BIGINT AS width FROM p", "orders4")
def bit_functions(spark, d):
    v = F.col("totalprice")
    return tables.orders4(spark, d).select("pk", morton.get_bit(v, 3).alias("bit3"), morton.set_bit(v, 4).alias("set4"), morton.clear_bit(v, 4).alias("clear4"), morton.pop_count(v).alias("ones"), morton.bit_width(v).alias("width"))


@_register("kth_set_bit", "SELECT pk, (SELECT list_sort(list(i))[3] FROM range(0, 63) t(i) WHERE (totalprice >> i) & 1 = 1)::BIGINT AS third FROM p", "orders4")
def kth_set_bit(spark, d):
    return tables.orders4(spark, d).select("pk", morton.kth_set_bit(F.col("totalprice"), 2).alias("third"))


@_register("shard_counts", "SELECT (pk % 20)::INTEGER AS shard, count(*)::BIGINT AS n FROM p GROUP BY 1", "orders4")
def shard_counts(spark, d):
    return layout.shard_counts(tables.orders4(spark, d), 20)


@_register("shard_lookup", "SELECT * FROM p WHERE pk = 137 AND pk % 20 = 17", "orders4")
def shard_lookup(spark, d):
    return lookup.lookup(layout.with_shard(tables.orders4(spark, d), 20), 137, ORDERS4, n_shards=20)


@_register("shard_hot_keys", "SELECT (l_orderkey % 20)::INTEGER AS shard, count(*)::BIGINT AS n FROM p JOIN lineitem ON pk = l_orderkey GROUP BY 1", "orders4")
def shard_hot_keys(spark, d):
    """Lookups routed by keys that repeat as line items do."""
    keys = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("pk"))
    return layout.shard_counts(lookup.lookup_many(tables.orders4(spark, d), keys, ORDERS4), 20)


def _prefix_sql(schema: PointSchema, level: int) -> str:
    kept = schema.prefix_bits(level)
    return ", ".join(f"{a.name} >> {a.bits - kept[a.name]}" for a in schema.attributes)


def _levels_sql(schema: PointSchema, levels: list[int]) -> str:
    one = "SELECT {0}::INTEGER AS level, count(*)::BIGINT AS nodes, count_if(k = 1)::BIGINT AS collapsed FROM (SELECT x, count(DISTINCT y) AS k FROM (SELECT row({1}) AS x, row({2}) AS y FROM p) GROUP BY x)"
    return " UNION ALL ".join(one.format(lv, _prefix_sql(schema, lv), _prefix_sql(schema, min(lv + 1, schema.depth - 1))) for lv in levels)


@_register("level_nodes", _levels_sql(ORDERS4, [0, 3, 7, 11, 15, 19, 25]), "orders4")
def level_nodes(spark, d):
    return layout.level_nodes(tables.orders4(spark, d), ORDERS4, [0, 3, 7, 11, 15, 19, 25])


@_register("leaf_multiplicity", "SELECT copies, count(*)::BIGINT AS n FROM (SELECT count(*)::BIGINT AS copies FROM p GROUP BY quantity, discount, shipdate, orderdate) GROUP BY 1", "lineitem7")
def leaf_multiplicity(spark, d):
    return layout.multiplicities(tables.lineitem7(spark, d), list(_Q))


@_register("leaf_key_lists", "SELECT day, hour, event_type, array_to_string(list_sort(list(pk)), ',') AS pks FROM p GROUP BY 1, 2, 3", "events5")
def leaf_key_lists(spark, d):
    return layout.key_lists(tables.events5(spark, d), ["day", "hour", "event_type"]).withColumn("pks", F.array_join(F.transform("pks", lambda x: x.cast("string")), ","))


@_register("attribute_bounds", " UNION ALL ".join(f"SELECT '{a}' AS attribute, min({a}) AS low, max({a}) AS high, CASE WHEN max({a}) = 0 THEN 1 ELSE length(ltrim(bin(max({a})), '0')) END::BIGINT AS bits FROM p" for a in EVENTS5.names), "events5")
def attribute_bounds(spark, d):
    return layout.attribute_bounds(tables.events5(spark, d), EVENTS5)


@_register("insert_then_search", "SELECT custkey, totalprice, orderdate, priority FROM (SELECT * FROM p UNION ALL SELECT pk + 1000000, custkey, totalprice, orderdate, priority FROM p WHERE pk % 10 = 0) WHERE totalprice BETWEEN 1000000 AND 9000000", "orders4")
def insert_then_search(spark, d):
    points = tables.orders4(spark, d)
    more = points.where("pk % 10 = 0").withColumn("pk", F.col("pk") + 1000000)
    return search.range_search(points.unionByName(more), BoxQuery(ORDERS4, {"totalprice": (1000000, 9000000)}))


@_register("insert_same_pk_latest", "SELECT pk, custkey, totalprice, orderdate, arg_max(priority, s) AS priority FROM (SELECT *, 0 AS s FROM p UNION ALL SELECT pk, custkey, totalprice, orderdate, priority % 5 + 1, 1 FROM p WHERE pk % 3 = 0) GROUP BY 1, 2, 3, 4", "orders4")
def insert_same_pk_latest(spark, d):
    points = tables.orders4(spark, d)
    again = points.where("pk % 3 = 0").withColumn("priority", F.col("priority") % 5 + 1)
    both = points.withColumn("seq", F.lit(0)).unionByName(again.withColumn("seq", F.lit(1)))
    return lookup.latest(both, "seq").select("pk", *ORDERS4.names)


def _parsed(lines: list[str], schema: PointSchema) -> list[tuple]:
    return [(f"{schema.name}:{k}", a, lo, hi) for k, line in enumerate(lines) for a, (lo, hi) in BoxQuery.parse(line, schema).bounds.items()]


@_register("corpus_parse", """SELECT * FROM (VALUES
    ('nyc15:0', 'pickup_longitude', 70, 860), ('nyc15:0', 'pickup_latitude', 660, 760), ('nyc15:1', 'pickup_date', 70109, 70114), ('nyc15:1', 'dropoff_date', 450616, 460617),
    ('nyc15:2', 'pickup_date', -1, 20924), ('nyc15:2', 'passenger_count', 0, 0), ('nyc15:3', 'trip_distance', -1, 202), ('nyc15:3', 'fare_amount', 89, 6129),
    ('github10:0', 'start_date', -1, 71122), ('github10:0', 'end_date', 80304, -1), ('github10:0', 'stars', 147, -1), ('github10:1', 'stars', 52, -1), ('github10:1', 'forks', 37, -1),
    ('github10:2', 'events_count', -1, 18006), ('github10:2', 'issues', 5, -1), ('github10:2', 'stars', 122, -1)) t(box, attribute, low, high)""")
def corpus_parse(spark, d):
    """Bounds of the other corpora's templates in stored units, open ones as -1."""
    rows = _parsed(TAXI_LINES, NYC15) + _parsed(REPOSITORY_LINES, GITHUB10)
    return spark.createDataFrame(rows, "box string, attribute string, low int, high int").fillna(-1)


_UNIFORM = "('0x' || substr(md5(concat_ws('|', '7', {0}, id::VARCHAR)), 1, 8))::BIGINT"


@_register("synthetic_points", "SELECT id AS a0, " + ", ".join(f"{_UNIFORM.format(repr(str(k - 1)))} % 65536 + 1 AS a{k}" for k in range(1, 9)) + " FROM range((SELECT count(*) FROM events)) t(id)")
def synthetic_points(spark, d):
    """As many points of nine attributes as there are events; every one is in the box over everything."""
    from orthobox.schema import Attribute

    schema = PointSchema("uniform9", tuple(Attribute(f"a{k}", 32) for k in range(9)))
    n = spark.read.parquet(f"{d}/events.parquet").count()
    return search.range_search(synthetic(spark, n, schema), BoxQuery(schema, {a: (0, None) for a in schema.names}))


@_register("zipf_lookups", f"SELECT (pk % 20)::INTEGER AS shard, count(*)::BIGINT AS n FROM p JOIN (SELECT floor(pow(5001.0::DOUBLE, {_UNIFORM.format(repr('zipf'))} / 4294967296.0::DOUBLE))::BIGINT AS k FROM range((SELECT count(*) FROM lineitem)) t(id)) ON pk = k GROUP BY 1", "orders4")
def zipf_lookups(spark, d):
    """As many lookups as there are line items, by keys of a Zipf distribution, counted by the shard that answers."""
    keys = zipf_keys(spark, spark.read.parquet(f"{d}/lineitem.parquet").count(), 5000)
    return layout.shard_counts(lookup.lookup_many(tables.orders4(spark, d), keys, ORDERS4), 20)


@_register("storage_report", "SELECT 16::BIGINT AS files, count(*)::BIGINT AS rows, true AS sized FROM orders")
def storage_report(spark, d):
    """Files and rows of a store of 16 files, from the sizes of each."""
    from orthobox.queries_util import scratch

    path, points = scratch(spark), tables.orders4(spark, d)
    layout.write_clustered(points, path, layout.fitted(points, ORDERS4), 16)
    each = layout.file_sizes(spark, path)
    return each.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("sized"))


_COUNTED = BoxQuery(ORDERS4, {"totalprice": (20000000, 30000000), "priority": (None, 3)})


@_register("box_counters", f"SELECT count(*)::BIGINT AS checked, count_if({_where(**_COUNTED.bounds)})::BIGINT AS found FROM p", "orders4")
def box_counters(spark, d):
    """Points that a search looked at and points that it found."""
    found, seen = search.counted(tables.orders4(spark, d), _COUNTED)
    found.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["checked"], seen.get["found"])], "checked long, found long")


def _corpus_lines() -> list[str]:
    """1000 lines of the corpus grammar over orders, some bounds open: every k-th attribute of every k-th line."""
    out = []
    for q, box in enumerate(random_boxes(ORDERS4, 1000, seed=21, names=["totalprice", "orderdate", "priority"])):
        parts = []
        for k, (a, (lo, hi)) in enumerate(box.bounds.items()):
            if (q + k) % 4 != 3:
                up = ORDERS4.at(a).offset
                parts.append(f"{ORDERS4.names.index(a)},{-1 if (q + k) % 5 == 1 else lo + up},{-1 if (q + k) % 7 == 2 else hi + up}")
        out.append(",".join(parts))
    return out


_LINES = _corpus_lines()


def _values_sql(boxes: list[BoxQuery], schema: PointSchema) -> str:
    rows = [", ".join([str(q), *["NULL" if v is None else str(v) for a in schema.names for v in b.bounds.get(a, (None, None))]]) for q, b in enumerate(boxes)]
    return f"(VALUES {', '.join(f'({r})' for r in rows)}) b(qid, {', '.join(f'{a}_{e}' for a in schema.names for e in ('lo', 'hi'))})"


@_register("box_corpus_1000", f"SELECT qid::BIGINT AS qid, count(p.pk)::BIGINT AS found FROM {_values_sql([BoxQuery.parse(x, ORDERS4) for x in _LINES], ORDERS4)} LEFT JOIN p ON " + " AND ".join(f"({a}_lo IS NULL OR {a} >= {a}_lo) AND ({a}_hi IS NULL OR {a} <= {a}_hi)" for a in ORDERS4.names) + " GROUP BY qid", "orders4")
def box_corpus_1000(spark, d):
    """A query file of 1000 lines, read as a table and searched in one pass."""
    from orthobox.queries_util import scratch

    path = scratch(spark)
    spark.createDataFrame([(x,) for x in _LINES], "value string").coalesce(1).write.text(path)
    boxes = search.boxes_of_corpus(corpus_frame(spark, path), ORDERS4)
    return search.batch_counts(tables.orders4(spark, d), boxes, ORDERS4)


@_register("clustered_box", f"SELECT {', '.join(LINEITEM7.names)} FROM p WHERE {_where(**_LINE_BOUNDS[3])}", "lineitem7")
def clustered_box(spark, d):
    """The box of the fourth line, from a store clustered by key, with key ranges and pushed bounds."""
    from orthobox.queries_util import scratch

    path = scratch(spark)
    layout.write_clustered(tables.lineitem7(spark, d), path, LINEITEM7, 32)
    return search.range_search(spark.read.parquet(path), _CORPUS[3])


@_register("stream_ingest", "SELECT pk, day, hour, user_id, value, event_type FROM p WHERE hour BETWEEN 3 AND 9", "events5")
def stream_ingest(spark, d):
    """All events through a stream into a store, then a box over it."""
    from orthobox.queries_util import scratch
    from orthobox.streaming.ingest import start_ingest

    path = scratch(spark)
    spark.read.parquet(f"{d}/events.parquet").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    encoder = lambda df: tables.events_points(df)
    start_ingest(stream, encoder, f"{path}/store", f"{path}/state", EVENTS5, once=True).awaitTermination()
    found = search.range_search(spark.read.parquet(f"{path}/store"), BoxQuery(EVENTS5, {"hour": (3, 9)}), mode="rows")
    return found.select("pk", *EVENTS5.names)


def _order_files(spark, d) -> str:
    """Orders as headless delimited files: id, then raw attributes."""
    from orthobox.queries_util import scratch

    path, dates = scratch(spark), ORDERS4.at("orderdate").offset
    raw = tables.orders4(spark, d).withColumn("orderdate", F.col("orderdate") + dates)
    raw.repartition(4, "pk").write.csv(path)
    return path


@_register("csv_points", "SELECT * FROM p", "orders4")
def csv_points(spark, d):
    from orthobox.sources.files import read_csv

    return read_csv(spark, _order_files(spark, d), layout.fitted(tables.orders4(spark, d), ORDERS4))


@_register("csv_skip_limit", "SELECT * FROM p ORDER BY pk LIMIT 500 OFFSET 1000", "orders4")
def csv_skip_limit(spark, d):
    """The reader's own skip and limit, by id."""
    from orthobox.sources.files import read_csv

    return read_csv(spark, _order_files(spark, d), layout.fitted(tables.orders4(spark, d), ORDERS4), skip=1000, limit=500)


@_register("csv_split_parts", "SELECT count(*)::BIGINT AS n, min(pk) AS low, max(pk) AS high FROM p", "orders4")
def csv_split_parts(spark, d):
    from orthobox.sources.files import read_split

    return read_split(spark, _order_files(spark, d), ORDERS4).where("part is not null").agg(F.count("*").alias("n"), F.min("pk").alias("low"), F.max("pk").alias("high"))


@_register("sharded_store_counts", "SELECT (pk % 8)::INTEGER AS shard, count(*)::BIGINT AS n FROM p WHERE totalprice >= 20000000 GROUP BY 1", "orders4")
def sharded_store_counts(spark, d):
    """A box over a store that is partitioned by shard, then compacted."""
    from orthobox.queries_util import scratch

    first, second = scratch(spark), scratch(spark)
    points = tables.orders4(spark, d)
    schema = layout.fitted(points, ORDERS4)
    layout.write_clustered(layout.with_shard(points.where("pk % 2 = 0"), 8), first, schema, 8, by_shard=True)
    layout.write_clustered(layout.with_shard(points.where("pk % 2 = 1"), 8), first, schema, 8, mode="append", by_shard=True)
    layout.compact(spark, first, second, schema, 8)
    found = search.range_search(spark.read.parquet(second), BoxQuery(schema, {"totalprice": (20000000, None)}), mode="rows")
    return found.groupBy(F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("n"))


@_register("files_met", " UNION ALL ".join(f"SELECT '{name}' AS layout, {fewer} AS fewer, qid, found FROM ({_boxes_sql(_CORPUS)})" for name, fewer in (("clustered", "true"), ("scattered", "false"))), "lineitem7")
def files_met(spark, d):
    """(layout, fewer, qid, found): whether the corpus boxes meet fewer than half of a store's files, clustered by key and
    scattered, and how many points of each box lie in the files that it meets: all of them."""
    from orthobox.queries_util import scratch

    points, out = tables.lineitem7(spark, d), []
    for name in ("clustered", "scattered"):
        path = scratch(spark)
        if name == "clustered":
            layout.write_clustered(points, path, LINEITEM7, 32)
        else:
            points.repartition(32).write.parquet(path)
        ranges = layout.file_ranges(spark, path, LINEITEM7).cache()
        met = ranges.select("file", *[layout.meets(b).alias(f"m{q}") for q, b in enumerate(_CORPUS)])
        share = ranges.agg(*[F.avg(layout.meets(b).cast("int")).alias(f"m{q}") for q, b in enumerate(_CORPUS)]).first()
        stored = spark.read.parquet(path).select(*LINEITEM7.names, F.col("_metadata.file_path").alias("file"))
        row = stored.join(F.broadcast(met), "file").agg(*[F.count_if(F.col(f"m{q}") & b.predicate()).alias(f"m{q}") for q, b in enumerate(_CORPUS)]).first()
        out += [(name, sum(share) / len(_CORPUS) < 0.5, q, n) for q, n in enumerate(row)]
    return spark.createDataFrame(out, "layout string, fewer boolean, qid long, found long")


_MIX = {"weights": (5, 95, 5), "operations": 201, "seed": 3, "rounds": 2, "max_pk": 14_999}


def _mixed_sql() -> str:
    """Each round's lookups and searches over the points that the store holds by then."""
    plan, inserted, parts = plan_mixed(ORDERS4, *_MIX.values()), 0, {"insert": [], "lookup": [], "search": []}
    for n, keys, boxes in plan:
        inserted += n
        parts["lookup"].append(f"(SELECT count(*) FROM s JOIN (VALUES {', '.join(f'({k})' for k in keys)}) t(k) ON pk = k WHERE nth <= {inserted})")
        parts["search"] += [f"(SELECT count(*) FROM s WHERE nth <= {inserted} AND {_where(**b.bounds)})" for b in boxes]
    parts["insert"].append(f"(SELECT count(*) FROM s WHERE nth BETWEEN 1 AND {inserted})")
    counts = {"insert": inserted, "lookup": sum(len(p[1]) for p in plan), "search": sum(len(p[2]) for p in plan)}
    rows = [f"SELECT '{k}' AS kind, {counts[k]}::BIGINT AS operations, ({' + '.join(parts[k])})::BIGINT AS rows" for k in parts]
    return "s AS (SELECT *, CASE WHEN pk % 10 = 0 THEN row_number() OVER (PARTITION BY pk % 10 = 0 ORDER BY pk) ELSE 0 END AS nth FROM p) " + " UNION ALL ".join(rows)


@_register("mixed_workload")
def mixed_workload(spark, d):
    """(kind, operations, rows) of a seeded mix of inserts, lookups and searches over a store that grows."""
    points = tables.orders4(spark, d)
    done = run_mixed(spark, points.where("pk % 10 != 0"), points.where("pk % 10 = 0"), ORDERS4, **_MIX)
    return spark.createDataFrame([(k, v["operations"], int(v["rows"])) for k, v in done.items()], "kind string, operations long, rows long")


SQL["mixed_workload"] = f"WITH {_POINTS['orders4']}, {_mixed_sql()}"
