"""The package's queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bounds, coords, geometry, properties, wkt
from ..operators import layout, rtree, select, shared
from ..sources import dataset, geojson
from . import synth

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The same integer formulas as in synth.py, for DuckDB.
_LNG, _LAT = "CAST(({0} * 2654435761) % 3600000001 - 1800000000 AS INTEGER)", "CAST(({0} * 1597334677) % 1800000001 - 900000000 AS INTEGER)"
_CUSTOMER = f"pt AS (SELECT c_custkey AS id, {_LNG.format('c_custkey')} AS lng, {_LAT.format('c_custkey')} AS lat FROM customer)"
_EVENT = f"ev AS (SELECT event_id AS id, CAST({_LNG.format('user_id')} + (event_id * 7919) % 2000001 - 1000000 AS INTEGER) AS lng, CAST({_LAT.format('user_id')} + (event_id * 7919) % 2000001 - 1000000 AS INTEGER) AS lat FROM events)"
_PART = """pa AS (SELECT p_partkey AS id, CAST(x - p_size * 100000 AS INTEGER) AS min_lng, CAST(y - p_size * 100000 AS INTEGER) AS min_lat, CAST(x + p_size * 100000 AS INTEGER) AS max_lng, CAST(y + p_size * 100000 AS INTEGER) AS max_lat
  FROM (SELECT p_partkey, p_size, (p_partkey * 2654435761) % 3500000001 - 1750000000 AS x, (p_partkey * 1597334677) % 1700000001 - 850000000 AS y FROM part))"""
_LINE = f"li AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_LNG.format('l_partkey')} AS lng, {_LAT.format('l_partkey')} AS lat FROM lineitem)"
_LINE_BOUNDS = _LINE + ", lb AS (SELECT o_orderkey AS id, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat, count(lng) AS n FROM orders LEFT JOIN li ON o_orderkey = li.id GROUP BY o_orderkey)"
_NATION = f"na AS (SELECT n_nationkey AS id, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM nation LEFT JOIN (SELECT s_nationkey, {_LNG.format('s_suppkey')} AS lng, {_LAT.format('s_suppkey')} AS lat FROM supplier WHERE s_nationkey % 5 <> 0) ON n_nationkey = s_nationkey GROUP BY n_nationkey)"
_BOX = bounds.Box.degrees(-10, -10, 60, 45)
_IN_BOX = "max_lng >= -100000000 AND max_lat >= -100000000 AND min_lng <= 600000000 AND min_lat <= 450000000"
_FOUR = "min_lng, min_lat, max_lng, max_lat"
_FILLED = ", ".join(f"coalesce({n}, 0) AS {n}" for n in bounds.NAMES)


def _filled() -> list:
    """Bounds with 0 for NULL, and whether they are empty."""
    return [F.isnull("min_lng").alias("empty"), *(F.coalesce(n, F.lit(0)).alias(n) for n in bounds.NAMES)]



def _hilbert_sql() -> str:
    """CTEs h0 .. h16 over pt: one step of the curve each, ending in pos (stored order)."""
    out = ["ex AS (SELECT min(lng) AS x0, min(lat) AS y0, CAST(max(lng) AS BIGINT) - min(lng) AS w, CAST(max(lat) AS BIGINT) - min(lat) AS h FROM pt)"]
    out.append("h0 AS (SELECT id, lng, lat, CASE WHEN w = 0 THEN 0 ELSE ((CAST(lng AS BIGINT) - x0) * 65535) // w END AS x, CASE WHEN h = 0 THEN 0 ELSE ((CAST(lat AS BIGINT) - y0) * 65535) // h END AS y, CAST(0 AS BIGINT) AS d FROM pt, ex)")
    for k in range(16):
        s = 1 << (15 - k)
        out.append(f"r{k} AS (SELECT *, CASE WHEN (x & {s}) > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN (y & {s}) > 0 THEN 1 ELSE 0 END AS ry FROM h{k})")
        out.append(f"h{k + 1} AS (SELECT id, lng, lat, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN 65535 - y ELSE y END AS x, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN 65535 - x ELSE x END AS y, d + CAST({s} AS BIGINT) * {s} * xor(3 * rx, ry) AS d FROM r{k})")
    out.append("ranked AS (SELECT id, lng, lat, d AS hilbert, row_number() OVER (ORDER BY d DESC, id) - 1 AS pos FROM h16)")
    return ", ".join(out)


_RANKED = f"WITH RECURSIVE {_CUSTOMER}, {_hilbert_sql()}"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ranked(layout.with_hilbert(synth.pt_customer(spark, sf_dir)))


# Coordinates


@_query("SELECT c_custkey, CAST(CASE WHEN isnan(x) THEN 0 ELSE trunc(greatest(-2147483648.0, least(2147483647.0, x))) END AS INTEGER) AS units FROM (SELECT c_custkey, c_acctbal / 7.0::DOUBLE * 1e7::DOUBLE AS x FROM customer)")
def coord_from_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.read(spark, sf_dir, "customer")
    return c.select("c_custkey", coords.to_units(F.col("c_acctbal") / F.lit(7.0)).alias("units"))


@_query(f"WITH {_CUSTOMER} SELECT id, lng / 1e7::DOUBLE AS lng_degrees, lat / 1e7::DOUBLE AS lat_degrees FROM pt")
def coord_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.pt_customer(spark, sf_dir)
    return f.select(F.col("feature_id").alias("id"), coords.to_degrees(F.col("min_lng")).alias("lng_degrees"), coords.to_degrees(F.col("min_lat")).alias("lat_degrees"))


@_query(f"WITH {_CUSTOMER} SELECT id, CAST(1234567 AS INTEGER) AS lng, lat FROM pt")
def coord_with_lng(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.points(F.col("geom"))[0]
    f = synth.pt_customer(spark, sf_dir).select(F.col("feature_id").alias("id"), coords.with_lng(p, F.lit(1234567)).alias("p"))
    return f.select("id", "p.lng", "p.lat")


# Bounds


@_query(f"WITH {_CUSTOMER} SELECT id, least(lng, -lat) AS min_lng, least(lat, -lng) AS min_lat, greatest(lng, -lat) AS max_lng, greatest(lat, -lng) AS max_lat FROM pt")
def bounds_from_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.pt_customer(spark, sf_dir).select(F.col("feature_id").alias("id"), F.col("min_lng").alias("x"), F.col("min_lat").alias("y"))
    return f.select("id", *bounds.from_corners(F.col("x"), F.col("y"), -F.col("y"), -F.col("x")))


@_query(f"WITH {_PART} SELECT id, CAST(max_lng AS BIGINT) - min_lng AS width, CAST(max_lat AS BIGINT) - min_lat AS height FROM pa")
def bounds_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), bounds.width().alias("width"), bounds.height().alias("height"))


@_query(f"WITH {_LINE_BOUNDS} SELECT id, n = 0 AS empty, coalesce(CAST(min_lng + (CAST(max_lng AS BIGINT) - min_lng) // 2 AS INTEGER), 0) AS lng, coalesce(CAST(min_lat + (CAST(max_lat AS BIGINT) - min_lat) // 2 AS INTEGER), 0) AS lat FROM lb")
def bounds_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    lng, lat = bounds.center()
    f = synth.line_order(spark, sf_dir)
    return f.select(F.col("feature_id").alias("id"), F.isnull("min_lng").alias("empty"), F.coalesce(lng, F.lit(0)).alias("lng"), F.coalesce(lat, F.lit(0)).alias("lat"))


@_query(f"WITH {_CUSTOMER} SELECT id, lng AS min_lng, lat AS min_lat, lng AS max_lng, lat AS max_lat FROM pt")
def bounds_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.pt_customer(spark, sf_dir).select(F.col("feature_id").alias("id"), *geometry.bounds(F.col("geom")))


@_query(f"WITH {_LINE_BOUNDS} SELECT id, n = 0 AS empty, {_FILLED} FROM lb")
def bounds_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), *_filled())


@_query(f"WITH {_PART} SELECT id, {_FOUR} FROM pa")
def bounds_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), *bounds.of())


@_query(f"WITH {_NATION} SELECT CAST(id AS BIGINT) AS id, min_lng IS NULL AS empty, {_FILLED} FROM na")
def bounds_multipoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.mpt_nation(spark, sf_dir).select(F.col("feature_id").alias("id"), *_filled())


@_query(f"WITH {_PART} SELECT id, least(min_lng, 0) AS min_lng, least(min_lat, 0) AS min_lat, greatest(max_lng, 0) AS max_lng, greatest(max_lat, 0) AS max_lat FROM pa")
def bounds_with_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), *bounds.with_point(F.lit(0), F.lit(0)))


@_query(f"WITH {_LINE_BOUNDS}, {_PART} SELECT lb.id, least(lb.min_lng, pa.min_lng) AS min_lng, least(lb.min_lat, pa.min_lat) AS min_lat, greatest(lb.max_lng, pa.max_lng) AS max_lng, greatest(lb.max_lat, pa.max_lat) AS max_lat FROM lb JOIN pa USING (id)")
def bounds_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), *(F.col(n).alias("a_" + n) for n in bounds.NAMES))
    b = synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), *(F.col(n).alias("b_" + n) for n in bounds.NAMES))
    return a.join(b, "id").select("id", *bounds.union("a_", "b_"))


@_query(f"WITH {_LINE_BOUNDS} SELECT min(min_lng) AS min_lng, min(min_lat) AS min_lat, max(max_lng) AS max_lng, max(max_lat) AS max_lat FROM lb")
def dataset_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.line_order(spark, sf_dir).agg(*bounds.total())


# Selection


@_query(f"WITH {_CUSTOMER} SELECT id, lng, lat FROM pt")
def select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_all(synth.pt_customer(spark, sf_dir)).select(F.col("feature_id").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


@_query(f"WITH {_CUSTOMER} SELECT id, lng, lat FROM pt WHERE lng BETWEEN -100000000 AND 600000000 AND lat BETWEEN -100000000 AND 450000000")
def select_bbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.pt_customer(spark, sf_dir), _BOX).select(F.col("feature_id").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


@_query(f"WITH {_EVENT} SELECT id, lng, lat FROM ev WHERE lng BETWEEN -100000000 AND 600000000 AND lat BETWEEN -100000000 AND 450000000")
def select_bbox_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.pt_event(spark, sf_dir), _BOX).select(F.col("feature_id").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


@_query(f"WITH {_PART} SELECT id, {_FOUR} FROM pa WHERE {_IN_BOX}")
def select_bbox_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.rect_part(spark, sf_dir), _BOX).select(F.col("feature_id").alias("id"), *bounds.of())


@_query(f"WITH {_LINE_BOUNDS} SELECT id, {_FOUR} FROM lb WHERE {_IN_BOX}")
def select_bbox_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.line_order(spark, sf_dir), _BOX).select(F.col("feature_id").alias("id"), *bounds.of())


@_query(f"WITH {_PART}, e AS (SELECT max_lng AS x, max_lat AS y FROM pa WHERE id = 7) SELECT id FROM pa, e WHERE max_lng >= x AND max_lat >= y AND min_lng <= x + 1000000000 AND min_lat <= y + 1000000000")
def select_bbox_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box whose corner is a stored box's corner: touching counts."""
    f = synth.rect_part(spark, sf_dir)
    e = f.where("feature_id = 7").select("max_lng", "max_lat").first()
    return select.select_bbox(f, bounds.Box(e[0], e[1], e[0] + 1_000_000_000, e[1] + 1_000_000_000)).select(F.col("feature_id").alias("id"))


@_query(f"WITH {_PART} SELECT id FROM pa WHERE {_IN_BOX}")
def select_bbox_swapped_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.rect_part(spark, sf_dir), bounds.Box.degrees(60, -10, -10, 45)).select(F.col("feature_id").alias("id"))


@_query(f"WITH {_NATION} SELECT CAST(id AS BIGINT) AS id FROM na WHERE max_lng >= -2000000000 AND max_lat >= -1000000000 AND min_lng <= 2000000000 AND min_lat <= 1000000000")
def select_bbox_skips_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.mpt_nation(spark, sf_dir), bounds.Box.extent("-200,-100,200,100")).select(F.col("feature_id").alias("id"))


@_query(f"WITH {_CUSTOMER} SELECT id FROM pt WHERE lng BETWEEN 60000000 AND 140000000 AND lat BETWEEN 430000000 AND 510000000")
def app_square_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.pt_customer(spark, sf_dir), bounds.Box.around(10, 47, 4)).select(F.col("feature_id").alias("id"))


@_query(f"WITH {_CUSTOMER} SELECT id FROM pt WHERE lng BETWEEN 20000000 AND 180000000 AND lat BETWEEN 220000000 AND 380000000")
def app_viewport_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.pt_customer(spark, sf_dir), bounds.Box.viewport(-10, 20, 30, 40)).select(F.col("feature_id").alias("id"))


@_query(f"WITH {_CUSTOMER} SELECT id FROM pt WHERE lng BETWEEN -100000000 AND 600000000 AND lat BETWEEN -100000000 AND 450000000")
def select_bbox_css_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_bbox(synth.pt_customer(spark, sf_dir), bounds.Box.css(45, 60, -10, -10)).select(F.col("feature_id").alias("id"))


# Layout


@_query(f"{_RANKED} SELECT id, hilbert FROM ranked")
def hilbert_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_hilbert(synth.pt_customer(spark, sf_dir)).select(F.col("feature_id").alias("id"), "hilbert")


@_query(f"{_RANKED} SELECT id, pos FROM ranked")
def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select(F.col("feature_id").alias("id"), "pos")


@_query(f"{_RANKED} SELECT id, pos // (65536 // 28 + 1) AS page_id FROM ranked")
def page_assign_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages_fixed(_ranked(spark, sf_dir), 28, 65536).select(F.col("feature_id").alias("id"), "page_id")


_PAGED = f"""{_RANKED}, s AS (SELECT id, lng, lat, pos, 28 + id % 90 AS size FROM ranked
), fold AS (
  SELECT id, lng, lat, pos, size, CAST(0 AS BIGINT) AS page_id, CAST(size AS BIGINT) AS held FROM s WHERE pos = 0
  UNION ALL
  SELECT s.id, s.lng, s.lat, s.pos, s.size, CASE WHEN held > 4096 THEN page_id + 1 ELSE page_id END, CASE WHEN held > 4096 THEN s.size ELSE held + s.size END FROM fold JOIN s ON s.pos = fold.pos + 1)"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _ranked(spark, sf_dir).withColumn("size", F.lit(28) + F.col("feature_id") % 90)
    return layout.pages(sized, "size", 4096, exact=True)


@_query(f"{_PAGED} SELECT id, page_id FROM fold")
def page_assign_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir).select(F.col("feature_id").alias("id"), "page_id")


@_query(f"{_PAGED} SELECT page_id, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat, count(*) AS feature_count, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY page_id")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_stats(_paged(spark, sf_dir), "size")


@_query(f"""{_PAGED}, p AS (SELECT page_id, sum(size) + 12 AS b FROM fold GROUP BY page_id), st AS (SELECT page_id, coalesce(sum(b) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p)
SELECT id, CAST(o AS BIGINT) AS page_starting_offset, CAST(coalesce(sum(size) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS feature_offset FROM fold JOIN st USING (page_id)""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.addresses(_paged(spark, sf_dir), "size").select(F.col("feature_id").alias("id"), "page_starting_offset", "feature_offset")


@_query("SELECT count(*) AS feature_count, CAST(count(*) // 2341 + CASE WHEN count(*) % 2341 > 0 THEN 1 ELSE 0 END AS BIGINT) AS page_count FROM customer")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = layout.pages_fixed(_ranked(spark, sf_dir), 28, 65536)
    return paged.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("feature_count"), F.count(F.lit(1)).alias("page_count"))


# The packed tree

_LEVELS = "levels AS (SELECT 0 AS level, (SELECT count(*) FROM customer) AS n UNION ALL SELECT level + 1, (n + 15) // 16 FROM levels WHERE n > 1)"


@_query(f"WITH RECURSIVE {_LEVELS} SELECT level, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY level DESC) - n AS BIGINT) AS first_node FROM levels")
def rtree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = synth.read(spark, sf_dir, "customer").count()
    rows = [(len(rtree.node_ranges(n)) - 1 - k, b - a, a) for k, (a, b) in enumerate(rtree.node_ranges(n))]
    return spark.createDataFrame(rows, "level int, n long, first_node long")


@_query(f"""{_RANKED}, {_LEVELS} SELECT level, pos // CAST(power(16, level) AS BIGINT) AS pos, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM ranked, levels GROUP BY ALL""")
def rtree_node_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.nodes(_ranked(spark, sf_dir)).select("level", "pos", *bounds.NAMES)


@_query(f"""WITH RECURSIVE {_LEVELS}, st AS (SELECT level, n, CAST(sum(n) OVER (ORDER BY level DESC) - n AS BIGINT) AS f FROM levels)
SELECT p.f + i AS node, c.f + i * 16 AS first_child, least(c.f + i * 16 + 16, c.f + c.n) AS end_child FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM st WHERE level > 0) p JOIN st c ON c.level = p.level - 1""")
def rtree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = synth.read(spark, sf_dir, "customer").count()
    ranges = rtree.node_ranges(n)
    out = None
    for (a, b), (low, high) in zip(ranges, ranges[1:]):
        first = F.lit(low) + (F.col("id") - a) * rtree.FANOUT
        level = spark.range(a, b).select(F.col("id").alias("node"), first.alias("first_child"), F.least(first + rtree.FANOUT, F.lit(high)).alias("end_child"))
        out = level if out is None else out.unionByName(level)
    return out if out is not None else spark.createDataFrame([], "node long, first_child long, end_child long")


@_query(f"{_RANKED} SELECT pos FROM ranked WHERE lng BETWEEN -100000000 AND 600000000 AND lat BETWEEN -100000000 AND 450000000")
def rtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.search(_ranked(spark, sf_dir), _BOX)


# Properties


def _event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = synth.read(spark, sf_dir, "events")
    entries = properties.of(
        properties.entry("event_type", F.col("event_type"), "string"),
        properties.entry("value", F.col("value"), "float64"),
        properties.entry("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), "int64"),
    )
    return e.select("event_id", entries.alias("properties"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events")
def property_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("properties")
    return _event_props(spark, sf_dir).select("event_id", properties.get(p, "k", "bigint").alias("k"), properties.get(p, "value", "double").alias("value"))


@_query("SELECT event_id, CAST(NULL AS VARCHAR) AS missing, false AS has FROM events")
def property_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("properties")
    return _event_props(spark, sf_dir).select("event_id", properties.get(p, "nothing", "string").alias("missing"), properties.has(p, "nothing").alias("has"))


@_query("SELECT event_id, CAST(i - 1 AS INTEGER) AS place, ['event_type', 'value', 'k'][i] AS key, CAST([12, 10, 7][i] AS INTEGER) AS tag FROM (SELECT event_id, unnest([1, 2, 3]) AS i FROM events)")
def property_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_props(spark, sf_dir).select("event_id", F.posexplode("properties").alias("place", "p"))
    return e.select("event_id", "place", "p.key", F.col("p.tag").cast("int").alias("tag"))


@_query("SELECT event_id, CAST(4 AS INTEGER) AS n, event_type || '!' AS added FROM events")
def property_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_props(spark, sf_dir).withColumn("t", properties.get(F.col("properties"), "event_type", "string"))
    e = e.select("event_id", properties.insert(F.col("properties"), properties.entry("added", F.concat("t", F.lit("!")), "string")).alias("p"))
    return e.select("event_id", F.size("p").alias("n"), properties.get(F.col("p"), "added", "string").alias("added"))


# Geometry


@_query(f"WITH {_LINE_BOUNDS} SELECT id, CAST(n AS INTEGER) AS points, n = 0 AS empty FROM lb")
def point_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("geom")
    return synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), geometry.point_count(g).alias("points"), geometry.is_empty(g).alias("empty"))


@_query("SELECT p_partkey AS id, 'Polygon' AS kind, 1 AS rings FROM part")
def geometry_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("geom")
    return synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), geometry.kind_name(g).alias("kind"), geometry.member_count(g).alias("rings"))


@_query(f"WITH {_LINE_BOUNDS} SELECT id, CAST(2 AS INTEGER) AS members, CAST(n + 1 AS INTEGER) AS points, 'LineString' AS first_kind, 'Point' AS last_kind, CAST(n AS INTEGER) AS points_after_pop FROM lb")
def geometry_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = geometry.collection(F.array(F.col("geom"), geometry.point(coords.point_units(F.lit(1), F.lit(2)))))
    g = F.col("g")
    return synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), made.alias("g")).select(
        "id",
        geometry.member_count(g).alias("members"),
        geometry.point_count(g).alias("points"),
        geometry.kind_name(geometry.first(g)).alias("first_kind"),
        geometry.kind_name(geometry.last(g)).alias("last_kind"),
        geometry.point_count(geometry.pop(g)).alias("points_after_pop"),
    )


@_query(f"WITH {_LINE}, t AS (SELECT id, string_agg(lng || ' ' || lat, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c FROM li GROUP BY id) SELECT o_orderkey AS id, CASE WHEN c IS NULL THEN 'LINESTRING EMPTY' ELSE 'LINESTRING (' || c || ')' END AS wkt FROM orders LEFT JOIN t ON o_orderkey = t.id")
def wkt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), wkt.line_text_units(F.col("geom")).alias("wkt"))


@_query(f"WITH {_LINE_BOUNDS}, {_PART} SELECT lb.id AS left_id, count(pa.id) AS n FROM lb LEFT JOIN pa ON lb.max_lng >= pa.min_lng AND lb.max_lat >= pa.min_lat AND lb.min_lng <= pa.max_lng AND lb.min_lat <= pa.max_lat GROUP BY lb.id")
def bbox_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's line against all rectangles: how many it meets, as the pairs are too many to return (an extension)."""
    return select.intersecting_counts(synth.line_order(spark, sf_dir), synth.rect_part(spark, sf_dir))


# Applications, conversion and inspection


@_query(f"{_RANKED} SELECT id, pos + 2 AS number FROM ranked")
def app_number_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layout.with_hilbert(synth.pt_customer(spark, sf_dir))
    return select.numbered(f).select(F.col("feature_id").alias("id"), "number")


@_query("SELECT c_custkey AS id, CAST(CASE WHEN c_acctbal > 750 THEN 750 WHEN c_acctbal > 500 THEN 500 WHEN c_acctbal > 250 THEN 250 WHEN c_acctbal > 100 THEN 100 WHEN c_acctbal > 50 THEN 50 WHEN c_acctbal > 25 THEN 25 WHEN c_acctbal > 10 THEN 10 ELSE 0 END AS INTEGER) AS bucket FROM customer")
def app_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.pt_customer(spark, sf_dir)
    return f.select(F.col("feature_id").alias("id"), select.bucket(properties.get(F.col("properties"), "c_acctbal", "string")).alias("bucket"))


@_query(f"WITH {_CUSTOMER} SELECT id, CAST(trunc(lng / 1e7::DOUBLE * 1e7::DOUBLE) AS INTEGER) AS lng, CAST(trunc(lat / 1e7::DOUBLE * 1e7::DOUBLE) AS INTEGER) AS lat, c_name AS name FROM pt JOIN customer ON id = c_custkey")
def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer written as a GeoJSON feature and read back (degrees are cut, not rounded); the id travels as a property."""
    f = synth.pt_customer(spark, sf_dir)
    f = f.withColumn("properties", properties.insert(F.col("properties"), properties.entry("id", F.col("feature_id"), "int64")))
    back = geojson.parse(f.select(geojson.feature_text(F.col("geom"), F.col("properties")).alias("value")))
    p = F.col("properties")
    return back.select(properties.get(p, "id", "bigint").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"), properties.get(p, "c_name", "string").alias("name"))


@_query("SELECT count(*) AS feature_count, true AS is_compressed, CAST(17 AS BIGINT) AS header_bytes FROM customer")
def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the customers as a dataset into the shared folder and describes it."""
    stored = dataset.write_clustered(synth.pt_customer(spark, sf_dir), shared.path(spark, "customers"), partitions=4)
    return stored.describe().select("feature_count", "is_compressed", "header_bytes")


@_query(f"WITH {_EVENT} SELECT count(*) AS n FROM ev WHERE lng BETWEEN -100000000 AND 600000000 AND lat BETWEEN -100000000 AND 450000000")
def stored_select_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box query over a stored, clustered dataset."""
    stored = dataset.write_clustered(synth.pt_event(spark, sf_dir), shared.path(spark, "events"), partitions=8)
    return stored.select_bbox(_BOX).agg(F.count(F.lit(1)).alias("n"))


from . import formats  # noqa: E402, F401  # adds its queries to QUERIES
