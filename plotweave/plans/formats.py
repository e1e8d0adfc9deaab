"""Queries over formats, stored datasets, text forms, equality and inspection, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bounds, coords, geometry, properties, wkt
from ..operators import layout, rtree, shared
from ..sources import codec, dataset, geojson, table
from . import synth
from .queries import _BOX, _CUSTOMER, _EVENT, _FOUR, _IN_BOX, _LEVELS, _LINE, _PART, _RANKED, _query, _ranked

_P = "properties"
#: Whole degrees, which every engine prints alike.
_DEGREES = "deg AS (SELECT c_custkey AS id, c_custkey % 360 - 180 AS x, (c_custkey * 7) % 180 - 90 AS y FROM customer)"
_HITS = "lng BETWEEN -100000000 AND 600000000 AND lat BETWEEN -100000000 AND 450000000"
#: Customers as bare points take 28 bytes each, so a page of the default size closes behind 2341.
_PER_PAGE = 2341


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = synth.read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 360 - 180).alias("x"), (F.col("c_custkey") * 7 % 180 - 90).alias("y"))


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.pt_customer(spark, sf_dir).withColumn("properties", properties.empty())


def _with_id(f: DataFrame) -> DataFrame:
    return f.withColumn("properties", properties.insert(F.col(_P), properties.entry("id", F.col("feature_id"), "int64")))


def _id() -> Column:
    return properties.get(F.col(_P), "id", "bigint").alias("id")


def _position(extra: str = "") -> Column:
    return F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit(f"{extra}]"))


def _feature(where: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), where, F.lit(',"properties":{"id":'), F.col("id").cast("string"), F.lit("}}"))


# GeoJSON


@_query(f"WITH {_DEGREES} SELECT id, CAST(x * 10000000 AS INTEGER) AS lng, CAST(y * 10000000 AS INTEGER) AS lat FROM deg WHERE id % 7 <> 0")
def geojson_with_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights are left out; empty points can't be read and have no row."""
    place = F.when(F.col("id") % 7 == 0, F.lit("[]")).otherwise(_position(",5.5"))
    texts = _degrees(spark, sf_dir).select(_feature(F.concat(F.lit('{"type":"Point","coordinates":'), place, F.lit("}"))).alias("value"))
    return geojson.parse(texts, mode="drop").select(_id(), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


@_query(f"WITH {_DEGREES} SELECT 'drop' AS mode, count(*) FILTER (WHERE id % 7 > 1) AS features, CAST(0 AS BIGINT) AS bare FROM deg UNION ALL SELECT 'null', count(*), count(*) FILTER (WHERE id % 7 <= 1) FROM deg")
def geojson_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no JSON, and geometries of an unknown type, by mode."""
    point = F.concat(F.lit('{"type":"Point","coordinates":'), _position(), F.lit("}"))
    text = F.when(F.col("id") % 7 == 0, F.lit("{no json")).when(F.col("id") % 7 == 1, _feature(F.lit('{"type":"Circle"}'))).otherwise(_feature(point))
    texts = _degrees(spark, sf_dir).select(text.alias("value"))
    by = [geojson.parse(texts, mode=m).agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("features"), F.count_if(F.isnull("geom")).alias("bare")) for m in ("drop", "null")]
    return by[0].union(by[1])


@_query("SELECT c_custkey AS id, 'Point' AS kind, CAST(0 AS INTEGER) AS lng, CAST(0 AS INTEGER) AS lat FROM customer")
def geojson_null_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _degrees(spark, sf_dir).select(_feature(F.lit("null")).alias("value"))
    return geojson.parse(texts, null_geometry="origin").select(_id(), geometry.kind_name(F.col("geom")).alias("kind"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


@_query(f"WITH {_DEGREES} SELECT CAST(x * 10000000 AS INTEGER) AS lng, CAST(y * 10000000 AS INTEGER) AS lat, CAST(sum(CASE WHEN id % 3 = 2 THEN 2 ELSE 1 END) AS BIGINT) AS features FROM deg GROUP BY x, y")
def geojson_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare geometry, a feature, and a collection of two are all features."""
    point = F.concat(F.lit('{"type":"Point","coordinates":'), _position(), F.lit("}"))
    two = F.concat(F.lit('{"type":"FeatureCollection","features":['), _feature(point), F.lit(","), _feature(point), F.lit("]}"))
    texts = _degrees(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, point).when(F.col("id") % 3 == 1, _feature(point)).otherwise(two).alias("value"))
    return geojson.parse(texts).groupBy(F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat")).agg(F.count(F.lit(1)).alias("features"))


@_query("SELECT c_custkey AS id, CAST(strlen(c_name) AS INTEGER) AS n, CAST(ascii(c_name) AS INTEGER) AS first_byte, CAST(ascii(right(c_name, 1)) AS INTEGER) AS last_byte FROM customer")
def geojson_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of bytes becomes an array of numbers."""
    c = synth.read(spark, sf_dir, "customer")
    props = properties.of(properties.entry("b", F.col("c_name").cast("binary"), "bytes"))
    text = geojson.feature_text(geometry.point(coords.point_units(F.lit(1), F.lit(2))), props)
    b = F.from_json(F.get_json_object("t", "$.properties.b"), "array<int>")
    return c.select(F.col("c_custkey").alias("id"), text.alias("t")).select("id", F.size(b).alias("n"), F.element_at(b, 1).alias("first_byte"), F.element_at(b, -1).alias("last_byte"))


@_query("SELECT c_custkey AS id, 'Polygon' AS kind, '[]' AS coordinates FROM customer")
def geojson_empty_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = geometry.polygon(F.expr("cast(array() as array<array<struct<lng:int,lat:int>>>)"))
    c = synth.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geojson.feature_text(none, properties.empty()).alias("t"))
    return c.select("id", F.get_json_object("t", "$.geometry.type").alias("kind"), F.get_json_object("t", "$.geometry.coordinates").alias("coordinates"))


@_query("SELECT n_name AS name, CAST(12 AS INTEGER) AS tag, '2024-02-29T12:00:00Z' AS at FROM nation")
def geojson_times_are_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = synth.read(spark, sf_dir, "nation")
    text = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"name":"'), F.col("n_name"), F.lit('","at":"2024-02-29T12:00:00Z"}}'))
    f = geojson.parse(n.select(text.alias("value")))
    return f.select(properties.get(F.col(_P), "name", "string").alias("name"), properties.tag(F.col(_P), "at").cast("int").alias("tag"), properties.get(F.col(_P), "at", "string").alias("at"))


@_query("SELECT 'FeatureCollection' AS kind, count(*) AS features, CAST(min(n_nationkey) AS BIGINT) AS least, CAST(max(n_nationkey) AS BIGINT) AS most FROM nation")
def geojson_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations drained row by row into one feature collection (a text of 25 features)."""
    f = synth.mpt_nation(spark, sf_dir).withColumn("properties", properties.of(properties.entry("id", F.col("feature_id"), "int64")))
    text = "".join(geojson.collection(f))
    ids = F.from_json(F.get_json_object("t", "$.features[*].properties.id"), "array<bigint>")
    kind = json.loads(text)["type"]
    return spark.createDataFrame([(kind, text)], "kind string, t string").select("kind", F.size(ids).cast("long").alias("features"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"))


@_query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN 'Point' ELSE 'GeometryCollection' END AS kind, CAST(CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 2 END AS INTEGER) AS members, CAST(CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 3 END AS INTEGER) AS points FROM part")
def geometries_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare geometries of one group are one feature: a collection, unless there is just one."""
    p = synth.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("k"))
    one = p.select("id", F.lit('{"type":"Point","coordinates":[1,2]}').alias("value"))
    two = p.where("k % 2 = 0").select("id", F.lit('{"type":"LineString","coordinates":[[1,2],[3,4]]}').alias("value"))
    g = F.col("geom")
    return geojson.parse_geometries(one.union(two), "id").select(F.col("id").cast("long").alias("id"), geometry.kind_name(g).alias("kind"), geometry.member_count(g).alias("members"), geometry.point_count(g).alias("points"))


# Delimited text and the packed format


@_query(f"WITH {_CUSTOMER} SELECT id, CAST(trunc(lng / 1e7::DOUBLE * 1e7::DOUBLE) AS INTEGER) AS lng, CAST(trunc(lat / 1e7::DOUBLE * 1e7::DOUBLE) AS INTEGER) AS lat, c_name AS name FROM pt JOIN customer ON id = c_custkey")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.path(spark, "csv")
    table.write(_with_id(synth.pt_customer(spark, sf_dir)), at, ["id", "c_name"])
    back = table.read(spark, at)
    return back.select(properties.get(F.col(_P), "id", "string").cast("long").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"), properties.get(F.col(_P), "c_name", "string").alias("name"))


@_query(f"WITH {_DEGREES} SELECT id, CAST(x * 10000000 AS INTEGER) AS lng, CAST(y * 10000000 AS INTEGER) AS lat FROM deg")
def csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of degrees make a point."""
    at = shared.path(spark, "csv")
    _degrees(spark, sf_dir).write.option("header", True).csv(at)
    return table.read(spark, at, lng_col="x", lat_col="y").select(properties.get(F.col(_P), "id", "string").cast("long").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


def _packed(spark: SparkSession, f: DataFrame, compressed: bool = False) -> str:
    at = shared.path(spark, "packed")
    codec.write(f, at, compressed)
    return at


@_query(f"WITH {_CUSTOMER} SELECT id, lng, lat, c_name AS name FROM pt JOIN customer ON id = c_custkey")
def packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer through a compressed packed file."""
    back = codec.read(spark, _packed(spark, _with_id(synth.pt_customer(spark, sf_dir)), True))
    return back.select(_id(), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"), properties.get(F.col(_P), "c_name", "string").alias("name"))


@_query(f"WITH {_CUSTOMER} SELECT id, lng, lat FROM pt WHERE {_HITS}")
def packed_select_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's own index is searched, and only pages with hits are decoded."""
    back = codec.read(spark, _packed(spark, _with_id(synth.pt_customer(spark, sf_dir)), True), _BOX)
    return back.select(_id(), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"))


_SIZES = f"sizes AS (SELECT CAST(max(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS nodes, CAST((max(n) + {_PER_PAGE - 1}) // {_PER_PAGE} AS BIGINT) AS pages FROM levels)"


@_query(f"WITH RECURSIVE {_LEVELS}, {_SIZES} SELECT false AS is_compressed, pages AS page_count, n AS feature_count, CAST(17 AS BIGINT) AS header_bytes, 28 * nodes AS index_bytes, 17 + 28 * nodes + 12 * pages + 28 * n AS file_bytes FROM sizes")
def packed_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.header(spark, _packed(spark, _bare(spark, sf_dir)))


@_query(f"""WITH RECURSIVE {_LEVELS}, {_SIZES}, st AS (SELECT level, n, CAST(sum(n) OVER (ORDER BY level DESC) - n AS BIGINT) AS f FROM levels)
SELECT 'header' AS section, -1 AS level, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS start, CAST(17 AS BIGINT) AS bytes FROM sizes
UNION ALL SELECT 'node', level, f + i, 17 + 28 * (f + i), 28 FROM (SELECT level, f, unnest(range(CAST(n AS BIGINT))) AS i FROM st)
UNION ALL SELECT 'page', -1, i, 17 + 28 * nodes + i * (12 + 28 * {_PER_PAGE}), 12 + 28 * least({_PER_PAGE}, n - i * {_PER_PAGE}) FROM (SELECT *, unnest(range(pages)) AS i FROM sizes)
UNION ALL SELECT 'feature', CAST(i // {_PER_PAGE} AS INTEGER), i, (i % {_PER_PAGE}) * 28, 28 FROM (SELECT unnest(range(n)) AS i FROM sizes)""")
def packed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands where in a packed file: header, nodes, pages and features."""
    s = codec.inspect(spark, _packed(spark, _bare(spark, sf_dir)))
    return s.select("section", F.coalesce("level", F.lit(-1)).alias("level"), "number", "start", "bytes")


@_query(f"{_RANKED}, hit AS (SELECT pos // {_PER_PAGE} AS page FROM ranked WHERE {_HITS}), n AS (SELECT count(*) AS n FROM ranked) SELECT CAST(count(DISTINCT page) AS BIGINT) AS pages, (SELECT CAST(sum(12 + 28 * least({_PER_PAGE}, n - page * {_PER_PAGE})) AS BIGINT) FROM (SELECT DISTINCT page FROM hit), n) AS page_bytes, count(*) AS features FROM hit")
def packed_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a box query touches of a packed file."""
    return codec.transfer(spark, _packed(spark, _bare(spark, sf_dir)), _BOX).select("pages", "page_bytes", "features")


# Stored datasets


@_query(f"WITH {_EVENT} SELECT id, lng, lat, event_type, props FROM ev JOIN events ON id = event_id WHERE {_HITS}")
def stored_select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box query over a stored, clustered dataset, with all columns of the rows."""
    d = dataset.write_clustered(synth.pt_event(spark, sf_dir), shared.path(spark, "events"))
    return d.select_bbox(_BOX).select(F.col("feature_id").alias("id"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"), "event_type", "props")


@_query(f"WITH {_PART} SELECT id, {_FOUR} FROM pa WHERE {_IN_BOX}")
def stored_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of the tree that is stored with the dataset."""
    d = dataset.write_clustered(synth.rect_part(spark, sf_dir), shared.path(spark, "parts"))
    return d.search(_BOX).select(F.col("feature_id").alias("id"), *bounds.of())


@_query(f"WITH {_CUSTOMER} SELECT true AS is_compressed, count(*) AS feature_count, CAST((count(*) + {_PER_PAGE - 1}) // {_PER_PAGE} AS BIGINT) AS page_count, CAST(65536 AS BIGINT) AS page_bytes, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM pt")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.pt_customer(spark, sf_dir).drop("properties")
    return dataset.write_clustered(f, shared.path(spark, "customers")).header


@_query(f"{_RANKED}, p AS (SELECT pos // {_PER_PAGE} AS page_id, lng, lat FROM ranked) SELECT page_id, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat, count(*) AS feature_count, CAST(28 * count(*) AS BIGINT) AS bytes FROM p GROUP BY page_id")
def dataset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.pt_customer(spark, sf_dir).drop("properties")
    return dataset.write_clustered(f, shared.path(spark, "customers")).pages()


@_query(f"WITH RECURSIVE {_LEVELS}, {_SIZES} SELECT n AS feature_count, pages AS page_count, false AS is_compressed, CAST(17 AS BIGINT) AS header_bytes, 28 * nodes AS index_bytes, true AS has_bytes FROM sizes")
def dataset_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = synth.pt_customer(spark, sf_dir).drop("properties")
    d = dataset.write_clustered(f, shared.path(spark, "customers"), compressed=False).describe()
    return d.select("feature_count", "page_count", "is_compressed", "header_bytes", "index_bytes", (F.col("feature_bytes") > 0).alias("has_bytes"))


@_query(f"{_RANKED} SELECT id, pos // (4096 // 28 + 1) AS page_id FROM ranked")
def page_size_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller pages, by the fold over sizes that ends where the closed form does."""
    sized = _ranked(spark, sf_dir).withColumn("size", F.lit(28))
    return layout.pages(sized, "size", 4096, exact=True).select(F.col("feature_id").alias("id"), "page_id")


# The packed tree


@_query(f"""{_RANKED}, node AS (SELECT pos // 16 AS pos, min(lng) AS a, min(lat) AS b, max(lng) AS c, max(lat) AS d FROM ranked GROUP BY pos // 16
), hit AS (SELECT pos FROM node WHERE c >= -100000000 AND d >= -100000000 AND a <= 600000000 AND b <= 450000000
), island AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM hit) SELECT CAST(min(pos) * 16 AS BIGINT) AS first_place, CAST((max(pos) + 1) * 16 AS BIGINT) AS end_place FROM island GROUP BY g""")
def rtree_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under neighbouring hits of the lowest inner level, as ranges."""
    tree = shared.stored(rtree.nodes(_ranked(spark, sf_dir), least=1))
    found = rtree.merged_ranges(rtree.descend(tree, _BOX, 1), rtree.FANOUT, most=1 << 20)
    return spark.createDataFrame(found, "first_place long, end_place long")


@_query(f"WITH RECURSIVE {_LEVELS}, {_SIZES} SELECT n, nodes, 28 * nodes AS index_bytes FROM sizes")
def rtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = synth.read(spark, sf_dir, "customer").count()
    return spark.createDataFrame([(n, rtree.node_count(n), rtree.index_bytes(n))], "n long, nodes long, index_bytes long")


@_query(f"WITH RECURSIVE {_LEVELS}, st AS (SELECT level, n, CAST(sum(n) OVER (ORDER BY level DESC) - n AS BIGINT) AS f FROM levels) SELECT f + i AS node, level, level = 0 AS leaf FROM (SELECT level, f, unnest(range(CAST(n AS BIGINT))) AS i FROM st)")
def rtree_node_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = synth.read(spark, sf_dir, "customer").count()
    level = rtree.level_column(n, F.col("id"))
    return spark.range(rtree.node_count(n)).select(F.col("id").alias("node"), level.alias("level"), (level == 0).alias("leaf"))


# Text forms, equality and construction


@_query(f"WITH {_DEGREES} SELECT id, 'POINT(' || x || ' ' || y || ')' AS point, 'MULTILINESTRING ((' || x || ' ' || y || ',0 0),EMPTY)' AS lines FROM deg")
def wkt_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = coords.point(F.col("x"), F.col("y"))
    none = F.expr("cast(array() as array<struct<lng:int,lat:int>>)")
    lines = geometry.multi_line_string(F.array(F.array(p, coords.point_units(F.lit(0), F.lit(0))), none))
    return _degrees(spark, sf_dir).select("id", wkt.text(geometry.point(p)).alias("point"), wkt.text(lines).alias("lines"))


@_query(f"WITH {_DEGREES} SELECT id, 'LineString' AS kind, CAST(least(x * 10000000, 10000000) AS INTEGER) AS min_lng, CAST(least(y * 10000000, 20000000) AS INTEGER) AS min_lat, CAST(greatest(x * 10000000, 10000000) AS INTEGER) AS max_lng, CAST(greatest(y * 10000000, 20000000) AS INTEGER) AS max_lat FROM deg")
def wkt_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("LINESTRING ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(", 1 2)"))
    d = _degrees(spark, sf_dir).select("id", table.parsed_text(text).alias("geom"))
    return d.select("id", geometry.kind_name(F.col("geom")).alias("kind"), *geometry.bounds(F.col("geom")))


@_query(f"WITH {_DEGREES} SELECT id, 'RECT(' || least(x, 5) || ' ' || least(y, 6) || ',' || greatest(x, 5) || ' ' || greatest(y, 6) || ')' AS text FROM deg")
def bounds_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lambda c: coords.to_units(c)
    d = _degrees(spark, sf_dir).select("id", *bounds.from_corners(u(F.col("x")), u(F.col("y")), u(F.lit(5)), u(F.lit(6))))
    return d.select("id", bounds.text().alias("text"))


@_query(f"WITH {_CUSTOMER} SELECT id, abs(CAST(lng AS BIGINT) - lat) <= 300000000 AND abs(CAST(lat AS BIGINT) - lng) <= 300000000 AS near FROM pt")
def points_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.points(F.col("geom"))[0]
    return synth.pt_customer(spark, sf_dir).select(F.col("feature_id").alias("id"), geometry.near(p, coords.point_units(p["lat"], p["lng"]), 30).alias("near"))


@_query(f"WITH {_LINE}, v AS (SELECT id, list(lng || ' ' || lat ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM li GROUP BY id) SELECT o_orderkey AS id, coalesce(list_reverse(p) = p, true) AS same FROM orders LEFT JOIN v ON o_orderkey = v.id")
def geometry_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that equal themselves read backwards."""
    g = F.col("geom")
    return synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), geometry.same(g, geometry.line_string(F.reverse(geometry.points(g)))).alias("same"))


@_query("SELECT event_id, true AS same, false AS turned, CAST(json_extract(props, '$.k') AS BIGINT) IS NOT DISTINCT FROM 3 AS three FROM events")
def properties_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and values count; numbers are compared as JSON texts with their types."""
    e = synth.read(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    a, b = properties.entry("t", F.col("event_type"), "string"), properties.entry("k", k, "int64")
    three = properties.of(a, properties.entry("k", F.lit(3), "int64"))
    return e.select("event_id", properties.same(properties.of(a, b), properties.of(a, b)).alias("same"), properties.same(properties.of(a, b), properties.of(b, a)).alias("turned"), properties.same(properties.of(a, b), three).alias("three"))


@_query("SELECT event_id, CAST([12, 7][i] AS INTEGER) AS tag, [to_json(event_type)::VARCHAR, CAST(event_id AS VARCHAR)][i] AS json FROM (SELECT *, unnest([1, 2]) AS i FROM events)")
def property_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = synth.read(spark, sf_dir, "events")
    made = properties.of(properties.entry("t", F.col("event_type"), "string"), properties.entry("id", F.col("event_id"), "int64"))
    e = e.select("event_id", F.explode(properties.to_json_entries(made)).alias("p"))
    return e.select("event_id", F.col("p.tag").cast("int").alias("tag"), "p.json")


@_query(f"WITH {_CUSTOMER} SELECT id, lng, CAST(-7654321 AS INTEGER) AS lat FROM pt")
def coord_with_lat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.points(F.col("geom"))[0]
    f = synth.pt_customer(spark, sf_dir).select(F.col("feature_id").alias("id"), coords.with_lat(p, F.lit(-7654321)).alias("p"))
    return f.select("id", "p.lng", "p.lat")


@_query(f"WITH n AS (SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) SELECT id, CAST(n + 1 AS INTEGER) AS points, CAST(9 AS INTEGER) AS last_lng, CAST(n + 1 AS INTEGER) AS members FROM n")
def line_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = geometry.push_point(F.col("geom"), coords.point_units(F.lit(9), F.lit(8)))
    f = synth.line_order(spark, sf_dir).select(F.col("feature_id").alias("id"), more.alias("g"))
    return f.select("id", geometry.point_count(F.col("g")).alias("points"), F.element_at(geometry.points(F.col("g")), -1)["lng"].alias("last_lng"), geometry.member_count(F.col("g")).alias("members"))


@_query(f"WITH {_PART} SELECT id, CAST(2 AS INTEGER) AS rings, CAST(8 AS INTEGER) AS points, min_lng, least(min_lat, 0) AS least_lat FROM pa")
def polygon_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring pushed to a polygon counts in its bounds like any other."""
    x = geometry.points(F.col("geom"))[0]["lng"]
    ring = geometry.line_string(F.array(*(coords.point_units(x, F.lit(k)) for k in range(3))))
    f = synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), geometry.push(F.col("geom"), ring).alias("g"))
    b = geometry.bounds(F.col("g"))
    return f.select("id", geometry.member_count(F.col("g")).alias("rings"), geometry.point_count(F.col("g")).alias("points"), b[0], b[1].alias("least_lat"))


@_query(f"WITH {_PART} SELECT id, 'MultiLineString' AS kind, CAST(2 AS INTEGER) AS lines, CAST(5 AS INTEGER) AS first_points, CAST(1 AS INTEGER) AS last_points, min_lng AS first_lng FROM pa")
def multi_line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = geometry.points(F.col("geom"))
    f = synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), geometry.multi_line_string(F.array(pts, F.slice(pts, 1, 1))).alias("g"))
    g, first = F.col("g"), geometry.first(F.col("g"))
    return f.select("id", geometry.kind_name(g).alias("kind"), geometry.member_count(g).alias("lines"), geometry.point_count(first).alias("first_points"), geometry.point_count(geometry.last(g)).alias("last_points"), geometry.points(first)[0]["lng"].alias("first_lng"))


@_query(f"WITH {_PART} SELECT id, 'MultiPolygon' AS kind, CAST(3 AS INTEGER) AS polygons, CAST(15 AS INTEGER) AS points, {_FOUR} FROM pa")
def multi_polygon_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(geometry.points(F.col("geom")))
    f = synth.rect_part(spark, sf_dir).select(F.col("feature_id").alias("id"), F.col("geom").alias("one"), geometry.multi_polygon(F.array(one, one)).alias("two"))
    f = f.select("id", geometry.push(F.col("two"), F.col("one")).alias("g"))
    return f.select("id", geometry.kind_name(F.col("g")).alias("kind"), geometry.member_count(F.col("g")).alias("polygons"), geometry.point_count(F.col("g")).alias("points"), *geometry.bounds(F.col("g")))


@_query(f"WITH {_CUSTOMER} SELECT id, lng, lat, 'Point' AS kind, CAST(4 AS INTEGER) AS properties FROM pt")
def feature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry and properties of a feature, each by itself."""
    p = geometry.points(F.col("geom"))[0]
    return synth.pt_customer(spark, sf_dir).select(F.col("feature_id").alias("id"), p["lng"].alias("lng"), p["lat"].alias("lat"), geometry.kind_name(F.col("geom")).alias("kind"), F.size("properties").alias("properties"))
