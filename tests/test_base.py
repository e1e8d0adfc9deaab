"""Goldens of the data model: coordinates, bounds, curve, tree, text forms, datasets."""

import json

import pytest
from pyspark.sql import functions as F

from plotweave.functions import bounds, coords, geometry, hilbert, properties, wkt
from plotweave.operators import layout, rtree, select
from plotweave.sources import dataset, geojson


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def points(spark, n):
    f = spark.range(n).select(F.col("id").alias("feature_id"), geometry.point(coords.point(F.col("id"), F.col("id"))).alias("geom"), properties.of(properties.entry("name", F.concat(F.lit("prop-"), F.col("id").cast("string")), "string")).alias("properties"))
    return f.select("*", *geometry.bounds(F.col("geom")))


def test_degrees_are_cut_and_saturate(spark):
    values = [-118.2562, 34.1060, 1e-8, -1.99e-7, 1e9, -1e9, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(coords.to_units(F.col("d"))).collect()]
    assert got == [-1182562000, 341060000, 0, -1, 2147483647, -2147483648, 0, None]
    assert coords.unit_of(34.1060) == 341060000 and coords.unit_of(float("nan")) == 0


@pytest.mark.parametrize("box,center", [((0, 0, 3, 3), (1.5, 1.5)), ((3, 3, 2, 2), (2.5, 2.5)), ((1, 2, -3, -6), (-1, -2))])
def test_centers(spark, box, center):
    b = bounds.Box.degrees(*box)
    df = spark.createDataFrame([(b.min_lng, b.min_lat, b.max_lng, b.max_lat)], "min_lng int, min_lat int, max_lng int, max_lat int")
    assert tuple(df.select(*bounds.center()).first()) == tuple(int(v * 1e7) for v in center)


def test_bounds_of_all_kinds(spark):
    text = "GEOMETRYCOLLECTION(POINT(10 20),LINESTRING(1 2,3 4),POLYGON((0 0,5 5,5 0,0 0)),MULTIPOINT(7 8,-20 9),MULTILINESTRING((1 1,2 2),EMPTY),MULTIPOLYGON(((0 0,1 1,1 0,0 0))),GEOMETRYCOLLECTION(POINT(0 -30)))"
    row = one(spark, *geometry.bounds(wkt.literal(text)))
    assert tuple(v / 1e7 for v in row) == (-20, -30, 10, 20)
    df = spark.createDataFrame([tuple(row)], "min_lng int, min_lat int, max_lng int, max_lat int")
    assert df.select(bounds.text()).first()[0] == "RECT(-20 -30,10 20)"


def test_empty_bounds_are_null_and_count_for_nothing(spark):
    row = one(spark, *geometry.bounds(wkt.literal("LINESTRING EMPTY")))
    assert tuple(row) == (None,) * 4
    df = spark.createDataFrame([(None,) * 4, (1, 2, 3, 4)], "min_lng int, min_lat int, max_lng int, max_lat int")
    assert tuple(df.agg(*bounds.total()).first()) == (1, 2, 3, 4)
    assert df.where(bounds.intersects(bounds.Box(-(2**31), -(2**31), 2**31 - 1, 2**31 - 1))).count() == 1


def test_curve_goldens(spark):
    rows = [(1, 0, 0, 10_000_000, 10_000_000), (2, 20_000_000, 20_000_000, 30_000_000, 30_000_000)]
    f = spark.createDataFrame(rows, "feature_id long, min_lng int, min_lat int, max_lng int, max_lat int")
    assert {r[0]: r[1] for r in layout.with_hilbert(f).select("feature_id", "hilbert").collect()} == {1: 143165576, 2: 2720145952}


def test_curve_visits_every_cell_once_and_steps_by_one(spark):
    f = spark.range(64).select((F.col("id") % 8).alias("x"), F.expr("id div 8").alias("y"))
    d = {r["d"]: (r["x"], r["y"]) for r in f.select("x", "y", hilbert.distance(F.col("x"), F.col("y")).alias("d")).collect()}
    assert sorted(d) == list(range(64))
    assert all(abs(d[k][0] - d[k + 1][0]) + abs(d[k][1] - d[k + 1][1]) == 1 for k in range(63))


def test_stored_order_and_box_goldens(spark):
    f = layout.with_hilbert(points(spark, 4))
    assert [r.feature_id for r in select.select_all(f, True).collect()] == [3, 2, 1, 0]
    assert [r.feature_id for r in select.select_bbox(f, bounds.Box.degrees(1, 1, 2, 2), True).collect()] == [2, 1]
    assert [r.feature_id for r in select.select_bbox(f, bounds.Box.degrees(1, 1, 3, 3), True).collect()] == [3, 2, 1]
    assert [(r.feature_id, r.pos) for r in layout.ranked(f, 2).orderBy("pos").collect()] == [(3, 0), (2, 1), (1, 2), (0, 3)]


def test_degenerate_extents(spark):
    f = points(spark, 1).withColumn("feature_id", F.lit(5))
    assert layout.with_hilbert(f).first()["hilbert"] == 0
    assert layout.extent(points(spark, 0)) is None
    assert layout.with_hilbert(points(spark, 0)).count() == 0


@pytest.mark.parametrize("n,levels", [(0, []), (1, [1]), (2, [1, 2]), (4, [1, 4]), (15, [1, 15]), (16, [1, 16]), (17, [1, 2, 17]), (32, [1, 2, 32]), (33, [1, 3, 33]), (255, [1, 16, 255]), (256, [1, 16, 256]), (257, [1, 2, 17, 257])])
def test_levels(n, levels):
    assert rtree.nodes_per_level(n) == levels
    assert rtree.index_bytes(n) == 28 * sum(levels)
    assert [b - a for a, b in rtree.node_ranges(n)] == levels


def test_children_and_levels_of_nodes():
    assert rtree.children(17, 0) == (1, 3)
    assert rtree.children(17, 1) == (3, 19)
    assert rtree.children(17, 2) == (19, 20)
    assert rtree.children(17, 3) is None and rtree.children(17, 99) is None
    assert [rtree.level_of(17, k) for k in (0, 1, 2, 3, 19)] == [2, 1, 1, 0, 0]
    assert rtree.is_leaf(17, 3) and not rtree.is_leaf(17, 2)


def test_tree_of_seventeen_boxes(spark):
    f = spark.range(17).select(F.col("id").alias("pos"), *((F.col("id") * k).cast("int").alias(n) for n, k in zip(bounds.NAMES, (1, 1, 2, 2))))
    nodes = {(r.level, r.pos): tuple(r[n] for n in bounds.NAMES) for r in rtree.nodes(f).collect()}
    assert nodes[(2, 0)] == (0, 0, 32, 32) and nodes[(1, 0)] == (0, 0, 30, 30) and nodes[(1, 1)] == (16, 16, 32, 32)
    box = bounds.Box(5, 5, 6, 6)
    assert {r.pos for r in rtree.search(f, box).collect()} == {r.pos for r in f.where(bounds.intersects(box)).collect()}
    with pytest.raises(rtree.FeatureCountMismatch):
        rtree.levels(f, 18)


def test_pages_close_once_over_the_goal(spark):
    f = spark.createDataFrame([(k, s) for k, s in enumerate([60, 60, 10, 95, 10, 200, 1])], "pos long, size long")
    got = {r.pos: r.page_id for r in layout.pages(f, "size", 100, exact=True).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}


@pytest.mark.parametrize("text", ["POINT(1 2)", "LINESTRING (1 2,3 4.5)", "LINESTRING EMPTY", "POLYGON ((0 0,1 1,1 0,0 0),(0.1 0.1,0.2 0.2,0.2 0.1,0.1 0.1))", "MULTIPOINT (1 2,-3 4)", "MULTILINESTRING ((1 2,3 4),EMPTY)", "MULTIPOLYGON (((0 0,1 1)))", "GEOMETRYCOLLECTION (POINT(1 2),GEOMETRYCOLLECTION (LINESTRING (0 0,1 1)),MULTIPOLYGON EMPTY)", "GEOMETRYCOLLECTION EMPTY"])
def test_text_round_trip(spark, text):
    assert wkt.render(wkt.parse(text)) == text
    assert one(spark, wkt.text(wkt.literal(text)))[0] == text


def test_text_errors():
    for bad in ("POINT EMPTY", "LINESTRING ()", "POINT(1)", "CIRCLE(1 2)", "POINT(1 2) x"):
        with pytest.raises(ValueError):
            wkt.parse(bad)
    assert wkt.parse("RECT(1 2,3 4)") == bounds.Box(10000000, 20000000, 30000000, 40000000)


def test_members(spark):
    g = wkt.literal("GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,1 1)),((2 2,3 3),(4 4,5 5))),POINT(9 9),GEOMETRYCOLLECTION EMPTY)")
    parts = F.transform(geometry.members(g), geometry.kind_name)
    row = one(spark, parts.alias("m"), geometry.point_count(geometry.first(g)).alias("n"), geometry.kind_name(geometry.last(g)).alias("l"), geometry.member_count(geometry.pop(g)).alias("p"), F.size(geometry.members(geometry.first(g))).alias("polygons"))
    assert (row.m, row.n, row.l, row.p, row.polygons) == (["MultiPolygon", "Point", "GeometryCollection"], 6, "GeometryCollection", 2, 2)
    grown = geometry.push(wkt.literal("POLYGON((0 0,1 1))"), wkt.literal("LINESTRING(2 2,3 3)"))
    assert one(spark, wkt.text(grown))[0] == "POLYGON ((0 0,1 1),(2 2,3 3))"
    only = geometry.unwrapped(F.array(wkt.literal("POINT(1 2)")))
    assert one(spark, wkt.text(only))[0] == "POINT(1 2)"


def test_property_insert_twice_is_an_error(spark):
    p = properties.of(properties.entry("a", F.lit(1), "int32"))
    with pytest.raises(Exception, match="property exists"):
        one(spark, F.size(properties.insert(p, properties.entry("a", F.lit(2), "int32"))))


MIXED = {"type": "FeatureCollection", "x": 1, "features": [
    {"type": "Feature", "id": 3, "geometry": {"type": "Point", "coordinates": [102, 0.5]}, "properties": {"z": "v", "a": True}},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"p": 0.5, "q": 3}},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [1, 0], [0, 0]]]}, "properties": {"p": {"this": "that"}, "n": None}},
    {"type": "Feature", "geometry": None, "properties": {}},
]}


def test_geojson(spark):
    f = geojson.parse(spark.createDataFrame([(json.dumps(MIXED),), (None,), (" ",)], "value string"))
    rows = [json.loads(r[0]) for r in f.select(geojson.feature_text(F.col("geom"), F.col("properties"))).collect()]
    assert [r["geometry"] for r in rows] == [m["geometry"] for m in MIXED["features"]]
    assert rows[0]["properties"] == {"z": "v", "a": True} and list(rows[0]["properties"]) == ["z", "a"]
    assert rows[1]["properties"] == {"p": 0.5, "q": 3}
    assert rows[2]["properties"] == {"p": '{"this":"that"}'}
    assert rows[3]["properties"] is None
    origin = geojson.parse(spark.createDataFrame([(json.dumps(MIXED),)], "value string"), null_geometry="origin")
    assert origin.where("min_lng = 0 and max_lat = 0").count() == 1
    bare = geojson.parse(spark.createDataFrame([('{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}',)], "value string"))
    assert bare.select(wkt.text(F.col("geom"))).first()[0] == "MULTIPOINT (1 2,3 4)"
    assert json.loads("".join(geojson.collection(bare)))["features"][0]["geometry"]["type"] == "MultiPoint"


def test_dataset_round_trip_and_pushdown(spark, tmp_path):
    for compressed in (True, False):
        d = dataset.write_clustered(points(spark, 200), str(tmp_path / str(compressed)), compressed, partitions=3)
        assert d.header.first()["feature_count"] == 200 and d.describe().first()["index_bytes"] == rtree.index_bytes(200)
        assert [r.feature_id for r in d.select_all(True).collect()] == list(range(199, -1, -1))
        got = d.select_bbox(bounds.Box.degrees(10, 10, 12, 12))
        assert {r.feature_id for r in got.collect()} == {10, 11, 12}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan and "GreaterThanOrEqual(max_lng" in plan
    empty = dataset.write_clustered(points(spark, 0), str(tmp_path / "empty"))
    assert empty.select_all().count() == 0 and empty.header.first()["page_count"] == 1
    with pytest.raises(rtree.FeatureCountMismatch):
        dataset.write_clustered(points(spark, 2), str(tmp_path / "bad"), announced=3)


def test_stream_append(spark, tmp_path):
    from plotweave.streaming import append

    points(spark, 10).drop("properties").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    append.append_clustered(stream, str(tmp_path / "out"), str(tmp_path / "check"), bounds.Box.degrees(0, 0, 10, 10)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/features")).count() == 10


def test_intersecting_pairs_equal_brute_force(spark):
    f = spark.range(60).select(F.col("id").alias("feature_id"), *(F.expr(e).cast("int").alias(n) for n, e in zip(bounds.NAMES, ("(id * 37) % 100", "(id * 53) % 100", "(id * 37) % 100 + id % 20", "(id * 53) % 100 + id % 15"))))
    rows = f.collect()
    want = {(a.feature_id, b.feature_id) for a in rows for b in rows if a.max_lng >= b.min_lng and a.max_lat >= b.min_lat and a.min_lng <= b.max_lng and a.min_lat <= b.max_lat}
    got = select.intersecting_pairs(f, f, 16).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_intersecting_counts_cover_every_row(spark):
    f = spark.range(60).select(F.col("id").alias("feature_id"), *(F.expr(f"if(id = 7, null, {e})").cast("int").alias(n) for n, e in zip(bounds.NAMES, ("(id * 37) % 100", "(id * 53) % 100", "(id * 37) % 100 + id % 20", "(id * 53) % 100 + id % 15"))))
    rows = [a for a in f.collect() if a.min_lng is not None]
    want = {a.feature_id: sum(a.max_lng >= b.min_lng and a.max_lat >= b.min_lat and a.min_lng <= b.max_lng and a.min_lat <= b.max_lat for b in rows) for a in rows} | {7: 0}
    for left_block, right_block in ((1000, 1000), (17, 23)):
        got = select.intersecting_counts(f, f, left_block, right_block).collect()
        assert len(got) == 60 and {r.left_id: r.n for r in got} == want
    assert {r.n for r in select.intersecting_counts(f, f.limit(0)).collect()} == {0}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 300])
def test_tree_of_any_depth(spark, n):
    f = spark.range(n).select(F.col("id").alias("pos"), *(F.col("id").cast("int").alias(c) for c in bounds.NAMES))
    got = {(r.level, r.pos): (r.node, r.min_lng, r.max_lat) for r in rtree.nodes(f).collect()}
    sizes = rtree.nodes_per_level(n)
    want = {}
    for k, (a, b) in enumerate(rtree.node_ranges(n)):
        span = 16 ** (len(sizes) - 1 - k)
        want |= {(len(sizes) - 1 - k, i): (a + i, i * span, min(n, (i + 1) * span) - 1) for i in range(b - a)}
    assert got == want
    assert [sorted(r.pos for r in level.collect()) for level in rtree.levels(f)] == [list(range(s)) for s in sizes]
    box = bounds.Box(3, 3, 20, 20)
    assert sorted(r.pos for r in rtree.search(f, box).collect()) == list(range(n))[3:21]


def test_plan_of_the_tree_does_not_grow_with_its_levels(spark):
    f = spark.range(40).select(F.col("id").alias("pos"), *(F.col("id").cast("int").alias(c) for c in bounds.NAMES))
    sizes = [rtree.nodes(f, n)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") for n in (40, 16**5)]
    assert sizes[0] == sizes[1] == 2


def test_intersecting_counts_with_heavy_values(spark):
    """Many boxes on few values, and one value that most share: strips of one value, parts of a strip."""
    kinds = {"left": ("id % 7 - 3", "if(id % 3 = 0, 5, id % 11)", "id % 7 - 3 + id % 4", "if(id % 3 = 0, 5, id % 11) + id % 3"), "right": ("if(id % 4 > 0, 2, id % 9)", "id % 13", "if(id % 4 > 0, 2, id % 9) + id % 2", "id % 13 + id % 5")}
    left, right = (spark.range(n).select(F.col("id").alias("feature_id"), *(F.expr(e).cast("int").alias(c) for c, e in zip(bounds.NAMES, kinds[k]))) for k, n in (("left", 500), ("right", 300)))
    others = right.collect()
    want = {a.feature_id: sum(a.max_lng >= b.min_lng and a.max_lat >= b.min_lat and a.min_lng <= b.max_lng and a.min_lat <= b.max_lat for b in others) for a in left.collect()}
    for left_block, right_block in ((20, 30), (500, 10), (7, 300)):
        assert {r.left_id: r.n for r in select.intersecting_counts(left, right, left_block, right_block).collect()} == want


def test_intersecting_counts_shuffle_grows_with_the_input(spark):
    jvm, sc = spark._jvm, spark.sparkContext
    none = sc._gateway.new_array(jvm.double, 0)

    def moved() -> dict[int, int]:
        """Rows shuffled by each stage that the session still knows."""
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    rows = []
    for n in (2000, 8000):
        f = spark.range(n).select(F.col("id").alias("feature_id"), *(F.expr(f"(id * {m}) % 1000003 + {e}").cast("int").alias(c) for c, m, e in zip(bounds.NAMES, (7919, 104729, 7919, 104729), ("0", "0", "id % 20", "id % 15"))))
        before = moved()
        assert select.intersecting_counts(f, f, 250, 250).count() == n
        rows.append(sum(n for k, n in moved().items() if k not in before))
    assert rows[0] > 2000 and rows[1] < 6 * rows[0]
