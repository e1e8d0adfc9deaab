"""Sizes and round trips of the packed binary format."""

import io
import json

import pytest
from pyspark.sql import functions as F

from plotweave.functions import bounds, geometry, properties, wkt
from plotweave.operators import layout
from plotweave.plans import queries
from plotweave.sources import codec


def packed(rows, goal=64 * 1024, compressed=False):
    out = io.BytesIO()
    codec.encode([(None, codec.encode_feature(wkt.parse(t), e)) for t, e in rows], out, compressed, goal)
    return out.getvalue()


def test_sizes():
    assert len(packed([])) == 29
    bare = [(t, []) for t in ("POINT(1 2)", "POINT(11 12)", "POINT(-1 -2)", "POINT(-11 -12)")]
    assert len(packed(bare, goal=15)) == 317
    named = [(t, [("some_prop", "string", f"value-{k}")]) for k, t in enumerate(("POINT(1 2)", "POINT(11 12)", "POINT(-1 -2)"))]
    assert len(packed(named, goal=100)) == 345
    assert packed(named)[:17] == bytes([0, 1, 0, 0, 0, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0])


@pytest.mark.parametrize("compressed", [False, True])
def test_all_kinds_and_values(compressed):
    text = "GEOMETRYCOLLECTION (POINT(1 2),LINESTRING EMPTY,POLYGON ((0 0,1 1,1 0,0 0)),MULTIPOINT (1 2,-3 4),MULTILINESTRING ((1 2,3 4),EMPTY),MULTIPOLYGON (((0 0,1 1))),GEOMETRYCOLLECTION EMPTY)"
    values = [("a", "bool", True), ("b", "int8", -5), ("c", "uint64", 2**64 - 1), ("d", "float64", 0.5), ("e", "string", "é"), ("f", "vec", [1, "x", None or 2.5]), ("g", "map", {"k": [True]}), ("h", "bytes", [1, 255])]
    ((shape, entries),) = codec.decode(packed([(text, values)], compressed=compressed))
    assert wkt.render(shape) == text and entries == values


def test_files(spark, tmp_path):
    f = spark.range(50).select(F.col("id").alias("feature_id"), geometry.point(F.struct((F.col("id") * 1000).cast("int").alias("lng"), F.col("id").cast("int").alias("lat"))).alias("geom"), properties.of(properties.entry("n", F.col("id"), "int64"), properties.entry("s", F.col("id").cast("string"), "string")).alias("properties"))
    f = f.select("*", *geometry.bounds(F.col("geom")))
    codec.write(f, str(tmp_path / "x.bin"), compressed=True, goal=300)
    back = codec.read(spark, str(tmp_path / "x.bin"))
    p = F.col("properties")
    got = [(r.n, r.min_lng, r.s) for r in back.orderBy("feature_id").select(properties.get(p, "n", "bigint").alias("n"), "min_lng", properties.get(p, "s", "string").alias("s")).collect()]
    want = [r.feature_id for r in layout.with_hilbert(f).orderBy(*layout.order()).collect()]
    assert got == [(i, i * 1000, str(i)) for i in want]


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("n, goal", [(0, 300), (1, 300), (17, 300), (3000, 1000), (3000, 64 * 1024)])
def test_file_made_in_tasks_is_the_one_made_in_one_place(spark, tmp_path, n, goal, compressed):
    at = F.struct((F.col("id") * 7919 % 1000).cast("int").alias("lng"), (F.col("id") * 104729 % 1000).cast("int").alias("lat"))
    shape = F.when(F.col("id") % 11 == 3, geometry.line_string(F.expr("cast(array() as array<struct<lng:int,lat:int>>)"))).otherwise(geometry.point(at))
    f = spark.range(n).repartition(3).select(F.col("id").alias("feature_id"), shape.alias("geom"), properties.of(properties.entry("s", F.repeat(F.lit("x"), (F.col("id") % 13).cast("int")), "string")).alias("properties"))
    f = f.select("*", *geometry.bounds(F.col("geom")))
    codec.write(f, str(tmp_path / "x.bin"), compressed, goal)
    rows = layout.with_hilbert(f).orderBy(*layout.order()).select("*", properties.to_json_entries(F.col("properties")).alias("e")).collect()
    out = io.BytesIO()
    codec.encode([(None if r.min_lng is None else (r.min_lng, r.min_lat, r.max_lng, r.max_lat), codec.encode_feature(wkt.from_nodes(r.geom), [("s", "string", json.loads(r.e[0].json))])) for r in rows], out, compressed, goal)
    assert (tmp_path / "x.bin").read_bytes() == out.getvalue()


@pytest.fixture
def came(monkeypatch):
    """How many rows each call brings to the driver."""
    got = []

    def watch(kind, name):
        whole = getattr(kind, name)

        def counted(self, *args, **named):
            rows = whole(self, *args, **named)
            rows = rows if hasattr(rows, "num_rows") else list(rows)
            got.append(len(rows))
            return rows

        monkeypatch.setattr(kind, name, counted)

    from pyspark.sql.classic.dataframe import DataFrame

    for name in ("collect", "toArrow", "toLocalIterator"):
        watch(DataFrame, name)
    return got


def test_rows_do_not_come_to_the_driver(spark, tmp_path, came):
    f = spark.range(200).select(F.col("id").alias("feature_id"), geometry.point(F.struct(F.col("id").cast("int").alias("lng"), F.col("id").cast("int").alias("lat"))).alias("geom"), properties.empty().alias("properties"))
    codec.write(f.select("*", *geometry.bounds(F.col("geom"))), str(tmp_path / "x.bin"))
    assert came and max(came) < 20


def test_box_query_of_a_packed_file_leaves_rows_with_the_tasks(spark, came):
    found = queries.QUERIES["packed_select_bbox"](spark, "/root/testdata/sf0.001")
    assert came and max(came) < 20 < spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert found.count() == queries.QUERIES["rtree_search"](spark, "/root/testdata/sf0.001").count() > 0


def test_box_of_a_file_made_in_tasks(spark, tmp_path):
    """Hits on many pages that different tasks have made."""
    at = F.struct((F.col("id") * 7919 % 1000).cast("int").alias("lng"), (F.col("id") * 104729 % 1000).cast("int").alias("lat"))
    f = spark.range(3000).repartition(5).select(F.col("id").alias("feature_id"), geometry.point(at).alias("geom"), properties.of(properties.entry("n", F.col("id"), "int64")).alias("properties"))
    f = f.select("*", *geometry.bounds(F.col("geom")))
    codec.write(f, str(tmp_path / "x.bin"), compressed=True, goal=700)
    box = bounds.Box(100, 150, 420, 700)
    got = sorted(r[0] for r in codec.read(spark, str(tmp_path / "x.bin"), box).select(properties.get(F.col("properties"), "n", "bigint")).collect())
    assert got == sorted(r[0] for r in f.where(bounds.intersects(box)).select("feature_id").collect()) and len(got) > 100
    assert codec.transfer(spark, str(tmp_path / "x.bin"), box).first().features == len(got)
