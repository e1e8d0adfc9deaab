"""Stored trees, exact pages, cursors, files and errors on small fixtures."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from plotweave import errors, logs
from plotweave.functions import bounds, geometry, properties, wkt
from plotweave.operators import layout, rtree
from plotweave.sources import codec, dataset, geojson, table


def boxes(spark, n):
    f = spark.range(n).select(F.col("id").alias("feature_id"), geometry.line_string(F.array(*(F.struct(F.expr(f"cast({x} as int)").alias("lng"), F.expr(f"cast({y} as int)").alias("lat")) for x, y in (("(id * 7919) % 100000", "(id * 104729) % 90000"), ("(id * 7919) % 100000 + id % 50", "(id * 104729) % 90000 + 9"))))).alias("geom"), properties.of(properties.entry("n", F.col("id"), "int64")).alias("properties"))
    return f.select("*", *geometry.bounds(F.col("geom")))


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_pages_run_on_across_partitions(spark, parts):
    r = random.Random(parts)
    size = [r.choice([1, 5, 40, 90, 300]) for _ in range(700)]
    f = spark.createDataFrame(list(enumerate(size)), "pos long, size long").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.pos: x.page_id for x in layout.pages(f, "size", 200, exact=True).collect()}
        loose = {x.pos: x.page_id for x in layout.pages(f, "size", 200).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held, page = 0, 0
    for pos, s in enumerate(size):
        assert got[pos] == page
        held += s
        if held > 200:
            held, page = 0, page + 1
    ids = [loose[p] for p in range(700)]
    assert sorted(set(ids)) == list(range(max(ids) + 1)) and ids == sorted(ids)


def test_sums_before(spark):
    rows = [(k, k * k % 17) for k in range(200)]
    got = {r.k: r.s for r in layout.sums_before(spark.createDataFrame(rows, "k long, v long").repartition(7), "k", "v", "s").collect()}
    assert got == {k: sum(v for _, v in rows[:k]) for k in range(200)}


@pytest.mark.parametrize("most,gap", [(1024, 0), (1024, 40), (3, 0)])
def test_merged_ranges_cover_all_hits(spark, most, gap):
    pos = [0, 1, 2, 7, 8, 30, 31, 90]
    got = rtree.merged_ranges(spark.createDataFrame([(p,) for p in pos], "pos long"), 4, gap, most)
    assert all(any(a <= p * 4 and p * 4 + 4 <= z for a, z in got) for p in pos)
    assert all(z + gap < a for (_, z), (a, _) in zip(got, got[1:]))
    if (most, gap) == (1024, 0):
        assert got == [(0, 12), (28, 36), (120, 128), (360, 364)]
    assert rtree.merged_ranges(spark.createDataFrame([], "pos long")) == []


def test_stored_search_prunes_and_finds_all(spark, tmp_path):
    f = boxes(spark, 3000)
    d = dataset.write_clustered(f, str(tmp_path / "d"), page_bytes=4096, partitions=4)
    box = bounds.Box(20_000, 20_000, 45_000, 50_000)
    want = {r.feature_id for r in f.where(bounds.intersects(box)).collect()}
    found = d.search(box)
    assert {r.feature_id for r in found.collect()} == want == {r.feature_id for r in d.select_bbox(box).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pos" in plan
    assert d.header.first()["page_count"] == d.pages().count() > 10
    assert [r.pos for r in d.cursor()] == list(range(3000))
    assert next(d.cursor(box))["feature_id"] in want
    assert d.search(bounds.Box(-9, -9, -5, -5)).count() == 0
    for n in (0, 1):
        small = dataset.write_clustered(boxes(spark, n), str(tmp_path / f"small{n}"))
        assert small.search(bounds.Box(0, 0, 100_000, 100_000)).count() == n


def test_packed_box_equals_a_filter(spark, tmp_path):
    f = boxes(spark, 400)
    codec.write(f, str(tmp_path / "x.bin"), compressed=True, goal=900)
    p = F.col("properties")
    for box in (bounds.Box(20_000, 20_000, 45_000, 50_000), bounds.Box(-5, -5, -1, -1), bounds.Box(0, 0, 10**6, 10**6)):
        got = sorted(r[0] for r in codec.read(spark, str(tmp_path / "x.bin"), box).select(properties.get(p, "n", "bigint")).collect())
        assert got == sorted(r.feature_id for r in f.where(bounds.intersects(box)).collect())
        t = codec.transfer(spark, str(tmp_path / "x.bin"), box).first()
        assert t.features == len(got) and t.index_bytes + t.page_bytes + codec.HEADER.size <= t.file_bytes
    whole = codec.inspect(spark, str(tmp_path / "x.bin"))
    assert whole.where("section = 'feature'").count() == 400 and whole.where("section <> 'feature'").agg(F.sum("bytes")).first()[0] == t.file_bytes


def test_errors_and_modes(spark, tmp_path):
    with pytest.raises(errors.StorageError):
        dataset.open_dataset(spark, str(tmp_path / "none"))
    with pytest.raises(errors.StorageError):
        codec.header(spark, str(tmp_path / "none"))
    with pytest.raises(errors.DecodeError):
        codec.header_of(b"\x07short")
    for bad in ({"type": "Point", "coordinates": []}, {"type": "Round"}, None, {"type": "LineString", "coordinates": [[1]]}):
        with pytest.raises(errors.DecodeError):
            geojson.shape_of(bad)
    assert geojson.shape_of({"type": "Point", "coordinates": [1, 2, 3]}) == (0, [(10_000_000, 20_000_000)])
    texts = spark.createDataFrame([("POINT(1 2)",), ("ROUND(1)",), (None,)], "t string")
    got = [r[0] for r in texts.select(wkt.text(table.parsed_text(F.col("t"), "null"))).collect()]
    assert got == ["POINT(1 2)", None, None]
    with pytest.raises(Exception, match="no geometry"):
        geojson.parse(spark.createDataFrame([('{"type":"Point","coordinates":[]}',)], "value string")).collect()


def test_streamed_dataset_has_a_manifest(spark, tmp_path):
    from plotweave.streaming import append

    boxes(spark, 30).drop("properties").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    append.append_clustered(stream, str(tmp_path / "out"), str(tmp_path / "check"), bounds.Box(0, 0, 100_000, 100_000)).awaitTermination()
    d = dataset.open_dataset(spark, str(tmp_path / "out"))
    assert d.header.first()["feature_count"] == 30 and d.describe().first()["page_count"] == 1


def test_logging_is_set_up_once():
    a, b = logs.setup(), logs.setup(logging.DEBUG)
    assert a is b and len(a.handlers) == 1 and a.level == logging.DEBUG
