"""The packed binary format: header, index and pages in one file. Uncompressed or zstd.

All numbers are little-endian and of fixed width; lengths are u64, tags u32. A file
can't be split, so each is read by one task. Its features are encoded and its pages and index
made in tasks; the driver only strings the finished pieces together, stream to stream. Parquet
datasets are the way to store much.
"""

from __future__ import annotations

import base64
import io
import itertools
import json
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import DecodeError, StorageError
from ..functions import bounds, geometry, properties, wkt
from ..operators import layout, rtree, shared

#: Widths and value types of the format (fixed values).
HEADER, NODE, PAGE = struct.Struct("<?QQ"), struct.Struct("<iiiiQI"), struct.Struct("<III")
_NUMBERS = {"int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float32": "f", "float64": "d"}
_NOWHERE = (2**31 - 1, 2**31 - 1, -(2**31), -(2**31))
_FLAT = (geometry.LINE_STRING, geometry.MULTI_POINT)
_MEMBER = {geometry.POLYGON: geometry.LINE_STRING, geometry.MULTI_LINE_STRING: geometry.LINE_STRING, geometry.MULTI_POLYGON: geometry.POLYGON}


def _u64(n: int) -> bytes:
    return struct.pack("<Q", n)


def _geometry(shape: wkt.Shape, tagged: bool = True) -> bytes:
    kind, members = shape
    head = struct.pack("<I", kind) if tagged else b""
    if kind == geometry.POINT:
        return head + struct.pack("<ii", *members[0])
    if kind in _FLAT:
        return head + _u64(len(members)) + b"".join(struct.pack("<ii", *p) for p in members)
    return head + _u64(len(members)) + b"".join(_geometry(m, kind == geometry.COLLECTION) for m in members)


def _text(s: str) -> bytes:
    b = s.encode()
    return _u64(len(b)) + b


def _tag_of(v) -> str:
    return "bool" if isinstance(v, bool) else "int64" if isinstance(v, int) else "float64" if isinstance(v, float) else "string" if isinstance(v, str) else "vec" if isinstance(v, list) else "map"


def _value(tag: str, v) -> bytes:
    head = struct.pack("<I", properties.TAGS.index(tag))
    if tag == "bool":
        return head + struct.pack("<?", v)
    if tag in _NUMBERS:
        return head + struct.pack("<" + _NUMBERS[tag], v)
    if tag == "bytes":
        return head + _u64(len(v)) + bytes(v)
    if tag == "string":
        return head + _text(v)
    if tag == "vec":
        return head + _u64(len(v)) + b"".join(_value(_tag_of(x), x) for x in v)
    return head + _properties([(k, _tag_of(x), x) for k, x in v.items()])


def _properties(entries: list[tuple[str, str, object]]) -> bytes:
    return _u64(len(entries)) + b"".join(_text(k) + _value(t, v) for k, t, v in entries)


def encode_feature(shape: wkt.Shape, entries: list[tuple[str, str, object]]) -> bytes:
    return _geometry(shape) + _properties(entries)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        s = struct.Struct("<" + form)
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out

    def raw(self) -> bytes:
        (n,) = self.take("Q")
        self.at += n
        return self.data[self.at - n : self.at]

    def shape(self, kind: int | None = None) -> wkt.Shape:
        kind = self.take("I")[0] if kind is None else kind
        if kind == geometry.POINT:
            return kind, [self.take("ii")]
        (n,) = self.take("Q")
        if kind in _FLAT:
            return kind, [self.take("ii") for _ in range(n)]
        return kind, [self.shape(_MEMBER.get(kind)) for _ in range(n)]

    def value(self) -> tuple[str, object]:
        tag = properties.TAGS[self.take("I")[0]]
        if tag == "bool":
            return tag, self.take("?")[0]
        if tag in _NUMBERS:
            return tag, self.take(_NUMBERS[tag])[0]
        if tag == "bytes":
            return tag, list(self.raw())
        if tag == "string":
            return tag, self.raw().decode()
        if tag == "vec":
            return tag, [self.value()[1] for _ in range(self.take("Q")[0])]
        return tag, {k: v for k, _, v in self.entries()}

    def entries(self) -> list[tuple[str, str, object]]:
        return [(self.raw().decode(), *self.value()) for _ in range(self.take("Q")[0])]


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(write_content_size=True).compress


def _page(body: bytes, count: int, pack) -> bytes:
    """A page as it stands in a file, with its header."""
    packed = pack(body)
    return PAGE.pack(len(packed), len(body), count) + packed


def encode(features: Iterable[tuple[tuple | None, bytes]], out, compressed: bool = False, goal: int = 64 * 1024) -> None:
    """Writes (bounds, encoded feature) pairs, already in stored order, to a binary file object."""
    pack = _compressor() if compressed else bytes
    leaves: list[tuple] = []
    with tempfile.TemporaryFile() as pages:
        page, count, start, n_pages = bytearray(), 0, 0, 0

        def close() -> None:
            nonlocal page, count, start, n_pages
            start += pages.write(_page(bytes(page), count, pack))
            page, count, n_pages = bytearray(), 0, n_pages + 1

        for box, data in features:
            leaves.append((*(box or _NOWHERE), start, len(page)))
            page += _u64(len(data)) + data
            count += 1
            if len(page) > goal:
                close()
        if page or not n_pages:
            close()
        out.write(HEADER.pack(compressed, n_pages, len(leaves)))
        levels = [leaves] if leaves else []
        while levels and len(levels[0]) > 1:
            below = levels[0]
            groups = [below[k : k + rtree.FANOUT] for k in range(0, len(below), rtree.FANOUT)]
            levels.insert(0, [(min(x[0] for x in g), min(x[1] for x in g), max(x[2] for x in g), max(x[3] for x in g), 0, 0) for g in groups])
        for level in levels:
            out.write(b"".join(NODE.pack(*x) for x in level))
        pages.seek(0)
        shutil.copyfileobj(pages, out)


def _body(data: bytes, at: int, compressed: bool) -> tuple[bytes, int, int]:
    """A page's decoded bytes, its features, and where the next page begins."""
    size, _, count = PAGE.unpack_from(data, at)
    body = data[at + PAGE.size : at + PAGE.size + size]
    if compressed and body:
        import zstandard

        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return body, count, at + PAGE.size + size


def header_of(data: bytes) -> tuple[bool, int, int]:
    """is_compressed, page_count, feature_count; DecodeError if the bytes are no header."""
    if len(data) < HEADER.size or data[0] > 1:
        raise DecodeError("no header of the packed format")
    return HEADER.unpack_from(data, 0)


def decode(data: bytes) -> Iterator[tuple[wkt.Shape, list[tuple[str, str, object]]]]:
    """All features of a file's bytes, in stored order."""
    compressed, n_pages, n = header_of(data)
    at = HEADER.size + rtree.index_bytes(n)
    for _ in range(n_pages):
        body, count, at = _body(data, at, compressed)
        c = _Cursor(body)
        for _ in range(count):
            c.take("Q")
            yield c.shape(), c.entries()


def locate(data: bytes, box: bounds.Box) -> tuple[list[tuple[int, int, int]], int]:
    """(place, page start, offset in the page) of the features whose bounds meet the box, ascending; nodes looked at.

    From the root down; children of neighbouring hits are read as one run.
    """
    _, _, n = header_of(data)
    ranges, looked = rtree.node_ranges(n), 0
    runs = [(0, 1)] if n else []
    for depth, (low, high) in enumerate(ranges):
        hits = []
        for a, z in runs:
            looked += z - a
            for k, (x0, y0, x1, y1, page, offset) in enumerate(NODE.iter_unpack(data[HEADER.size + a * NODE.size : HEADER.size + z * NODE.size]), a):
                if x1 >= box.min_lng and y1 >= box.min_lat and x0 <= box.max_lng and y0 <= box.max_lat:
                    hits.append((k, page, offset))
        if depth == len(ranges) - 1:
            return [(k - low, page, offset) for k, page, offset in hits], looked
        runs = []
        for k, _, _ in hits:
            a, z = rtree.children(n, k)
            if runs and runs[-1][1] == a:
                runs[-1] = (runs[-1][0], z)
            else:
                runs.append((a, z))
    return [], looked


def decode_bbox(data: bytes, box: bounds.Box) -> Iterator[tuple[int, wkt.Shape, list[tuple[str, str, object]]]]:
    """(place, shape, entries) of the features that meet the box; pages without any are not decoded."""
    compressed, _, n = header_of(data)
    base, held, body = HEADER.size + rtree.index_bytes(n), None, b""
    for place, page, offset in locate(data, box)[0]:
        if page != held:
            held, (body, _, _) = page, _body(data, base + page, compressed)
        c = _Cursor(body)
        c.at = offset + 8
        yield place, c.shape(), c.entries()


def sections(data: bytes) -> Iterator[tuple]:
    """(section, level, number, start, bytes, bounds..., features) of each part of a file: header, index nodes, pages and features."""
    compressed, n_pages, n = header_of(data)
    yield ("header", None, 0, 0, HEADER.size, None, None, None, None, n)
    ranges = rtree.node_ranges(n)
    for depth, (a, z) in enumerate(ranges):
        for k, (x0, y0, x1, y1, _, _) in enumerate(NODE.iter_unpack(data[HEADER.size + a * NODE.size : HEADER.size + z * NODE.size]), a):
            yield ("node", len(ranges) - 1 - depth, k, HEADER.size + k * NODE.size, NODE.size, x0, y0, x1, y1, None)
    at, place = HEADER.size + rtree.index_bytes(n), 0
    for page in range(n_pages):
        body, count, end = _body(data, at, compressed)
        yield ("page", None, page, at, end - at, None, None, None, None, count)
        c = _Cursor(body)
        for _ in range(count):
            start = c.at
            (size,) = c.take("Q")
            yield ("feature", page, place, start, 8 + size, None, None, None, None, None)
            c.at += size
            place += 1
        at = end


_SECTION = "path string, section string, level int, number long, start long, bytes long, min_lng int, min_lat int, max_lng int, max_lat int, features long"


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row for each part of packed files: section, level (of a node; a feature's page), number, start (a feature's within its decoded page), bytes, bounds, features."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], _SECTION).schema
    arrow = to_arrow_schema(kind)
    names = [f.name for f in kind]

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for s in sections(data):
                    rows.append(dict(zip(names, (file, *s))))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kind)


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def header(spark: SparkSession, path: str) -> DataFrame:
    """One row of a file's header, by reading its first 17 bytes from any file system that Spark reads."""
    at, fs = _open(spark, path)
    if not fs.exists(at):
        raise StorageError(f"no file at {path}")
    stream = fs.open(at)
    try:
        data = bytes(stream.readNBytes(HEADER.size))
    finally:
        stream.close()
    compressed, pages, n = header_of(data)
    row = (compressed, pages, n, HEADER.size, rtree.index_bytes(n), int(fs.getFileStatus(at).getLen()))
    return spark.createDataFrame([row], "is_compressed boolean, page_count long, feature_count long, header_bytes long, index_bytes long, file_bytes long")


_ENCODED = "pos long, min_lng int, min_lat int, max_lng int, max_lat int, data binary"
_PIECE = "page long, leaves binary, body binary"
_LEAF = np.dtype([(n, "<i4") for n in bounds.NAMES] + [("page", "<u8"), ("offset", "<u4")])


def _arrow(spark: SparkSession, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def _encoded(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """(pos, bounds, data) of placed features, each encoded once."""
    arrow = _arrow(spark, _ENCODED)

    def run(batches):
        for b in batches:
            data = []
            for geom, entries in zip(b.column("geom").to_pylist(), b.column("entries").to_pylist()):
                data.append(encode_feature(wkt.from_nodes(geom), [(e["key"], properties.TAGS[e["tag"]], json.loads(e["json"])) for e in entries or []]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in arrow.names[:-1]), pa.array(data, pa.binary())], schema=arrow)

    return placed.select("pos", *bounds.NAMES, "geom", "entries").mapInArrow(run, _ENCODED)


def _first_places(encoded: DataFrame, goal: int) -> np.ndarray:
    """The place of each page's first feature, ascending: one number for a page reaches the driver."""
    sized = encoded.select("pos", (F.octet_length("data") + 8).cast("long").alias("size"))
    ends = sized.agg(F.min("size").alias("a"), F.max("size").alias("z")).first()
    paged = layout.pages_fixed(sized, ends["a"], goal) if ends["a"] == ends["z"] else layout.pages(sized, "size", goal, exact=True)
    return np.sort(paged.groupBy("page_id").agg(F.min("pos").alias("pos")).select("pos").toArrow().column(0).to_numpy())


def _pieces(spark: SparkSession, encoded: DataFrame, first: np.ndarray, compressed: bool) -> DataFrame:
    """(page, leaves, body): each page as it stands in the file, and its leaves of the index but for the page's start."""
    arrow, with_page = _arrow(spark, _PIECE), f"page long, {_ENCODED}"

    def number(batches):
        for b in batches:
            page = np.searchsorted(first, b.column(0).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), *b.columns], names=["page", *b.schema.names])

    def pack(batches):
        shrink = _compressor() if compressed else bytes
        held, parts, at, kept = None, [], 0, []

        def close():
            body, leaves = b"".join(data for _, data in parts), np.array([leaf for leaf, _ in parts], _LEAF)
            return {"page": held, "leaves": leaves.tobytes(), "body": _page(body, len(parts), shrink)}

        for b in batches:
            corners = zip(*(b.column(n).to_pylist() for n in bounds.NAMES))
            for page, corner, data in zip(b.column("page").to_pylist(), corners, b.column("data").to_pylist()):
                if page != held:
                    if parts:
                        kept.append(close())
                    held, parts, at = page, [], 0
                parts.append(((*(_NOWHERE if corner[0] is None else corner), 0, at), _u64(len(data)) + data))
                at += 8 + len(data)
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                kept = []
        if parts:
            yield pa.RecordBatch.from_pylist([close()], schema=arrow)

    numbered = encoded.mapInArrow(number, with_page)
    return numbered.repartitionByRange("page").sortWithinPartitions("pos").mapInArrow(pack, _PIECE)


def _written(frame: DataFrame, order: str, chunk) -> str:
    """Writes the bytes that `chunk` makes of each batch, in order, as base64 text, the one form in which every file system takes them from tasks; gives the folder."""
    at = shared.path(frame.sparkSession, "pieces")

    def run(batches):
        rest = b""
        for b in batches:
            for data in chunk(b):
                data = rest + data
                whole = len(data) - len(data) % 3  # padding may stand at the end of a task's text only
                rest = data[whole:]
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(memoryview(data)[:whole]).decode()])], names=["value"])
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(rest).decode()])], names=["value"])

    frame.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, "value string").write.option("compression", "none").text(at)
    return at


def _append(spark: SparkSession, folder: str, out) -> None:
    """Copies the bytes under a folder of `_written` to a stream of the JVM, buffer by buffer."""
    at, fs = _open(spark, folder)
    jvm = spark._jvm
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for name in sorted(names, key=lambda n: (int(n.split("-")[1]), n)):
        part = jvm.java.io.BufferedInputStream(fs.open(jvm.org.apache.hadoop.fs.Path(at, name)), 1 << 20)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.util.Base64.getMimeDecoder().wrap(part), out, 1 << 20, False)
        finally:
            part.close()


def write(features: DataFrame, path: str, compressed: bool = False, goal: int = 64 * 1024) -> None:
    """Writes one file to any file system that Spark writes.

    Tasks encode the features and make pages and index; two numbers for each page reach the driver, which
    copies the finished pieces into the file.
    """
    spark = features.sparkSession
    rows = layout.with_hilbert(features).select("hilbert", "feature_id", "geom", properties.to_json_entries(F.col("properties")).alias("entries"), *bounds.NAMES)
    encoded = shared.stored(_encoded(spark, layout.ranked(rows)))
    n = encoded.count()
    folders, pages = [], 1
    if n:
        first = _first_places(encoded, goal)
        pieces, pages = shared.stored(_pieces(spark, encoded, first, compressed)), len(first)
        sizes = pieces.select("page", F.octet_length("body").alias("n")).toArrow()
        size = np.zeros(pages, np.int64)
        size[sizes.column(0).to_numpy()] = sizes.column(1).to_numpy()
        start = np.cumsum(size) - size

        def inner(b):
            out = np.zeros(b.num_rows, _LEAF)
            for name, none in zip(bounds.NAMES, _NOWHERE):
                out[name] = b.column(name).fill_null(none).to_numpy()
            yield out.tobytes()

        def leaves(b):
            for page, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = np.frombuffer(data, _LEAF).copy()
                out["page"] = start[page]
                yield out.tobytes()

        tree = rtree.nodes(encoded, n, 1).select("node", *bounds.NAMES)
        folders = [_written(tree, "node", inner), _written(pieces.select("page", "leaves"), "page", leaves), _written(pieces.select("page", "body"), "page", lambda b: b.column(1).to_pylist())]
    at, fs = _open(spark, path)
    stream = fs.create(at, True)
    try:
        if n:
            stream.write(bytearray(HEADER.pack(compressed, pages, n)))
            for folder in folders:
                _append(spark, folder, stream)
        else:
            none = io.BytesIO()
            encode([], none, compressed, goal)
            stream.write(bytearray(none.getvalue()))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, box: bounds.Box | None = None) -> DataFrame:
    """Features of one or many files, one task for each; feature_id follows stored order. With a box only pages with hits in the index are decoded."""
    schema = f"geom {geometry.TYPE}, entries array<struct<key:string,tag:tinyint,json:string>>"
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                found = decode(data) if box is None else ((s, e) for _, s, e in decode_bbox(data, box))
                while rows := [{"geom": wkt.to_nodes(s), "entries": [{"key": k, "tag": properties.TAGS.index(t), "json": json.dumps(v)} for k, t, v in e]} for s, e in itertools.islice(found, 10_000)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)
    out = found.select(F.monotonically_increasing_id().alias("feature_id"), "geom", properties.from_json_entries(F.col("entries")).alias("properties"))
    return out.select("*", *geometry.bounds(F.col("geom")))


def _touched(file: str, data: bytes, box: bounds.Box) -> dict:
    _, _, n = header_of(data)
    hits, looked = locate(data, box)
    base, pages = HEADER.size + rtree.index_bytes(n), {p for _, p, _ in hits}
    size = sum(PAGE.size + PAGE.unpack_from(data, base + p)[0] for p in pages)
    return {"path": file, "file_bytes": len(data), "index_bytes": looked * NODE.size, "page_bytes": size, "pages": len(pages), "features": len(hits)}


def transfer(spark: SparkSession, path: str, box: bounds.Box) -> DataFrame:
    """(path, file_bytes, index_bytes, page_bytes, pages, features): what a box query touches of each file."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([_touched(f, d, box) for f, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])

    kind = "path string, file_bytes long, index_bytes long, page_bytes long, pages long, features long"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, kind)
