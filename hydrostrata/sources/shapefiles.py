"""Shapefiles as a Spark data source, by the published layout of their three files (shapes, index of shapes, table).

Reading: a file's records are dealt to tasks by number; a task reads its slice of the index, and by it the bytes of its own
shapes and table rows only. A path is one file (.shp) or a folder of files with the same fields. Columns: record
(long, from 1 in its file), parts (array of arrays of x, y) and the table's fields. Points and multipoints have one
part, lines one a line, polygons one a ring, in the order of the file; a null shape is null.

Writing: each task writes a set of files of its own under names that do not end in .shp; the commit renames them,
so a lost or repeated task leaves nothing that is read (what a lost executor had begun stays, under other endings).
Mode overwrite deletes the files that are there just before. Columns: parts, and fields of types string, int, long, double, date and
boolean, whose names have at most 10 bytes; options kind (point, line, polygon or multipoint) and width (bytes of text
fields, 254 at most). What the layout can't hold raises: longer names or texts, a point with several places, over 2 GB a file.

Files are opened through pyarrow's file systems, so a path can be a local or mounted folder, HDFS or an object store.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Numbers of the kinds of shape in the published layout (fixed values); 0 is a null shape.
KINDS = {"point": 1, "line": 3, "polygon": 5, "multipoint": 8}
PARTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
#: Records that are read at a time, and table widths of numbers.
PIECE, WHOLE, REAL = 1000, 20, 24


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _sets(store: fs.FileSystem, path: str) -> list[str]:
    """Files of a path without their endings, by name."""
    if path.lower().endswith(".shp"):
        return [path[:-4]]
    return sorted(f.path[:-4] for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".shp"))


@dataclass
class Field:
    name: str
    code: str
    width: int
    decimals: int
    begin: int

    def type(self) -> T.DataType:
        if self.code in "NF":
            return T.DoubleType() if self.code == "F" or self.decimals or self.width > WHOLE else T.LongType()
        return {"D": T.DateType(), "L": T.BooleanType()}.get(self.code, T.StringType())

    def value(self, row: bytes):
        raw = row[self.begin : self.begin + self.width].decode("utf-8", "replace").rstrip(" \0")
        kind = self.type()
        if isinstance(kind, T.StringType):
            return raw or None
        raw = raw.strip()
        if not raw or raw[0] in "*?":
            return None
        if isinstance(kind, T.DateType):
            return None if raw == "0" * 8 else datetime.date(int(raw[:4]), int(raw[4:6]), int(raw[6:]))
        return raw in "YyTt" if isinstance(kind, T.BooleanType) else int(raw) if isinstance(kind, T.LongType) else float(raw)


def _fields(store: fs.FileSystem, base: str) -> tuple[list[Field], int, int]:
    """Fields of a table, the bytes of its header and of a row."""
    with store.open_input_file(base + ".dbf") as f:
        header, row = struct.unpack("<HH", f.read(32)[8:12])
        out, begin = [], 1
        for raw in struct.iter_unpack("32s", f.read((header - 33) // 32 * 32)):
            if raw[0][0] == 0x0D:
                break
            name, width = raw[0][:11].split(b"\0")[0].decode(), raw[0][16]
            out.append(Field(name, chr(raw[0][11]), width, raw[0][17], begin))
            begin += width
    return out, header, row


def _shape(raw: bytes) -> list[list[tuple[float, float]]] | None:
    kind = struct.unpack_from("<i", raw)[0]
    if kind == 0:
        return None
    if kind == KINDS["point"]:
        return [[struct.unpack_from("<2d", raw, 4)]]
    if kind == KINDS["multipoint"]:
        n, starts, at = struct.unpack_from("<i", raw, 36)[0], [0], 40
    elif kind in (KINDS["line"], KINDS["polygon"]):
        n_parts, n = struct.unpack_from("<2i", raw, 36)
        starts, at = struct.unpack_from(f"<{n_parts}i", raw, 44), 44 + 4 * n_parts
    else:
        raise ValueError(f"shapes of kind {kind} are not read")
    places = list(map(tuple, np.frombuffer(raw, "<f8", 2 * n, at).reshape(n, 2).tolist()))
    return [places[a:b] for a, b in zip(starts, [*starts[1:], n], strict=True)]


@dataclass
class Records(InputPartition):
    base: str
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Records]:
        store, path = _place(self.path)
        out = []
        for base in _sets(store, path):
            n = (store.get_file_info(base + ".shx").size - 100) // 8
            out += [Records(base, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        if not partition.base:
            return
        store, _ = _place(self.path)
        fields, header, size = _fields(store, partition.base)
        with store.open_input_file(partition.base + ".shx") as index, store.open_input_file(partition.base + ".shp") as shapes, store.open_input_file(partition.base + ".dbf") as table:
            for low in range(partition.low, partition.high, PIECE):
                n = min(PIECE, partition.high - low)
                at = np.frombuffer(index.read_at(8 * n, 100 + 8 * low), ">i4").reshape(n, 2).astype(np.int64) * 2
                rows = table.read_at(n * size, header + low * size)
                for k, (begin, length) in enumerate(at.tolist()):
                    row = rows[k * size : (k + 1) * size]
                    if row[:1] != b"*":  # a deleted row
                        yield (low + k + 1, _shape(shapes.read_at(length, begin + 8)), *(f.value(row) for f in fields))


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]] = field(default_factory=list)


def _text(value, code: str, width: int) -> bytes:
    if value is None:
        return (b"?" if code == "L" else b"").ljust(width)
    if code == "D":
        raw = value.strftime("%Y%m%d")
    elif code == "L":
        raw = "T" if value else "F"
    else:
        raw = repr(float(value)) if code == "F" else str(value)
    out = raw.encode()
    if len(out) > width:
        raise ValueError(f"a value of {len(out)} bytes in a field of {width}")
    return out.rjust(width) if code in "NF" else out.ljust(width)


class _Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, path: str, kind: str, width: int, overwrite: bool):
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        self.path, self.kind, self.overwrite = path, KINDS[kind], overwrite
        self.at = schema.fieldNames().index("parts")
        codes = {T.StringType: ("C", min(width, 254)), T.IntegerType: ("N", WHOLE), T.LongType: ("N", WHOLE), T.DoubleType: ("F", REAL), T.DateType: ("D", 8), T.BooleanType: ("L", 1)}
        self.fields = []
        for k, f in enumerate(schema.fields):
            if k != self.at:
                if type(f.dataType) not in codes or len(f.name.encode()) > 10:
                    raise ValueError(f"{f.name} {f.dataType.simpleString()} can't be a field of a shapefile")
                self.fields.append((k, f.name, *codes[type(f.dataType)]))

    def _content(self, parts: list | None) -> tuple[bytes, np.ndarray | None]:
        if parts is None:
            return struct.pack("<i", 0), None
        places = np.array([(p["x"], p["y"]) for part in parts for p in part], "<f8").reshape(-1, 2)
        if self.kind == KINDS["point"]:
            if len(places) != 1:
                raise ValueError("a point has one place")
            return struct.pack("<i", 1) + places.tobytes(), places
        ends = np.concatenate([places.min(axis=0), places.max(axis=0)]) if len(places) else np.zeros(4)
        head = struct.pack("<i4d", self.kind, *ends)
        if self.kind == KINDS["multipoint"]:
            return head + struct.pack("<i", len(places)) + places.tobytes(), places
        starts = np.cumsum([0] + [len(part) for part in parts])[:-1].astype("<i4")
        return head + struct.pack("<2i", len(parts), len(places)) + starts.tobytes() + places.tobytes(), places

    def write(self, iterator: Iterator[T.Row]) -> Written:
        store, path = _place(self.path)
        store.create_dir(path, recursive=True)
        base = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}"
        names = [(f"{base}.{end}.writing", f"{base}.{end}") for end in ("dbf", "shx", "shp")]  # shapes last: a set is read once they are there
        index, sizes, low, high, rows = [], 100, np.full(2, np.inf), np.full(2, -np.inf), 0
        # Streams can't go back to their headers, so contents go to bodies first, and follow their headers piece by piece.
        bodies = [f"{base}.{end}.body" for end in ("dbf", "shp")]
        with store.open_output_stream(bodies[0]) as table, store.open_output_stream(bodies[1]) as shapes:
            for row in iterator:
                content, places = self._content(row[self.at])
                rows += 1
                shapes.write(struct.pack(">2i", rows, len(content) // 2) + content)
                index.append((sizes // 2, len(content) // 2))
                sizes += 8 + len(content)
                if sizes >= 1 << 31:
                    raise ValueError("over 2 GB of shapes in a task: write from more partitions")
                if places is not None and len(places):
                    low, high = np.minimum(low, places.min(axis=0)), np.maximum(high, places.max(axis=0))
                table.write(b" " + b"".join(_text(row[k], code, width) for k, _, code, width in self.fields))
        if not rows:
            for body in bodies:
                store.delete_file(body)
            return Written()
        box = (*low, *high) if low[0] <= high[0] else (0.0,) * 4
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, self.kind, *box, 0, 0, 0, 0)
        today = datetime.date.today()
        table_head = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, rows, 33 + 32 * len(self.fields), 1 + sum(f[3] for f in self.fields))
        table_head += b"".join(struct.pack("<11sc4x2B14x", name.encode(), code.encode(), width, 0) for _, name, code, width in self.fields) + b"\r"
        for (name, _), body, start in ((names[0], bodies[0], table_head), (names[2], bodies[1], head(sizes))):
            with store.open_output_stream(name) as out, store.open_input_stream(body) as given:
                out.write(start)
                while piece := given.read(8 << 20):
                    out.write(piece)
            store.delete_file(body)
        with store.open_output_stream(names[1][0]) as out:
            out.write(head(100 + 8 * rows) + np.array(index, ">i4").tobytes())
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _place(self.path)
        old = [f"{base}.{end}" for base in _sets(store, path.rstrip("/")) for end in ("shp", "shx", "dbf")] if self.overwrite else []
        for name in old:
            store.delete_file(name)
        for message in messages:
            for made, final in message.names if message else []:
                store.move(made, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _place(self.path)
        for message in messages:
            for made, _ in message.names if message else []:
                store.delete_file(made)


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        store, path = _place(self.options["path"])
        bases = _sets(store, path)
        if not bases:
            raise ValueError(f"no shapefile in {path}")
        fields = _fields(store, bases[0])[0]
        return T.StructType([T.StructField("record", T.LongType()), T.StructField("parts", PARTS), *(T.StructField(f.name, f.type()) for f in fields)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows", 100_000)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options["path"], self.options.get("kind", ""), int(self.options.get("width", 254)), overwrite)


def shapefile(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """(record, parts, the table's fields) of a shapefile or a folder of them; a task reads `rows` records."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("rows", rows).load(path)


def write_shapefile(df: DataFrame, path: str, kind: str, mode: str = "append", width: int = 254) -> None:
    """Write parts and fields to a folder of shapefiles, one a partition that has rows."""
    df.sparkSession.dataSource.register(Shapefile)
    df.write.format("shapefile").mode(mode).option("kind", kind).option("width", width).save(path)
