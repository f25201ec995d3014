"""GeoTIFF files as a PySpark data source: pixels of stripped or tiled, plain or deflated rasters, and a writer.

Rows are row, col and one column for each band. Reading plans one partition for each strip or tile, so a file of any
size is read by many tasks; files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Field sizes and tag numbers of TIFF and GeoTIFF.
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


def open_store(path: str):
    from pyarrow import fs

    if not urlsplit(path).scheme or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def read_tags(f) -> tuple[str, dict[int, tuple]]:
    order = "<" if f.read(4) == b"II*\0" else ">"
    at = struct.unpack(order + "I", f.read(4))[0]
    f.seek(at)
    n = struct.unpack(order + "H", f.read(2))[0]
    raw, tags = f.read(12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * i)
        if kind not in FIELD:
            continue
        size = struct.calcsize(FIELD[kind]) * count
        data = raw[12 * i + 8 : 12 * i + 8 + size]
        if size > 4:
            f.seek(struct.unpack_from(order + "I", raw, 12 * i + 8)[0])
            data = f.read(size)
        tags[tag] = (data,) if kind == 2 else struct.unpack(f"{order}{count}{FIELD[kind]}", data)
    return order, tags


def profile(path: str) -> dict:
    """width, height, bands, origin, pixel size, EPSG code and nodata of a file."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        _, t = read_tags(f)
    keys = t.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    nodata = t[NODATA][0].rstrip(b"\0 ").decode() if NODATA in t else None
    tie, scale = t.get(TIE_POINT, (0,) * 6), t.get(PIXEL_SCALE, (1.0, 1.0, 0.0))
    return {"width": t[WIDTH][0], "height": t[HEIGHT][0], "bands": t.get(SAMPLES, (1,))[0], "x_min": tie[3], "y_max": tie[4], "size": scale[0], "epsg": epsg, "nodata": None if nodata is None else float(nodata)}


@dataclass
class Block(InputPartition):
    plane: int
    row: int
    col: int
    offset: int
    length: int


class TiffReader(DataSourceReader):
    def __init__(self, path: str, bands: list[str]):
        self.path, self.bands = path, bands

    def partitions(self) -> list[InputPartition]:
        store, name = open_store(self.path)
        with store.open_input_file(name) as f:
            _, t = read_tags(f)
        if t.get(PLANAR, (1,))[0] != 1:
            raise ValueError("only pixel-interleaved files are read")
        tiled = TILES in t
        w, h = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (t[WIDTH][0], t.get(ROWS_PER_STRIP, t[HEIGHT])[0])
        across = -(-t[WIDTH][0] // w)
        offsets, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
        return [Block(0, i // across * h, i % across * w, o, n) for i, (o, n) in enumerate(zip(offsets, sizes, strict=True))]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        store, name = open_store(self.path)
        with store.open_input_file(name) as f:
            order, t = read_tags(f)
            f.seek(part.offset)
            data = f.read(part.length)
        if t.get(COMPRESSION, (1,))[0] in (8, 32946):
            data = zlib.decompress(data)
        n, bits, kind = t.get(SAMPLES, (1,))[0], t[BITS][0], t.get(SAMPLE_FORMAT, (1,))[0]
        dtype = np.dtype(f"{order}{'uif'[kind - 1]}{bits // 8}")
        width, height = t[WIDTH][0], t[HEIGHT][0]
        w = t[TILE_WIDTH][0] if TILES in t else width
        block = np.frombuffer(data, dtype).reshape(-1, w, n)
        if t.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        block = block[: height - part.row, : width - part.col]
        rows, cols = (a.ravel() for a in np.mgrid[part.row : part.row + block.shape[0], part.col : part.col + block.shape[1]])
        values = block.reshape(-1, n).astype(np.float64)
        gone = np.isnan(values)
        if NODATA in t:
            gone |= values == float(t[NODATA][0].rstrip(b"\0 "))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), *[pa.array(values[:, i], pa.float64(), mask=gone[:, i]) for i in range(n)]], names=["row", "col", *self.bands])


def encode(array: np.ndarray, x_min: float, y_max: float, size: float, epsg: int, nodata: float) -> bytes:
    """A pixel-interleaved, deflated, stripped GeoTIFF of a (rows, cols, bands) array of 32-bit floats."""
    h, w, n = array.shape
    per = max(1, (1 << 18) // (w * n * 4))
    strips = [zlib.compress(np.ascontiguousarray(array[r : r + per], "<f4").tobytes()) for r in range(0, h, per)]
    entries: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (32,) * n), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (STRIPS, 4, (0,) * len(strips)), (SAMPLES, 3, (n,)), (ROWS_PER_STRIP, 4, (per,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (1,)), (SAMPLE_FORMAT, 3, (3,) * n),
        (PIXEL_SCALE, 12, (size, size, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, x_min, y_max, 0.0)), (GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg)), (NODATA, 2, f"{nodata:g}\0".encode()),
    ]

    def pack(kind: int, v) -> bytes:
        return v if kind == 2 else struct.pack(f"<{len(v)}{FIELD[kind]}", *v)

    head = 8 + 2 + 12 * len(entries) + 4
    at = head + sum(len(p) + len(p) % 2 for p in (pack(k, v) for _, k, v in entries) if len(p) > 4)
    offsets = tuple(at + sum(map(len, strips[:i])) for i in range(len(strips)))
    entries = [(t, k, offsets if t == STRIPS else v) for t, k, v in entries]
    table, extra = b"", b""
    for tag, kind, v in entries:
        p = pack(kind, v)
        if len(p) > 4:
            table += struct.pack("<HHII", tag, kind, len(v), head + len(extra))
            extra += p + b"\0" * (len(p) % 2)
        else:
            table += struct.pack("<HHI", tag, kind, len(v)) + p.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + table + b"\0\0\0\0" + extra + b"".join(strips)


@dataclass
class Done(WriterCommitMessage):
    names: list[str]


class TiffWriter(DataSourceArrowWriter):
    """Each task writes a GeoTIFF of the rows that it holds, placed by its own origin; an index names them all."""

    def __init__(self, path: str, bands: list[str], options: dict[str, str]):
        self.path, self.bands, self.options = path.rstrip("/"), bands, dict(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return Done([])
        row, col = (table.column(c).to_numpy().astype(int) for c in ("row", "col"))
        nodata, size = float(self.options.get("nodata", "-9999")), float(self.options.get("size", "10"))
        out = np.full((row.max() - row.min() + 1, col.max() - col.min() + 1, len(self.bands)), nodata, np.float32)
        for i, b in enumerate(self.bands):
            values = table.column(b).cast(pa.float64()).to_numpy()
            out[row - row.min(), col - col.min(), i] = np.where(np.isnan(values), nodata, values)
        x, y = float(self.options.get("x_min", "0")) + col.min() * size, float(self.options.get("y_max", "0")) - row.min() * size
        name = f"part-{uuid.uuid4().hex}.tif"
        store, base = open_store(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(encode(out, x, y, size, int(self.options.get("epsg", "32644")), nodata))
        return Done([name])

    def commit(self, messages: list[Done | None]) -> None:
        store, base = open_store(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/index.json") as f:
            f.write(json.dumps({"bands": self.bands, "files": [n for m in messages if m for n in m.names]}).encode())


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").option("bands", "b02,b03").load(file); df.write.format("geotiff").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _bands(self) -> list[str]:
        names = [b.strip() for b in self.options.get("bands", "").split(",") if b.strip()]
        return names or [f"band{i + 1}" for i in range(profile(self.options["path"])["bands"])]

    def schema(self) -> str:
        return "row int, col int, " + ", ".join(f"{b} double" for b in self._bands())

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], self._bands())

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options["path"], [f.name for f in schema.fields if f.name not in ("row", "col")], self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)
