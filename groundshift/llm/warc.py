"""WARC archives as a PySpark data source, and the writer that makes them.

Reading plans partitions over files and byte ranges of records, takes record-type and header predicates from the
optimizer, parses headers first and steps over the payloads of records that no one wants. In archives written here each
record is a gzip member of its own whose extra field holds its length, so a skipped one is neither read nor
decompressed, and a manifest names ranges. Other .warc and .warc.gz files are read as they are, one task for each file:
payloads of plain ones are stepped over, those of compressed ones inflated and thrown away.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from groundshift.llm import common

READ_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_length long, payload_bytes long, headers map<string,string>, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Columns that record headers alone decide.
HEADER_COLUMNS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str):
    """(pyarrow file system, path) of a local path or a URI in any store that pyarrow knows."""
    from pyarrow import fs

    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def manifests(store, base: str) -> list[dict]:
    """The manifests of a folder, one for each write into it."""
    from pyarrow import fs

    if store.get_file_info(base).type != fs.FileType.Directory:
        return []
    out = []
    for info in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_stream(info.path, compression=None) as f:
                out.append(json.loads(f.read()))
    return out


class Blocks:
    """Bytes of a plain or gzip file, member after member, read on in steps."""

    def __init__(self, f, packed: bool):
        self.f, self.packed, self.held = f, packed, b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        data = self.f.read(1 << 18)
        if not data:
            return False
        while self.packed and data:
            self.held += self.inflate.decompress(data)
            data = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.held += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held.strip():
                    raise ValueError("a WARC record breaks off in its headers")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, size: int, keep: bool = True) -> bytes:
        parts, left = [], size
        while True:
            part, self.held = self.held[:left], self.held[left:]
            left -= len(part)
            if keep:
                parts.append(part)
            if not left:
                return b"".join(parts)
            if not keep and not self.packed:
                self.f.seek(left, 1)
                return b""
            if not self.more():
                raise ValueError("a WARC record breaks off in its block")


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member whose extra field `sl` holds its own length and that of the data (32 bits each)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def header_value(text: str) -> str:
    """text as one header line: control characters and all beyond ASCII percent-encoded."""
    return quote(text, safe="%!*'();:@&=+$,/?#[]~-._<> \"{}|\\^`") if re.search(r"[^\x20-\x7e]", text) else text


def record(row: dict) -> bytes:
    """A response or revisit record; its block is an HTTP head, followed by the payload unless it is a revisit."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['warc_date']}", f"WARC-Payload-Digest: {row['payload_digest']}"]
    if row["target_uri"]:
        lines.append(f"WARC-Target-URI: {header_value(row['target_uri'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file of its own name; a manifest of the write, made last, names the files of the tasks that counted."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path.rstrip("/"), level

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = file_system(self.path)
        store.create_dir(base, recursive=True)
        name, at, last, starts = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    for row in batch.slice(k, 256).to_pylist():
                        at += out.write(gzip_member(record(row), self.level))
                        if at - last >= 8 << 20:
                            starts.append(at)
                            last = at
        return Written(name, [s for s in starts if s < at or s == 0], at)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = file_system(self.path)
        store.create_dir(base, recursive=True)
        files = [{"name": m.name, "starts": m.starts, "size": m.size} for m in messages if m and m.size]
        with store.open_output_stream(f"{base}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, base = file_system(self.path)
        for m in messages:
            if m and store.get_file_info(f"{base}/{m.name}").type.name == "File":
                store.delete_file(f"{base}/{m.name}")


@dataclass
class Range(InputPartition):
    """Records from start to end of a file written here; the whole of any other file."""

    file: str
    start: int
    end: int
    own: bool = True


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path.rstrip("/"), columns, {}

    def pushFilters(self, filters: list[Filter]):
        """Take equality and IN predicates on columns that record headers alone decide; give the rest back."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                if None not in values:
                    name = f.attribute[0]
                    self.wanted[name] = self.wanted.get(name, values) & values
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = file_system(self.path)
        known = manifests(store, base)
        if known:
            files = [x for m in known for x in m["files"]]
            return [Range(f"{self.path}/{x['name']}", s, e) for x in files for s, e in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)] or [Range("", 0, 0)]
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [Range(self.path, 0, info.size, own=False)]
        found = sorted((i for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.path.endswith((".warc", ".warc.gz"))), key=lambda i: i.path)
        return [Range(self.path + i.path[len(base.rstrip("/")) :], 0, i.size, own=False) for i in found] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, path = file_system(part.file)
        types = {"content_length": pa.int64(), "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in self.columns], names=self.columns)

        with store.open_input_file(path) as f:
            for row in self.own_records(f, part) if part.own else self.records(Blocks(f, path.endswith(".gz"))):
                if row is not None:
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                if len(rows) >= 1024 or size > 8 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    def own_records(self, f, part: Range) -> Iterator[dict | None]:
        at = part.start
        while at < part.end:
            row, at = self.record(f, at)
            yield row

    def records(self, blocks: Blocks) -> Iterator[dict]:
        """Matching records of all types of an ordinary file. The payload is the block, behind its HTTP head if it has one."""
        whole = "payload" in self.columns or "payload_bytes" in self.columns
        while (head := blocks.until(b"\r\n\r\n")) is not None:
            if not head.strip():
                continue  # the two line ends behind the last block
            first, *lines = head.decode("utf-8", "replace").strip().split("\r\n")
            # A line that begins with white space goes on with the one before it.
            headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in re.sub(r"\r\n[ \t]+", " ", "\r\n".join(lines)).split("\r\n"))]
            by_name = {k.lower(): v for k, v in headers}
            if not first.startswith("WARC/") or not by_name.get("content-length", "").isdigit():
                raise ValueError(f"not the head of a WARC record: {first[:80]!r}")
            size = int(by_name["content-length"])
            named = {c: by_name.get(h.lower()) for c, h in HEADER_COLUMNS.items()}
            wanted = all(named[c] in values for c, values in self.wanted.items())
            block = blocks.take(size, wanted and whole)
            if not wanted:
                continue
            row = named | {"content_length": size, "headers": headers, "payload_bytes": None, "payload": None}
            if whole:
                http, _, payload = block.partition(b"\r\n\r\n") if by_name.get("content-type", "").lower().startswith("application/http") else (b"", b"", block)
                length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
                if named["record_type"] == "revisit":
                    row["payload_bytes"] = int(length[1]) if length else None
                else:
                    row["payload"], row["payload_bytes"] = payload, len(payload)
            yield row

    def record(self, f, at: int) -> tuple[dict | None, int]:
        """The record at `at`, or None if its headers don't match, and where the next one begins."""
        f.seek(at)
        chunk = f.read(4096)
        length = struct.unpack_from("<I", chunk, 16)[0]
        inflate = zlib.decompressobj(-15)
        data, fed = inflate.decompress(chunk[24:length]), len(chunk)
        while b"\r\n\r\n" not in data and fed < length:
            more = f.read(min(4096, length - fed))
            fed += len(more)
            data += inflate.decompress(more)
        head, _, data = data.partition(b"\r\n\r\n")
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
        named = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
        if any(named[c] not in values for c, values in self.wanted.items()):
            return None, at + length
        row = named | {"content_length": int(headers["Content-Length"]), "headers": list(headers.items())}
        if "payload" in self.columns or "payload_bytes" in self.columns:
            parts = [data]
            whole = "payload" in self.columns and named["record_type"] != "revisit"
            while (whole or b"\r\n\r\n" not in b"".join(parts)) and fed < length:
                more = f.read(length - fed if whole else min(4096, length - fed))
                fed += len(more)
                parts.append(inflate.decompress(more[: max(0, len(more) - 8)] if fed >= length else more))
            http, _, payload = b"".join(parts)[: row["content_length"]].partition(b"\r\n\r\n")
            found = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
            row["payload_bytes"] = int(found[1]) if found else None
            row["payload"] = payload if whole else None
        return row, at + length


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder) and df.write.format("warc").save(folder).

    Options: path (a folder or file, local or in a store that pyarrow knows), columns (comma-separated; others are not
    decoded), level (of deflate, 1 to 9). A folder without files gives an empty table. A record that breaks off, or has
    no length, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]

    def schema(self) -> str:
        fields = [f.strip() for f in re.split(r", (?=\w+ )", READ_SCHEMA)]
        wanted = self._columns()
        return ", ".join(f for f in fields if not wanted or f.split(" ")[0] in wanted)

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", "3")))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def id_uri(col) -> F.Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(col.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(df: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record for each row; of equal payloads of at least `least` bytes, all but the largest id's revisit it.

    A null payload is empty; an empty table makes no records; other columns don't matter; repeated payloads of different
    ids revisit the one with the largest, however many there are. Rows that share the largest id are all responses. In a group without any id all rows are
    responses. Groups come from one group-by on length and digest; only groups of two and more are joined back, the
    hottest ones by broadcast (fewer than 10,000 by definition), so a payload with a third of all rows moves nothing.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    rows = rows.withColumn("key", F.when(F.col("payload_bytes") >= least, F.concat_ws("-", "sha", "payload_bytes")))
    groups = rows.filter("key is not null").groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("copies"))
    groups = common.materialize(groups.filter("copies > 1 and first is not null"), "payloads")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    out = common.join_counted(rows, groups, "key", "copies", total, "id")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    out = out.select(
        id_uri(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), "sha").alias("payload_digest"), F.when(revisit, id_uri(F.col("first"))).alias("refers_to"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(spark)
    out.write.format("warc").mode("append").option("path", path).save()
    common.drop(groups)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of archives that write_archives wrote.

    Responses are decoded and their length and digest taken from the payload itself; of revisits only headers are read.
    """
    register(spark)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)>$', 1) as long)")
    load = lambda kind, columns: spark.read.format("warc").option("path", path).option("columns", columns).load().filter(F.col("record_type") == kind)
    responses = load("response", "record_id,record_type,payload").select(number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = load("revisit", "record_id,record_type,payload_digest,refers_to,payload_bytes").select(number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


def archive_round_trip(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write df's rows as WARC archives in the shared folder and read them back."""
    path = path or common.table_path(df.sparkSession, "warc")
    write_archives(df, path, **options)
    return read_pages(df.sparkSession, path)
