"""WARC archives as a Spark data source: format "warc", for reading and writing.

Reading plans one partition for each file (or each run of small files up to PARTITION_BYTES). Each record is a gzip member
of its own; a record's WARC and HTTP headers are inflated and parsed first, pushed predicates on the record type and the
header columns are tested on them, and the payload of a record that is not wanted (or that the option payload=false waves
off) is not inflated: members of this writer carry their compressed length in a gzip extra field ("sl"), so the reader seeks
the next one without reading what lies between; in foreign files, and for members of 4 GiB and more (which go without the
field), it inflates and forgets. A Content-Length that is no number counts as missing: the payload reaches to the record's end.

Writing: each task writes files of its own attempt's name and rolls them at ROLL_BYTES; the commit writes a manifest of the
files of the tasks that succeeded, and a reader of a folder with a manifest opens no others. Option overwrite of the mode
empties nothing outside the folder.

Payload deduplication (write_pages): of pages with equal payloads of at least min_bytes the smallest page_id is a response,
the others are revisits that name it and carry no payload; their HTTP header keeps the payload's length.

Null html is an empty payload. Rows that repeat the smallest page_id of a payload are all responses. A null page_id is
written without a page number and reads back as null; it never stands for a payload if another does. A payload held only
by null page_ids is written as responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from lodestone.llm.common import few, narrowed, read_table, salted_join, workspace, written

PARTITION_BYTES = 32 << 20
ROLL_BYTES = 128 << 20
HEAD_BYTES = 8 << 10
READ_BYTES = 256 << 10
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest.json"
DATE = "2024-01-01T00:00:00Z"
#: Columns that WARC headers give: name and header.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", http_status int, http_length long, payload binary"
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    import os

    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else os.path.abspath(uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field "sl" holds its own compressed and its plain length, if 32 bits hold the first."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) if size < 1 << 32 else b""
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\x00") + struct.pack("<IBB", 0, 0, 255) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], http: bytes | None, payload: bytes) -> bytes:
    block = (http or b"") + payload
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


class Records:
    """The records of one archive, headers first."""

    def __init__(self, file, wanted, payload: bool):
        self.file, self.wanted, self.payload = file, wanted, payload
        self.inflated = self.read = 0  # bytes inflated and read, for tests

    def __iter__(self) -> Iterator[tuple]:
        buf, at, end = b"", 0, False

        def fill(n: int) -> bool:
            """At least n bytes from at on, unless the file ends."""
            nonlocal buf, at, end
            while len(buf) - at < n and not end:
                more = self.file.read(max(READ_BYTES, n - (len(buf) - at)))
                self.read += len(more)
                end = not more
                buf, at = buf[at:] + more, 0
            return len(buf) - at >= n

        def skip(n: int) -> None:
            """Past the n bytes from at on; what is not in the buffer is not read."""
            nonlocal buf, at
            beyond = n - (len(buf) - at)
            if beyond <= 0:
                at += n
                return
            buf, at, here = b"", 0, self.file.tell()
            if here + beyond > self.file.seek(0, 2):
                raise ValueError("a WARC file ends inside a record")
            self.file.seek(here + beyond)

        while fill(18):
            if buf[at : at + 3] != b"\x1f\x8b\x08":
                raise ValueError("a WARC file must hold gzip members")
            size = None
            if buf[at + 3] & 4 and buf[at + 12 : at + 14] == b"sl" and fill(24):
                size = struct.unpack_from("<I", buf, at + 16)[0]
                if not fill(min(size, HEAD_BYTES)):
                    raise ValueError("a WARC file ends inside a record")
            z = zlib.decompressobj(31)
            fed = min(size, len(buf) - at) if size else 0
            piece = buf[at : at + fed] if size else buf[at:]
            plain = z.decompress(piece, HEAD_BYTES)
            rest = z.unconsumed_tail

            def more(most: int):
                nonlocal plain, rest, buf, at, fed
                if not rest and not z.eof and size:
                    if not fill(fed + 1):
                        raise ValueError("a WARC file ends inside a record")
                    rest = buf[at + fed : at + size]
                    fed += len(rest)
                elif not rest and not z.eof:
                    at = len(buf)
                    fill(1)
                    rest = buf[at:]
                got = z.decompress(rest, most)
                rest = z.unconsumed_tail
                plain += got
                if not got and not z.eof and (size and fed >= size or end) and not rest:
                    raise ValueError("a WARC record is cut short")

            while b"\r\n\r\n" not in plain and not z.eof:
                more(HEAD_BYTES)
            head, _, _ = plain.partition(b"\r\n\r\n")
            fields = parse_headers(head)
            got = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
            if self.wanted(got):
                status = length = None
                start = len(head) + 4
                stop = start + int(given) if (given := fields.get("content-length", "")).isdigit() else None
                body = start
                if "http" in (got["content_type"] or ""):
                    while plain.find(b"\r\n\r\n", start) < 0 and not z.eof:
                        more(HEAD_BYTES)
                    cut = plain.find(b"\r\n\r\n", start)
                    if 0 <= cut and (stop is None or cut < stop):
                        body = cut + 4
                        line, _, lines = plain[start:cut].partition(b"\r\n")
                        if m := re.match(rb"HTTP/\S+ (\d+)", line):
                            status = int(m[1])
                        length = parse_headers(lines).get("content-length")
                data = None
                if self.payload:
                    while (stop is None or len(plain) < stop) and not z.eof:
                        more(max(stop - len(plain), 1) if stop is not None else READ_BYTES)
                    data = plain[body:stop] if stop is not None else plain[body:].removesuffix(b"\r\n\r\n")
                yield (*got.values(), status, int(length) if length is not None and length.isdigit() else None, data)
            self.inflated += len(plain)
            if size:
                skip(size)
            else:
                while not z.eof:
                    plain = b""
                    more(1 << 20)
                buf, at = z.unused_data, 0


def matcher(filters: list):
    """A test of header columns for the predicates that were taken."""
    tests = []
    for f in filters:
        (c,) = f.attribute
        if isinstance(f, EqualTo):
            tests.append((c, lambda v, x=f.value: v == x))
        elif isinstance(f, In):
            tests.append((c, lambda v, x=frozenset(y for y in f.value if y is not None): v in x))  # null is in no list
        else:
            tests.append((c, lambda v, x=f.value: v is not None and v.startswith(x)))
    return lambda got: all(t(got[c]) for c, t in tests)


# ---------------------------------------------------------------- the data source


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.names, self.filters = [f.name for f in schema.fields], []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and (not isinstance(f, EqualTo) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        if info.is_file:
            found = [(root, info.size)]
        elif fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                found = [(f"{root}/{n}", s) for n, s in json.loads(f.read())["files"]]
        else:
            found = sorted((i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".warc.gz"))
        out, now, size = [], [], 0
        for name, n in found:
            if now and size + n > PARTITION_BYTES:
                out.append(_Files(now))
                now, size = [], 0
            now.append(name)
            size += n
        return [*out, *([_Files(now)] if now else [])] or [_Files([])]

    def read(self, partition):
        fs, _ = filesystem(self.path)
        schema = pa.schema([*[(c, pa.string()) for c in HEADERS], ("http_status", pa.int32()), ("http_length", pa.int64()), ("payload", pa.binary())])
        keep = matcher(self.filters)
        for name in partition.names:
            rows, size = [], 0
            with fs.open_input_file(name) as f:
                for row in Records(f, keep, self.payload and "payload" in self.names):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield self._batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield self._batch(rows, schema)

    def _batch(self, rows, schema):
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        return batch.select(self.names)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 6)), overwrite

    def write(self, iterator) -> _Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                files.append((name, size))
                out = None

        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
                    size += out.write(member(record(info, None, b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"), self.level))
                revisit = r["record_type"] == "revisit"
                payload = b"" if revisit else r["payload"] or b""
                fields = {
                    "WARC-Type": r["record_type"],
                    "WARC-Record-ID": r["record_id"],
                    "WARC-Date": DATE,
                    "WARC-Target-URI": re.sub(r"[\r\n]", " ", r["target_uri"]) if r["target_uri"] is not None else None,
                    "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
                    "WARC-Refers-To": r["refers_to"],
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
                    "Content-Type": "application/http; msgtype=response",
                }
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['http_length']}\r\n\r\n".encode()
                size += out.write(member(record(fields, http, payload), self.level))
                if size >= ROLL_BYTES:
                    close()
        close()
        return _Written(files)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted((n, s) for m in messages if m for n, s in m.files)
        if not self.overwrite and fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = sorted([*map(tuple, json.loads(f.read())["files"]), *files])
        with fs.open_output_stream(f"{root}/{MANIFEST}.new", compression=None) as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for n, _ in m.files if m else ():
                fs.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---------------------------------------------------------------- pages


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of pages (page_id, url, html): responses, and revisits of equal payloads."""
    pages = narrowed(pages, page_id="page_id", url="url", html="html").withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    pages = pages.withColumns({"sha": F.sha1("payload"), "http_length": F.octet_length("payload").cast("long")})
    first = pages.where(F.col("http_length") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha", "first_id")
    first = written(first, "payloads")
    # Few repeated payloads go out as a broadcast of known size; else the pages are dealt by payload, hot ones over many tasks.
    pages = pages.join(F.broadcast(first), "sha", "left") if few(first, 50_000) else salted_join(pages, first, ["sha"], F.coalesce("page_id", F.lit(0)), 64, "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return pages.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn("page_id"), F.lit("<urn:page:>")).alias("record_id"),
        F.col("url").alias("target_uri"),
        "sha",
        F.when(revisit, urn("first_id")).alias("refers_to"),
        "http_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32_of(hexed: Column) -> Column:
    """A SHA-1 in hexadecimal as bare base32: four groups of 40 bits, each of eight digits."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(4):
        group = F.conv(F.substring(hexed, 1 + 10 * g, 10), 16, 10).cast("long")
        out += [F.substring(digits, (F.shiftright(group, 5 * (7 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    rows = page_records(pages, min_bytes).withColumn("payload_digest", base32_of(F.col("sha")))
    rows.select(*[c.split()[0] for c in WRITE_SCHEMA.split(", ")]).write.format("warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{workspace(spark, 'warc')}/pages"
    write_pages(read_table(spark, sf_dir, "pages"), folder)
    back = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    # A response's figures come from the payload that was read, a revisit's from its headers.
    held = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(held, base32_of(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


QUERIES = {"op7_warc": op7_warc}
_GROUP = "CAST('0x' || substr(h, {}, 10) AS BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_GROUP.format(1 + 10 * g)} >> {5 * (7 - i)}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for i in range(8))
ORACLE = {
    "op7_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
}
