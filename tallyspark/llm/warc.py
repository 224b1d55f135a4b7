"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

**Files.** Every record is a gzip member of its own, so a reader can begin at any of them. A task
writes one archive under a name of its own attempt and returns that name; the names of the tasks
that count are stored as the archive's index, so what a lost or repeated attempt left behind is
never read.

**Writer.** Rows with equal payloads (by SHA-256 and length) share one ``response`` record, that
of the greatest key; the others are ``revisit`` records that refer to it, by the profile
*identical-payload-digest*. Only payloads that occur twice or more are looked up, in a join that
Spark can split where very many rows share one payload.

**Reader.** Files are cut into byte ranges of any length. A task scans its range for the gzip
magic, validates a candidate by decoding its member up to the end of the first record's header,
and then reads member by member; it owns the records that begin inside its range, and reads the
last one past its end. A stored (incompressible) payload may itself hold an archive, whose members
look real to a task that begins inside it. So every range also reports where it began and ended,
and ranges that do not begin where the ones before ended are read anew from there.
"""

from __future__ import annotations

import base64
import datetime as _dt
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship_package, slices, stored, task_memory
from tallyspark.session import shared_dir

RANGE = 16 << 20            # bytes of a file read by one task
CHUNK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY, REFERS_KEY, LENGTH = "WARC-X-Key", "WARC-X-Refers-To-Key", "WARC-X-Payload-Length"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\nContent-Length: {}\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def clean(value: str) -> str:
    """A value that stays on its header line."""
    return " ".join(value.splitlines()).strip()


def record(kind: str, block: bytes, headers: dict) -> bytes:
    """One record as a gzip member. Headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{k}: {clean(str(v))}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n")


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest}')}>"


def parse_headers(data: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields of a block of header lines; folded lines continue the one before."""
    first, *lines = data.decode("utf-8", "surrogatepass").split("\r\n")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last is not None:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip()
            out[last] = value.strip()
    return first, out


def field(headers: dict[str, str], name: str) -> str | None:
    """A field by its name in any case."""
    if name in headers:
        return headers[name]
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def records_of(data: bytes):
    """(headers, block) of the records in a decoded member (one by the standard)."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        headers = parse_headers(data[at:end])[1]
        size = int(field(headers, "Content-Length"))
        at = end + 4 + size
        if at > len(data):
            raise ValueError("a WARC record is longer than its member")
        yield headers, data[end + 4:at]
        while data.startswith(b"\r\n", at):
            at += 2


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP header of a captured message."""
    if (field(headers, "Content-Type") or "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Bytes:
    """A file read forward in chunks, from any offset."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size = source, size
        self.at, self.held = at, b""               # offset of held[0]

    def more(self) -> bool:
        start = self.at + len(self.held)
        if start >= self.size:
            return False
        self.source.seek(start)
        self.held += self.source.read(min(CHUNK, self.size - start))
        return True

    def skip(self, n: int) -> None:
        self.at, self.held = self.at + n, self.held[n:]


def starts_record(source, size: int, at: int) -> bool:
    """Whether a member begins at ``at`` that decodes to a record, to the end of its header."""
    z, out = zlib.decompressobj(31), b""
    data = Bytes(source, size, at)
    while not z.eof and data.more():
        try:
            out += z.decompress(data.held, CHUNK)
        except zlib.error:
            return False
        if not b"WARC/".startswith(out[:5]):
            return False
        if b"\r\n\r\n" in out:
            return True
        data.skip(len(data.held) - len(z.unconsumed_tail))
    return b"\r\n\r\n" in out


def find_start(source, size: int, a: int, z: int) -> int | None:
    """Offset of the first record that begins in ``[a, z)``."""
    data = Bytes(source, size, a)
    while data.at < z:
        spot = data.held.find(MAGIC)
        if spot < 0:
            data.skip(max(0, len(data.held) - len(MAGIC) + 1))
            if not data.more():
                return None
            continue
        data.skip(spot)
        if data.at < z and starts_record(source, size, data.at):
            return data.at
        data.skip(1)
    return None


def read_members(source, size: int, at: int, z: int):
    """(offset, next offset, decoded bytes) of the members from ``at`` on that begin before ``z``."""
    data = Bytes(source, size, at)
    while data.at < z:
        start, gz, out = data.at, zlib.decompressobj(31), []
        while not gz.eof:
            if not data.held and not data.more():
                raise ValueError(f"a member at byte {start} does not end")
            out.append(gz.decompress(data.held))
            data.skip(len(data.held) - len(gz.unused_data))
        # padding of zeros between members, as some writers leave
        while data.held.startswith(b"\0") or not data.held and data.more():
            data.skip(len(data.held) - len(data.held.lstrip(b"\0")))
        yield start, data.at, b"".join(out)


def open_at(path: str):
    """(file system, path in it) of a path or uri that the tasks can reach."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/")
                                        and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def write_warc(rows: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
               min_bytes: int = 0, date: _dt.datetime | None = None,
               content_type: str = "text/html; charset=utf-8") -> None:
    """A record for every row, in archives in the folder ``path``.

    Of rows whose equal payloads have ``min_bytes`` or more, that of the greatest key is a
    ``response`` and the others ``revisit`` it; smaller payloads are all responses. Rows that repeat
    that key and payload are responses too. A null key is smaller than any other; where all are
    null, all are responses. A null payload is empty, a null url leaves its field out, other
    columns are not looked at; line breaks in a url become spaces. An empty table writes no archive.
    """
    ship_package(rows.sparkSession)
    made = (date or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    kinds = dict(rows.dtypes)
    body = F.coalesce(F.col(f"`{payload}`").cast("string").cast("binary") if kinds[payload] != "binary"
                      else F.col(f"`{payload}`"), F.lit(b""))
    order = F.col(f"`{key}`") if kinds[key] != "void" else F.lit(None).cast("string")
    src = rows.select(order.alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"))
    same = F.concat_ws(":", F.octet_length("body"), F.sha2("body", 256))
    src = src.withColumn("same", F.when(F.octet_length("body") >= min_bytes, same))
    # Stored, so that both sides of the join are plain shuffles, of which Spark splits a payload
    # that very many rows share.
    repeated = stored(src.where("same is not null").groupBy("same").agg(
        F.count("*").alias("n"), F.max("key").alias("first")).where("n > 1").select("same", "first"),
        "repeated-payloads")
    told = src.join(repeated.hint("merge"), "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    told = told.select(F.col("key").cast("string"), "url", F.sha1("body").alias("sha1"),
                       F.octet_length("body").alias("size"), revisit.alias("revisit"),
                       F.col("first").cast("string").alias("first"),
                       F.when(~revisit, F.col("body")).alias("body"))

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        out, n = None, 0
        folder, base = open_at(path)
        with task_memory():
            for whole in batches:
                for b in slices(whole):
                    for r in b.to_pylist():
                        if out is None:
                            folder.create_dir(base, recursive=True)
                            out = folder.open_output_stream(f"{base}/{name}", compression=None)
                            out.write(record("warcinfo", b"format: WARC File Format 1.1\r\n", {
                                "WARC-Record-ID": record_id(name, ""), "WARC-Date": made, "WARC-Filename": name,
                                "Content-Type": "application/warc-fields"}))
                        digest = base32(r["sha1"])
                        headers = {"WARC-Record-ID": record_id(r["key"], digest), "WARC-Date": made,
                                   "WARC-Target-URI": r["url"], "WARC-Payload-Digest": f"sha1:{digest}",
                                   KEY: r["key"], LENGTH: r["size"],
                                   "Content-Type": "application/http;msgtype=response"}
                        if r["revisit"]:
                            headers |= {"WARC-Refers-To": record_id(r["first"], digest),
                                        "WARC-Profile": PROFILE, REFERS_KEY: r["first"]}
                        head = HTTP.format(content_type, r["size"]).encode()
                        out.write(record("revisit" if r["revisit"] else "response", head + (r["body"] or b""), headers))
                        n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])
    told.mapInArrow(write, "name string, n long").write.mode("overwrite").parquet(f"{path}/_index")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, size`` of the archives of a folder: those of its index, or of a folder without one all
    ``*.warc.gz``. An empty index gives none."""
    from pyspark.errors import AnalysisException
    try:
        named = spark.read.schema("name string, n long").parquet(f"{path}/_index")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        named = None
    if named is not None and named.isEmpty():
        return spark.createDataFrame([], "file string, size long")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
             .select(F.col("path").alias("file"), F.col("length").alias("size")))
    if named is not None:
        files = files.join(named.select("name"), F.element_at(F.split("file", "/"), -1) == F.col("name"),
                           "left_semi")
    return files


SCHEMA = ("kind string, file string, low long, at long, stop long, record_type string, record_id string, url string, "
          "date string, key string, refers_to string, refers_to_key string, payload_digest string, "
          "payload_bytes long, payload binary")


def read_ranges(ranges: DataFrame, payload: bool) -> DataFrame:
    """Rows of kind ``record`` for the records of (``file, size, low, high, start``) ranges, and one of
    kind ``range`` for each: where its records began and ended (null if it owns none). ``start`` is
    where to begin, or null to look for it."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [types[x.split()[1]] for x in SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)],
                                          names=names)

    def told(headers, block, row):
        body = payload_of(headers, block)
        kind = field(headers, "WARC-Type")
        digest = (field(headers, "WARC-Payload-Digest") or "").removeprefix("sha1:") or None
        size = field(headers, LENGTH)
        if kind != "revisit":
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if kind == "response" and digest not in (None, own):
                raise ValueError(f"{row['file']}: a payload does not have its digest {digest}")
            digest, size = own, len(body)
        return {"kind": "record", "record_type": kind, "record_id": field(headers, "WARC-Record-ID"),
                "url": field(headers, "WARC-Target-URI"), "date": field(headers, "WARC-Date"),
                "key": field(headers, KEY), "refers_to": field(headers, "WARC-Refers-To"),
                "refers_to_key": field(headers, REFERS_KEY), "payload_digest": digest,
                "payload_bytes": None if size is None else int(size), "payload": body if payload else None, **row}

    def run(batches):
        with task_memory():
            for b in batches:
                for r in b.to_pylist():
                    folder, base = open_at(r["file"])
                    with folder.open_input_file(base) as source:
                        start = r["start"]
                        if start is None:
                            start = 0 if r["low"] == 0 else find_start(source, r["size"], r["low"], r["high"])
                        rows, held, end = [], 0, None
                        try:
                            for at, end, data in (() if start is None else
                                                  read_members(source, r["size"], start, r["high"])):
                                for headers, block in records_of(data):
                                    rows.append(told(headers, block, {"file": r["file"], "low": r["low"], "at": at}))
                                held += len(data)
                                if held > 1 << 22 or len(rows) > 4096:
                                    yield batch(rows)
                                    rows, held = [], 0
                            start = None if end is None else start
                        except (ValueError, zlib.error) as e:
                            if r["start"] is not None or r["low"] == 0:
                                raise ValueError(f"{r['file']}, from byte {start}: {e}") from e
                            rows, start, end = [], -1, None      # looked real, was not
                        rows.append({"kind": "range", "file": r["file"], "low": r["low"], "at": start, "stop": end})
                        yield batch(rows)
    return ranges.mapInArrow(run, SCHEMA)


def read_warc(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The records of all archives in a folder: ``file, at`` (byte offset), ``record_type``, ids,
    ``url``, ``date``, ``key`` and ``refers_to_key`` of this writer's archives, digest and length of the
    payload, and with ``payload`` the payload itself (empty for revisits; see ``payloads``).

    Every record is read once, however ranges are cut, also where one is longer than a range or
    an archive lies inside a payload. Files are read with pyarrow's file systems (local, HDFS, S3,
    GCS). A damaged member or a payload that does not have its digest raises; a folder without
    archives gives an empty table.
    """
    ship_package(spark)
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = archive_files(spark, path).select("file", "size", F.explode(cut).alias("low")).where("size > 0")
    ranges = stored(ranges.select("*", F.least("size", F.col("low") + range_bytes).alias("high"),
                                  F.lit(None).cast("long").alias("start")), "warc-ranges")
    size = ranges.agg(F.count("*").alias("n"), F.sum(F.col("high") - F.col("low")).alias("bytes")).first()
    tasks = max(1, min(size.n, (size.bytes or 0) >> 20))       # short ranges share a task
    found = stored(read_ranges(ranges.repartition(tasks, "file", "low"), payload), "warc-records", ["kind"])
    whole = Window.partitionBy("file")
    before = whole.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        spans = found.where("kind = 'range'").select("file", "low", "at", "stop").join(
            ranges.drop("start"), ["file", "low"])
        # a range owns records exactly if the ones before end inside it, and then from there on
        spans = spans.withColumn("due", F.coalesce(F.max("stop").over(before), F.lit(0)))
        right = F.when(F.col("due") < F.col("high"), F.col("due")).eqNullSafe(F.col("at"))
        # a file's first wrong range, and where it is due: the ranges up to there are read anew
        first = F.min(F.when(~right, F.struct("low", "due"))).over(whole)
        wrong = stored(spans.withColumn("first", first)
                       .where((F.col("low") >= F.col("first.low")) & (F.col("low") <= F.col("first.due")))
                       .select("file", "size", "low", "high", F.col("first.due").alias("start")), "warc-wrong")
        if wrong.isEmpty():
            return found.where("kind = 'record'").drop("kind", "low", "stop")
        again = read_ranges(wrong.repartition("file", "low"), payload)
        found = stored(found.join(wrong, ["file", "low"], "left_anti").select(*found.columns)
                       .unionByName(again), "warc-records", ["kind"])


def payloads(records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits filled in from the responses they refer to."""
    whole = records.where("record_type = 'response'").groupBy("record_id").agg(F.first("payload").alias("of"))
    return (records.join(whole.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
            .withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("of")).otherwise(F.col("payload")))
            .select(*records.columns))


def op13_warc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    path = shared_dir(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_warc(spark, path, payload=False).where("record_type in ('response', 'revisit')").select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast(kind).alias("refers_to"))


def _base32_sql(hex_: str) -> str:
    """20 bits of the hex text at a time: four characters."""
    parts = []
    for i in range(8):
        n = f"CAST('0x' || substr({hex_}, {5 * i + 1}, 5) AS BIGINT)"
        parts += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({n} >> {s}) & 31), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, body, sha1(body) AS s, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32_sql("s")} AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
