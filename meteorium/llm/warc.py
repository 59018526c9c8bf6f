"""Web archives: pages written as WARC records, read back, and indexed as capture histories.

Writing: equal payloads are found by their SHA-256; the first row of a group, by id, then address, is the ``response`` with the payload and
the others are ``revisit`` records that refer to it.  Records are Column expressions; Spark's text writer puts them one after another into
gzipped WARC/1.1 files, with the blank lines that end a record as its separator.  Reading: files stream through one task each in pieces,
records are cut by their Content-Length, so payloads may hold any bytes, and SHA-1 digests are worked out again.

Index: the captures that a task has read are sorted locally by address key, time and record id into a run.  Runs are merged by loser trees,
``FAN_IN`` runs at a time until no more than that are left; the last merge runs range by range between fences of the key, so a host or an
address with a third of all captures spreads over ranges, and its output stands in global order of (range_no, place).

Edge cases: a null payload counts as empty; rows without an id, or that repeat one, are records of their own, and null ids come last among
equals; a null address leaves out the target header and sorts first under an empty key; line ends in addresses are written as %0D and %0A;
an empty table gives an empty archive and index; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import runs

#: What stands between the parts of a record and after it.
BLANK = "\r\n\r\n"
#: Most records of one file; runs merged at once; captures of one range of the last merge, and the most ranges.
FILE_RECORDS, FAN_IN, RANGE_ROWS, RANGES = 20_000, 128, 200_000, 20_000
#: Captures of a sampled block for which one key is drawn to place the fences.
SAMPLED = 256
#: Equal rows that are written out at once.
STEP = 10_000
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

KEY = ["url_key", "captured", "record_id"]
_READ = ("file string, offset long, size long, record_type string, page_id long, record_id string, url string, captured string, payload_digest string, "
         "payload_bytes long, refers_to long, refers_to_record string, intact boolean")
_INDEX = _READ + ", url_key string"
_FIRST = ", ".join(f"{n} string" for n in KEY)


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), *BASE32)


def url_key(url: Column) -> Column:
    """Sort key of an address: host labels from the right, lower-cased, then port, path and query; without scheme and fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$|^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?:]*", 0))
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?:]*", "")))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None) -> DataFrame:
    """id, url, payload (bytes), captured (ISO text) and content (SHA-256) of each page.

    ``captured`` is the time in seconds since 1970.  Without one, ids stand for seconds (modulo 10^9), so that histories have an order.
    """
    seconds = captured if captured is not None else F.pmod(F.coalesce(F.col(id_col), F.lit(0)).cast("long"), F.lit(1_000_000_000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    left = F.pmod(seconds.cast("long"), F.lit(86400))
    clock = F.format_string("%02d:%02d:%02dZ", F.floor(left / 3600).cast("int"), F.floor(left / 60 % 60).cast("int"), (left % 60).cast("int"))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"), F.concat(day.cast("string"), F.lit("T"), clock).alias("captured"),
                        F.unhex(F.sha2(payload, 256)).alias("content"))


def _record_id(page: str, url: str, captured: str, content: str, copy: Column) -> Column:
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col(url), F.lit("")), F.col(captured), F.hex(content), copy.cast("string")), 256)
    return F.concat(F.lit("urn:capture:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.substring(name, 1, 32))


def _record(kind: str, refers_to: Column | None) -> Column:
    """A whole record but for the blank lines that end it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BLANK))
    block = F.concat(http.cast("binary"), F.col("payload")) if refers_to is None else http.cast("binary")
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), F.col("record_id"), F.lit(">\r\nWARC-Date: "), F.col("captured"),
            F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest")]
    if refers_to is not None:
        head += [F.lit("\r\nWARC-Refers-To: <"), refers_to, F.lit(f">\r\nWARC-Profile: {REVISIT_PROFILE}")]
    head += [F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK)]
    return F.concat(F.concat(*head).cast("binary"), block)


def records(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record per capture, as the text column ``value``; payloads below ``least_bytes`` are all written as responses."""
    narrow = rows.groupBy("id", "url", "captured", "content").agg(F.count(F.lit(1)).alias("times"), F.max(F.octet_length("payload")).cast("long").alias("bytes"),
                                                                   F.max(sha1_base32(F.col("payload"))).alias("digest"))
    narrow = materialize(narrow)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url", "captured")).alias("first")
    shared = narrow.filter(F.col("bytes") >= least_bytes).groupBy("content").agg(first, F.sum("times").alias("copies")).filter("copies > 1")
    shared = materialize(shared.select("content", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.captured").alias("first_captured")))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("captured") == F.col("first_captured"))

    again = narrow.join(shared, "content").withColumn("leads", is_first)
    again = again.withColumn("from", F.when(F.col("leads"), 1).otherwise(0).cast("long")).filter(F.col("times") > F.col("from"))
    again = again.withColumn("step", F.explode(F.sequence(F.col("from"), F.col("times") - 1, F.lit(STEP).cast("long"))))
    again = again.withColumn("copy", F.explode(F.sequence(F.col("step"), F.least(F.col("step") + STEP, F.col("times")) - 1)))
    again = again.withColumn("record_id", _record_id("id", "url", "captured", "content", F.col("copy")))
    revisits = again.select(_record("revisit", _record_id("first_id", "first_url", "first_captured", "content", F.lit(0))).alias("value"))

    whole = rows.join(shared, "content", "left").filter(F.col("first_captured").isNull() | is_first)
    repeated = materialize(narrow.filter("times > 1").join(shared, "content").filter(is_first).select("content"))
    if not repeated.isEmpty():  # the row that leads stands there more than once
        once = whole.join(repeated, "content", "left_semi").dropDuplicates(["content"])
        whole = whole.join(repeated, "content", "left_anti").unionByName(once)
    whole = whole.withColumn("bytes", F.octet_length("payload")).withColumn("digest", sha1_base32(F.col("payload")))
    copy = F.lit(0) if least_bytes <= 0 else F.when(F.col("bytes") < least_bytes, F.monotonically_increasing_id()).otherwise(0)
    whole = whole.withColumn("record_id", _record_id("id", "url", "captured", "content", copy))
    return whole.select(_record("response", None).alias("value")).unionByName(revisits).select(F.col("value").cast("string").alias("value"))


def write_archives(rows: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS) -> str:
    """Write captures as gzipped WARC files into a folder that all executors reach."""
    (records(rows, least_bytes).write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path))
    return path


class _Parser:
    """Records of one file, from its bytes in pieces."""

    def __init__(self, file: str):
        self.file, self.held, self.offset, self.head, self.body = file, bytearray(), 0, None, 0

    def feed(self, piece: bytes) -> Iterator[dict]:
        self.held += piece
        while True:
            if self.head is None:
                skip = len(self.held) - len(self.held.lstrip(b"\r\n"))
                del self.held[:skip]
                self.offset += skip
                end = self.held.find(BLANK.encode())
                if end < 0:
                    return
                lines = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{self.file}: no WARC record at {self.offset}")
                self.head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                self.body = end + 4
            size = self.body + int(self.head["content-length"])
            if len(self.held) < size:
                return
            yield _fields(self.file, self.offset, size, self.head, bytes(memoryview(self.held)[self.body:size]))
            del self.held[:size]
            self.offset += size
            self.head = None

    def ended(self) -> None:
        if self.held.strip(b"\r\n"):
            raise ValueError(f"{self.file}: the last record is cut off at {self.offset}")


def _id_in(record: str | None) -> int | None:
    page = record.split(":")[2] if record and record.startswith("urn:capture:") else ""
    return int(page) if page else None


def _fields(file: str, offset: int, size: int, head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(BLANK.encode()) if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    lengths = [line.split(b":", 1)[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    record, other, kind = head["warc-record-id"].strip("<>"), head.get("warc-refers-to"), head["warc-type"]
    other, digest = other.strip("<>") if other else None, head.get("warc-payload-digest", "").removeprefix("sha1:")
    whole = kind != "revisit"
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else digest
    return {"file": file, "offset": offset, "size": size, "record_type": kind, "page_id": _id_in(record), "record_id": record, "url": head.get("warc-target-uri"),
            "captured": head.get("warc-date", ""), "payload_digest": found, "payload_bytes": len(payload) if whole or not lengths else int(lengths[0]),
            "refers_to": _id_in(other), "refers_to_record": other, "intact": found == digest}


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (part.split() for part in ddl.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped WARC files of a folder; a damaged file fails, a wrong digest makes ``intact`` false."""
    schema = _arrow(_READ)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out = None, []
        for batch in batches:
            for file, piece in zip(batch["file"], batch["piece"]):
                file = file.as_py()
                if parser is None or parser.file != file:
                    if parser is not None:
                        parser.ended()
                    parser = _Parser(file)
                out += parser.feed(piece.as_py() + BLANK.encode())
                if len(out) >= runs.BLOCK:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if parser is not None:
            parser.ended()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    pieces = spark.read.option("lineSep", BLANK).text(path)  # gzipped files are not split: a task sees each file whole and in order
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(parse, _READ)


def _block(rows: pa.RecordBatch, **numbers: int) -> dict:
    first = {n: rows[n][0].as_py() for n in KEY}
    return numbers | first | {"rows": rows.num_rows, "body": runs.pack(rows)}


def sorted_runs(found: DataFrame) -> DataFrame:
    """run, first key, rows and body: each task's captures, sorted locally and cut into blocks."""
    ddl = f"run int, {_FIRST}, rows long, body binary"
    schema, rows_schema = _arrow(ddl), _arrow(_INDEX)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, runs.BLOCK):
                rows = pa.RecordBatch.from_arrays([batch[n].cast(rows_schema.field(n).type) for n in rows_schema.names], schema=rows_schema)
                yield pa.RecordBatch.from_pylist([_block(rows.slice(start, runs.BLOCK), run=run)], schema=schema)

    keyed = found.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*KEY)
    return keyed.mapInArrow(pack, ddl)


def _grouped(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Number and unpacked blocks of each group; groups stand together."""
    rows = ((batch[number][k].as_py(), batch["body"][k].as_py()) for batch in batches for k in range(batch.num_rows))
    row = next(rows, None)
    while row is not None:
        at = row[0]

        def of_group() -> Iterator[pa.RecordBatch]:
            nonlocal row
            while row is not None and row[0] == at:
                yield runs.unpack(row[1])
                row = next(rows, None)
        yield at, of_group()


def merged_runs(blocks: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Longer runs, each merged from ``fan_in`` runs."""
    ddl = f"run int, {_FIRST}, rows long, body binary"
    schema = _arrow(ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, group in _grouped(batches, "run"):
            for rows in runs.merge(group, KEY):
                for start in range(0, rows.num_rows, runs.BLOCK):
                    yield pa.RecordBatch.from_pylist([_block(rows.slice(start, runs.BLOCK), run=run)], schema=schema)

    longer = blocks.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    n = longer.agg(F.max("run")).first()[0] + 1
    return longer.repartition(n, "run").sortWithinPartitions("run", *KEY).mapInArrow(merge, ddl)


def histories(found: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures with url_key, range_no and place, in global order of (range_no, place): by address key, time and record id."""
    blocks = materialize(sorted_runs(found))
    while (blocks.agg(F.max("run")).first()[0] or 0) >= fan_in:
        blocks = materialize(merged_runs(blocks, fan_in))
    size = blocks.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("blocks")).first()
    ranges = max(1, min(RANGES, (size["rows"] or 0) // range_rows + 1))
    share = min(1.0, 50 * ranges / max(1, size["blocks"]))  # the sample only balances the ranges

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch["body"]:
                rows = runs.unpack(body.as_py())
                at = random.Random(rows.num_rows).choices(range(rows.num_rows), k=1 + rows.num_rows // SAMPLED)
                yield rows.select(KEY).take(pa.array(at))

    points = blocks.filter(F.rand(5) <= share).mapInArrow(draw, _FIRST).collect() if ranges > 1 else []
    fences = runs.quantile_fences([tuple(p) for p in points], ranges)
    ddl = f"range_no int, {_FIRST}, rows long, body binary"
    schema, out_ddl = _arrow(ddl), f"range_no int, place long, {_INDEX}"
    out_schema = _arrow(out_ddl)

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch["body"]:
                rows = runs.unpack(body.as_py())
                parts = [_block(part, range_no=k) for k, part in runs.cut(rows, runs.keys_of(rows, KEY), fences)]
                yield pa.RecordBatch.from_pylist(parts, schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for range_no, group in _grouped(batches, "range_no"):
            place = 0
            for rows in runs.merge(group, KEY):
                numbers = [pa.array([range_no] * rows.num_rows, pa.int32()), pa.array(range(place, place + rows.num_rows), pa.int64())]
                yield pa.RecordBatch.from_arrays(numbers + rows.columns, schema=out_schema)
                place += rows.num_rows

    cut = blocks.mapInArrow(to_ranges, ddl).repartition(len(fences) + 1, "range_no").sortWithinPartitions("range_no", *KEY)
    return cut.mapInArrow(merge, out_ddl)


def unresolved(found: DataFrame) -> DataFrame:
    """Revisit records whose response, by record id and digest, is not in the archives."""
    there = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), "payload_digest", F.lit(True).alias("there"))
    return found.filter("record_type = 'revisit'").join(there, ["refers_to_record", "payload_digest"], "left_anti")


def archive_index(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **columns) -> DataFrame:
    """Pages written as archives, read back, and merged into capture histories."""
    spark = pages.sparkSession
    path = write_archives(captures(pages, **columns), path or scratch_path(spark, "warc"), least_bytes)
    return histories(read_archives(spark, path))
