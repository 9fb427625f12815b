"""WARC archives as a table of record chunks, written and read as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import staged

#: Bytes of a payload in one chunk, which is a WARC segment; a cut inside a character moves behind it.
CHUNK = 1 << 18
#: Payloads of so many bytes or more are stored once.
LEAST = 100
DATE = "2020-01-01T00:00:00Z"
#: Bytes of chunks sent on at once when reading.
FLUSH = 4 << 20

CHUNKS = (
    "page_id {id}, record_type string, refers_to {id}, chunk long, offset long, data binary,"
    " bytes_so_far long, sha256_so_far string, last boolean, payload_bytes long, payload_digest string, intact boolean"
)


def _line(value: Column) -> Column:
    """A header value stays on its line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def records(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK, least: int = LEAST,
) -> DataFrame:
    """One row per segment: ``value`` holds its WARC text but for the last line end.

    Payloads of ``least`` bytes or more are stored with the smallest id only; the
    others become revisit records that name it.  Digests are found first and only
    those that repeat are joined back, so equal payloads never meet in a task.
    An oversized payload becomes a record and continuation segments, one row each;
    chunk numbers are made first and each row takes its bytes, so nothing holds the
    chunks of a record together.
    Null payloads are empty; null ids are written without an id and never named;
    rows that repeat the named id are all responses.
    """
    p = pages.select(F.col(id).alias("i"), F.col(url).alias("u"), F.coalesce(html, F.lit("")).alias("h"))
    digest = F.sha2(F.col("h").cast("binary"), 256)
    firsts = p.where(F.octet_length("h") >= least).groupBy(digest.alias("fd")).agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).where("n > 1 and first is not null")
    firsts = staged(firsts.select("fd", "first"), "repeated")
    p = p.withColumn("d", digest).withColumn("b", F.octet_length("h").cast("long"))
    p = p.join(firsts, (F.col("d") == F.col("fd")) & (F.col("b") >= least), "left").withColumn(
        "refers", F.expr("if(i <=> first, null, first)"))
    p = p.withColumn("n", F.expr(f"if(refers is null, greatest(0, (b - 1) div {chunk}), 0) + 1"))
    p = p.select(
        F.coalesce(F.concat(F.lit("Page-Id: "), F.col("i").cast("string"), F.lit("\r\n")), F.lit("")).alias("page"),
        F.coalesce(F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">\r\n")), F.lit("")).alias("refers"),
        _line(F.col("u")).alias("u"), "d", "b", F.md5(F.concat_ws("|", F.col("i").cast("string"), "d")).alias("name"),
        "n", F.col("h").cast("binary").alias("octets")).select(
        "page", "refers", "u", "d", "b", "name", "n", "octets", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"))
    # a cut inside a character moves behind it; bytes are found by their place, so a chunk costs the same wherever it lies
    cut = "({0} + length(regexp_extract(hex(substring(octets, cast({0} + 1 as int), 3)), '^([89AB][0-9A-F])*', 0)) div 2)"
    start, end = cut.format(f"k * {chunk}"), cut.format(f"(k + 1) * {chunk}")
    p = p.withColumn("part", F.expr(
        f"if(refers <> '', '', cast(substring(octets, cast({start} + 1 as int), cast({end} - {start} as int)) as string))")).drop("octets")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("b"), F.lit("\r\n\r\n"))
    block = F.when(F.col("k") == 0, F.concat(http, "part")).otherwise(F.col("part"))
    p = p.withColumn("block", block)
    first = F.col("k") == 0
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(~first, "continuation").when(F.col("refers") != "", "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), "name", F.lit(":"), F.col("k") + 1, F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.when(first, F.concat(
            F.lit("WARC-Target-URI: "), "u", F.lit("\r\n"), "page", "refers",
            F.when(F.col("refers") != "", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
            F.lit("WARC-Payload-Digest: sha256:"), "d",
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\n"))).otherwise(
            F.concat(F.lit("WARC-Segment-Origin-ID: <urn:record:"), "name", F.lit(":1>\r\n"))),
        F.when(F.col("n") > 1, F.concat(F.lit("WARC-Segment-Number: "), F.col("k") + 1, F.lit("\r\n"))).otherwise(""),
        F.when((F.col("n") > 1) & (F.col("k") + 1 == F.col("n")), F.concat(
            F.lit("WARC-Segment-Total-Length: "), F.col("b") + F.octet_length(http), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Length: "), F.octet_length("block"), F.lit("\r\n\r\n"))
    return p.select(F.concat(head, "block", F.lit("\r\n")).alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Write archives, one compressed file per task, to any storage Spark can write."""
    records(pages, **options).write.option("compression", "gzip").option("lineSep", "\r\n").text(path)


class _Reader:
    """Turns the lines of an archive into chunk rows; holds one segment at most."""

    def __init__(self, payload: bool):
        self.payload = payload
        self.header: dict[str, str] | None = None
        self.record: dict | None = None
        self.need = -1  # bytes of the block still to come, while in a block
        self.block: list[bytes] = []

    def line(self, line: bytes) -> Iterator[list]:
        if self.need >= 0:
            if len(line) > self.need:
                raise ValueError("a block is longer than its Content-Length")
            self.block.append(line)
            if len(line) < self.need:
                self.block.append(b"\r\n")
                self.need -= len(line) + 2
                if self.need < 0:
                    raise ValueError("a block ends inside a line end")
                return
            self.need = -1
            yield from self.segment(b"".join(self.block))
            self.header, self.block = None, []
        elif self.header is None:
            if line.startswith(b"WARC/"):
                self.header = {}
            elif line:
                raise ValueError("no WARC record where one should begin")
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.header[name.strip().lower()] = value.strip()
        else:
            self.need = int(self.header["content-length"])

    def segment(self, block: bytes) -> Iterator[list]:
        h = self.header
        number = int(h.get("warc-segment-number", 1))
        if h["warc-type"] == "continuation":
            if self.record is None or self.record["chunk"] + 2 != number:
                raise ValueError("a continuation does not follow its record")
            r = self.record
        elif h["warc-type"] in ("response", "revisit"):
            http, _, block = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            refers = h.get("warc-refers-to")
            r = self.record = {
                "id": h.get("page-id"), "type": h["warc-type"], "refers": refers[len("<urn:page:"):-1] if refers else None,
                "size": size, "digest": h["warc-payload-digest"].removeprefix("sha256:"), "sha": hashlib.sha256(), "at": 0, "chunk": -1}
        else:
            return
        r["chunk"] += 1
        offset = r["at"]
        r["at"] += len(block)
        r["sha"].update(block)
        whole = r["type"] == "response"
        last = not whole or "warc-segment-total-length" in h or "warc-segment-number" not in h
        so_far = r["sha"].hexdigest()
        yield [r["id"], r["type"], r["refers"], r["chunk"], offset, block if self.payload else None, r["at"], so_far, last,
               r["size"], r["digest"], None if not last or not whole else r["at"] == r["size"] and so_far == r["digest"]]


def read(spark: SparkSession, path: str, payload: bool = True, id_type: str = "long") -> DataFrame:
    """The chunk table of archives that ``write`` made.

    One row per record and chunk number, with the bytes and the SHA-256 of the
    payload up to and including the chunk; ``intact`` tells on the last chunk of a
    response if length and digest agree with the header.  A revisit has one
    row without data; its payload length and digest are those it was written with.
    ``payload=False`` leaves the data out.  Lines are read by Spark, a compressed
    file by one task, and no more than one chunk is held.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary").alias("value"))
    schema = CHUNKS.format(id="string")
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(),
             pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = _Reader(payload), [], 0
        for lines in batches:
            for value in lines.column(0):
                for row in reader.line(value.as_py()):
                    rows.append(row)
                    size += 200 + len(row[5] or b"")
                if size >= FLUSH:
                    yield batch(rows)
                    rows, size = [], 0
        if reader.need >= 0 or reader.header is not None:
            raise ValueError("an archive ends inside a record")
        if rows:
            yield batch(rows)

    return lines.mapInArrow(run, schema).withColumns(
        {c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
