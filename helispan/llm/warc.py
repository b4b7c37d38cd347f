"""WARC archives of pages, and their reading by byte ranges with boundary-chain verification.

Writing. Equal payloads are found by size and SHA-1; that of the page with the largest id is a response
record, others revisit it and hold no payload. Each task writes one archive: records are rows of
Spark's text writer, whose line break is the last byte of the two empty lines that end a record.

Reading. Archives are dealt in ranges of RANGE bytes. A task looks in its range for the magic of a record
after an empty line and for a header that gives the length of its block; where another empty line
ends that block, the place is a candidate, and its successor begins behind it. Payloads may hold whole
records, so candidates are not yet records. Within its range a task follows successors, and it
emits for each candidate the first place beyond the range. By pointer jumping from the start of
each file, a round doubling the distance, the places where the true chain enters ranges are found;
what the chain does not reach lies inside payloads. From the entry of its range a task then reads
the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches
from helispan.llm.lookup import lookup
from helispan.session import finished, materialize, shared_path

#: Bytes of a range.
RANGE = 1 << 20
#: Payloads with fewer bytes are never told as revisits.
MIN_REVISIT = 0
#: Ranges of a task at least, as long as all cores have some.
TASK_RANGES = 64
#: Bytes of blocks in a batch that a task returns.
BATCH_BYTES = 4 << 20

MAGIC = b"WARC/1."
BREAK = b"\r\n"
EMPTY = BREAK * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16

PLACE = "path string, at long, next long"
RECORD = "path string, at long, record_type string, record_id string, target_uri string, refers_to string, digest string, http_length long, payload binary"


def base32(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 given in hexadecimal: four times ten digits are eight digits each."""
    digits = [F.lpad(F.conv(F.substring(hexadecimal, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _lines(*parts: Column) -> Column:
    """Header lines, each with its break; null ones are left out, and an empty line ends them."""
    return F.concat(F.concat_ws("\r\n", *parts), F.lit("\r\n\r\n"))


def write_pages(pages: DataFrame, path: str, least: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each row of ``pages`` (page_id, url, html) in archives below ``path``.

    Null html is an empty payload. Of equal payloads of at least ``least`` bytes, that with the largest
    page_id is a response and the others revisit it; rows that repeat that page_id with that payload are
    the same page and responses too, as are all where no row has an id. A null id is an empty one and
    never the largest. Line breaks in a url are percent-encoded; a null url has no line. Other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    seen = own.where(F.col("bytes") >= least).groupBy("bytes", "sha").agg(F.max("page_id").alias("first"), F.count("*").alias("rows"))
    shared = materialize(seen.where("rows > 1 and first is not null"), "payloads")
    told = lookup(own, shared, ["bytes", "sha"], "rows", pages.count())
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), line("Content-Length", F.col("bytes").cast("string")))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    head = _lines(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length("http") + F.octet_length("body")).cast("string")),
    )
    records = told.withColumn("http", http).withColumn("body", body).select(F.concat(head, "http", "body", F.lit("\r\n\r")).alias("value"))
    records.write.option("lineSep", "\n").text(path)


class _File:
    """Bytes of a file by place, read in steps and held around the last place."""

    def __init__(self, path: str) -> None:
        # Hadoop writes local paths with one slash.
        local = re.sub(r"^file:/+", "/", path)
        system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def read(self, at: int, count: int) -> bytes:
        """``count`` bytes from ``at``, fewer at the end of the file."""
        if not self.start <= at <= at + count <= self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(max(0, min(max(count, _STEP), self.size - at)), at)
        return self.held[at - self.start : at - self.start + count]

    def line(self, at: int) -> bytes | None:
        """The line that begins at ``at``, without its break; None if none ends."""
        count = 256
        while True:
            found = self.read(at, count)
            k = found.find(BREAK)
            if k >= 0:
                return found[:k]
            if len(found) < count:
                return None
            count *= 2

    def header(self, at: int) -> tuple[dict[str, str], int] | None:
        """Fields of the header at ``at``, by name in small letters, and where its block begins; None if it is none."""
        first = self.line(at)
        if first is None or not first.startswith(MAGIC):
            return None
        fields: dict[str, str] = {}
        name, at = "", at + len(first) + 2
        while (line := self.line(at)) != b"":
            if line is None or not (line[:1] in b" \t" and name or b":" in line):
                return None
            if line[:1] in b" \t":
                fields[name] += " " + line.decode("utf-8", "replace").strip()
            else:
                label, _, value = line.decode("utf-8", "replace").partition(":")
                name = label.strip().lower()
                fields[name] = value.strip()
            at += len(line) + 2
        return fields, at + 2

    def record(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, begin of the block and its length, if a header is at ``at`` and an empty line ends its block."""
        found = self.header(at)
        length = found and found[0].get("content-length", "")
        if not length or not re.fullmatch(r"[0-9]{1,18}", length):
            return None
        end = found[1] + int(length)
        return (*found, int(length)) if end + 4 <= self.size and self.read(end, 4) == EMPTY else None


def candidates_of(file: _File, start: int, end: int) -> list[tuple[int, int]]:
    """``at, next`` for the candidates in a range: ``next`` is the first place on the way of successors that is no candidate of the range."""
    back = min(start, len(EMPTY))
    data = file.file.read_at(end - start + back + len(MAGIC) - 1, start - back)
    found, k = [], data.find(MAGIC)
    while k >= 0:
        at = start - back + k
        if at >= start and (at == 0 or data[k - 4 : k] == EMPTY):
            record = file.record(at)
            if record:
                found.append((at, record[1] + record[2] + len(EMPTY)))
        k = data.find(MAGIC, k + 1)
    beyond: dict[int, int] = {}
    for at, after in reversed(found):
        beyond[at] = beyond.get(after, after)
    return sorted(beyond.items())


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(count, max(2 * cores, count // TASK_RANGES))))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the archives below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``path, at, next`` for each candidate, as in ``candidates_of``."""
    ranges = files_of(spark, path).where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    step = RANGE

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = candidates_of(_File(name), start, min(start + step, length))
                at, after = ([r[i] for r in rows] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(at, pa.int64()), pa.array(after, pa.int64())], names=["path", "at", "next"])

    return _dealt(ranges, ranges.count()).mapInArrow(emit, PLACE)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``path, at``: where the chain from the start of each file enters its ranges, and the end of the file if it comes there."""
    found = materialize(candidates(spark, path), "candidates")
    entered = found.select("path", F.col("next").alias("at")).distinct()
    first = found.where("at = 0").select("path", "at")
    nodes = first.join(found, ["path", "at"]).unionByName(found.where("at > 0").join(entered, ["path", "at"], "left_semi"))
    jump, reach = materialize(nodes, "jump"), first
    while not jump.isEmpty():
        step = jump.select("path", "at", F.col("next").alias("to"))
        reach = materialize(reach.unionByName(reach.join(step, ["path", "at"]).select("path", F.col("to").alias("at"))), "reach")
        onward = jump.select("path", F.col("at").alias("to"), F.col("next").alias("after"))
        jump = materialize(step.join(onward, ["path", "to"]).select("path", "at", F.col("after").alias("next")), "jump")
    return reach


def verify(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, whole`` for each archive that is not empty: whether its chain comes to the end of the file."""
    ends = entries(spark, path).withColumn("whole", F.lit(True))
    files = files_of(spark, path)
    return files.join(ends, (files["path"] == ends["path"]) & (files["length"] == ends["at"]), "left").select(files["path"], "length", F.coalesce("whole", F.lit(False)).alias("whole"))


def _http(block: bytes) -> tuple[int | None, bytes]:
    """Length that a block's HTTP header tells, and its payload; a block without such a header is all payload."""
    end = block.find(EMPTY)
    if end < 0 or not block.startswith(b"HTTP/"):
        return None, block
    told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})", block[:end])
    return int(told[1]) if told else None, block[end + 4 :]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, by the columns of RECORD.

    An archive that breaks off or is damaged gives its records before that place (see ``verify``); an
    empty folder gives none. ``digest`` is what the header says, without ``sha1:``.
    """
    bound_batches(spark)
    starts = materialize(entries(spark, path), "entries")
    names = [f.split()[0] for f in RECORD.split(",")]
    step = RANGE

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = _File(name)
                end = (at // step + 1) * step
                while at < min(end, file.size) and (found := file.record(at)):
                    fields, begin, length = found
                    told, payload = _http(file.read(begin, length))
                    kind = fields.get("warc-type")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    held.append((name, at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, told, payload))
                    at = begin + length + len(EMPTY)
                    size += length
                    if size >= BATCH_BYTES:
                        yield _batch(held, names)
                        held, size = [], 0
        yield _batch(held, names)

    return _dealt(starts, starts.count()).mapInArrow(rows, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _page(urn: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def digest(records: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response come from its payload, those of a revisit from its headers.
    """
    response = F.col("record_type") == "response"
    return records.where("record_type in ('response', 'revisit')").select(
        _page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, base32(F.sha1("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(~response, _page("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' records in the shared folder and read them back; the archives go when the result is written."""
    spark = pages.sparkSession

    def build() -> DataFrame:
        path = shared_path(spark, "warc")
        write_pages(pages, path)
        return digest(read_records(spark, path))

    return finished(spark, build, "warc-pages")
