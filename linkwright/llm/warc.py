"""WARC archives (operator 7): writing, reading, and transaction assembly.

``write_archive`` gives each page a request, a response (or a revisit of an equal payload) and a metadata record, and
writes them as WARC/1.1 files: Spark's text writer with the record separator as line ending makes plain WARC, here
compressed as a whole file. ``read_archive`` parses such files record by record, and ``assemble`` joins the records of a
transaction, request and metadata naming their response by WARC-Concurrent-To, into one nested row per capture.

Defined results: a null html is an empty payload; a null url an empty target URI; rows with equal ids are captures of their
own; of equal payloads the smallest id, nulls last, is the response, ties by a fixed hash of the row; an empty table gives
an empty archive and no captures; other columns are not read. Payloads that a third of the pages share are no hot group:
digests are counted before the shuffle, those of more than a thousandth of the rows, at most a thousand, are broadcast, and
only the rows of others are dealt by digest. Archives are inflated and parsed as a stream, a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.common import shared_folder, written

BREAK = "\r\n\r\n"  # ends a WARC record's block
MIN_BYTES = 0  # payloads from this size on are stored once
PIECE = 8_000_000  # bytes of an archive that a reader inflates, and of payloads that it sends on, at a time
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, content_type string, block_digest_ok boolean, block binary"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string or binary column."""
    hexed = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0")  # noqa: E731  40 bits are 8 digits
    return F.translate(F.concat(*map(part, (1, 11, 21, 31))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, own_id: Column, headers: dict[str, Column], content_type: str, block: Column) -> Column:
    """A record's text up to its separator."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), own_id, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n")]
    for name, value in headers.items():
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    lines += [F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK), block]
    return F.concat(*lines)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One column ``value``: the text of each record of the archive."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("url", F.regexp_replace("url", r"[\x00-\x20\x7F]", ""))
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", "page_id", "url", "digest", "row")))
    urn = lambda kind: F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.col("key"), F.lit(kind))), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    rows = rows.withColumn("own", urn("response")).withColumn("large", F.octet_length("html") >= min_bytes)
    # The first capture of each payload that occurs again; one row a digest and task is shuffled.
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "key", "own"))["own"].alias("first")
    found = rows.where("large").groupBy(F.col("digest").alias("of")).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = looked_up(rows, F.when(F.col("large"), F.col("digest")), F.col("own"), found)
    digest, uri, own = F.concat(F.lit("sha1:"), "digest"), {"WARC-Target-URI": F.col("url")}, F.concat(F.lit("<"), "own", F.lit(">"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BREAK)
    kept = record("response", F.col("own"), uri | {"WARC-Payload-Digest": digest}, "application/http; msgtype=response", F.concat(http, "html"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    refers = {"WARC-Payload-Digest": digest, "WARC-Profile": profile, "WARC-Refers-To": F.concat(F.lit("<"), "first", F.lit(">"))}
    again = record("revisit", F.col("own"), uri | refers, "application/http; msgtype=response", http)
    asked = record("request", urn("request"), uri | {"WARC-Concurrent-To": own}, "application/http; msgtype=request", F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1" + BREAK)))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    fields = F.concat(F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    about = record("metadata", urn("metadata"), uri | {"WARC-Concurrent-To": own}, "application/warc-fields", fields)
    return rows.select(F.explode(F.array(asked, F.when(F.col("first").isNull() | (F.col("first") == F.col("own")), kept).otherwise(again), about)).alias("value"))


def looked_up(rows: DataFrame, key: Column, spread: Column, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` (of, n: how many rows have that key, and more), null where a row's key has none.

    Keys of more than a thousandth of the rows counted, of which there are less than a thousand, are broadcast. Their rows, and
    those without a key, are dealt by ``spread``, which differs from row to row.
    """
    names = [c for c in found.columns if c not in ("of", "n")]
    total = F.broadcast(found.agg(F.sum("n").alias("_total")))
    common = found.crossJoin(total).where(F.col("n") * 1000 > F.col("_total")).select(F.col("of").alias("_common"), *[F.col(c).alias(f"_{c}") for c in names])
    own = rows.withColumn("_key", key).join(F.broadcast(common), F.col("_key") == F.col("_common"), "left")
    own = own.withColumn("_key", F.when(F.col("_key").isNotNull() & F.col("_common").isNull(), F.col("_key")).otherwise(F.concat(F.lit("-"), spread)))
    out = own.join(found.drop("n"), F.col("_key") == F.col("of"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in names])


def write_archive(pages: DataFrame, path: str, records_per_file: int = 6000, **options) -> None:
    """Writes WARC files under ``path``."""
    records(pages, **options).write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(data: memoryview) -> Iterator[bytes]:
    """An archive's bytes in pieces: gzip members, of which a file may hold many, or plain."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[at : at + PIECE]) for at in range(0, len(data), PIECE))
        return
    member, rest = zlib.decompressobj(31), b""
    for at in range(0, len(data), PIECE // 8):
        rest = bytes(data[at : at + PIECE // 8])
        while rest:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(rest, PIECE)
            rest = member.unused_data if member.eof else member.unconsumed_tail
    if not member.eof:
        raise ValueError("the archive ends within a gzip member")


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive: (headers by lower-case name, block), whatever their blocks hold."""
    held, at, gone = bytearray(), 0, 0  # bytes that aren't parsed yet, from ``at`` on; bytes that were dropped

    def more() -> bool:
        nonlocal at, gone
        piece = next(filter(None, pieces), None)
        if piece is None:
            return False
        gone += at
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while at < len(held) or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                raise ValueError(f"no WARC record at byte {gone + at}")
        if not held.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {gone + at}")
        headers = {}
        for line in held[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        begin, length = end + 4 - at, int(headers["content-length"])
        while len(held) - at < begin + length + 4:
            if not more():
                raise ValueError(f"the record at byte {gone + at} is cut off")
        block = bytes(held[at + begin : at + begin + length])
        if held[at + begin + length : at + begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {gone + at} isn't ended by a blank line")
        at += begin + length + 4
        yield headers, block


def sha1_name(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``; block is the payload, without HTTP headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(inflated(memoryview(content.as_buffer()))):
                    ref = lambda k: headers.get(k, "").strip("<>") or None  # noqa: B023, E731
                    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                    digest = headers.get("warc-payload-digest")
                    good = sha1_name(payload) == digest if digest and headers["warc-type"] == "response" else None
                    names = ref("warc-record-id"), headers["warc-type"], ref("warc-concurrent-to"), ref("warc-refers-to")
                    rows.append((*names, headers.get("warc-target-uri"), headers.get("warc-date"), digest, headers.get("content-type"), good, payload))
                    size += len(payload)
                    if len(rows) == 512 or size > PIECE:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows):
        kinds = [pa.string()] * 8 + [pa.bool_(), pa.binary()]
        names = [f.strip().split()[0] for f in RECORDS.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: response (a response or revisit record), request and metadata (null where there is none)."""
    names = [c for c in found.columns]
    nest = lambda kind: found.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias(f"_{kind}")).agg(F.min(F.struct(*names)).alias(kind))
    main = found.where(F.col("type").isin("response", "revisit")).select(F.struct(*names).alias("response"))
    for kind in ("request", "metadata"):  # a transaction has one of each; of several the smallest is taken
        main = main.join(nest(kind), F.col("response.record_id") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    return main


def digest(pages: DataFrame) -> DataFrame:
    """What the query op7 returns: the archive is written, read back and assembled."""
    spark, path = pages.sparkSession, shared_folder(pages.sparkSession)
    write_archive(pages, path)
    # What isn't asked for needn't be shuffled: blocks of responses are measured where they are parsed.
    found = read_archive(spark, path)
    shown = F.when(F.col("type") == "metadata", F.col("block"))
    own = lambda c: F.when(F.col("type") == "response", c)
    found = found.withColumns({"bytes": own(F.octet_length("block")), "digest": own(base32_sha1(F.col("block")))}).withColumn("block", shown)
    all_ = assemble(found.select("record_id", "type", "concurrent_to", "refers_to", "payload_digest", "bytes", "digest", "block"))
    text = F.decode(F.col("metadata.block"), "UTF-8")
    got = all_.select(
        F.regexp_extract(text, r"page-id: ([^\r]*)", 1).alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.record_id").alias("own"), F.col("response.refers_to").alias("to"),
        F.col("response.bytes").cast("long").alias("own_bytes"), F.col("response.digest").alias("own_digest"),
    )
    got = written(got)  # a small row a page, which is read three times
    # A revisit's payload is that of the response it refers to.
    target = got.where("record_type = 'response'").select(F.col("own").alias("of"), F.col("page_id").alias("of_page"), F.col("own_bytes").alias("of_bytes"), F.col("own_digest").alias("of_digest"))
    asked = got.where(F.col("to").isNotNull()).groupBy("to").agg(F.count(F.lit(1)).alias("n"))
    out = looked_up(got, F.col("to"), F.col("own"), target.join(asked, F.col("of") == F.col("to")).drop("to"))
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast(kind))
    size, name = F.coalesce("own_bytes", "of_bytes").alias("payload_bytes"), F.coalesce("own_digest", "of_digest").alias("payload_digest")
    return out.select(number("page_id").alias("page_id"), size, name, "record_type", number("of_page").alias("refers_to"))
