"""WARC archives: pages written as records, long ones in segments, and read back.

Writing is plain DataFrame work: each row becomes a response record whose block is an HTTP message in chunked transfer
framing, or, where another page has the same payload and a smaller id, a revisit record without a body that names the
payload by its digest (the profile identical-payload-digest). Blocks over SEGMENT bytes are cut into a first record and
continuation records. Records go to gzip files of RECORDS at most, so a file, read back as a whole, has a proven size
bound; a file is one gzip stream.

Reading parses each file once by the records' lengths, groups continuation records by origin identifier, orders them by
segment number, verifies the total length, decodes the chunked framing and checks the payload's digest.

Defined results: a null html is an empty payload; a null url has no target; a null page_id comes back null; a row that is
repeated has a record, with an identifier of its own, each time; of equal payloads the smallest page_id is the response,
at each of its rows; an empty table gives no archive and an empty result; columns other than page_id, url and html are
not archived. A very long page is written in segments and put together again in one task, which holds that page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RUN_BYTES, join_unique, materialize, scratch_path

SEGMENT = 64 * 1024
CHUNK = 8 * 1024
RECORDS = 256
DATE = "2024-01-01T00:00:00Z"
#: The profile of revisit records (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of ten hexadecimal digits make eight characters each."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def pieces(block: Column, size: int) -> Column:
    """A binary column cut into an array of `size` bytes each; an empty one gives no piece."""
    n = F.octet_length(block)
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(block, i * size + 1, F.lit(size))))


def raw(x: Column) -> Column:
    """Bytes held in a string column, so that they can be joined; nothing is checked or changed."""
    return x.cast("string")


def chunked(payload: Column, size: int = CHUNK) -> Column:
    framed = F.transform(pieces(payload, size), lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit(CRLF), raw(p), F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit(f"0{CRLF}{CRLF}"))


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    first = page.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"))
    first = first.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    # The running number tells repeated rows apart; it is drawn once a row, before the row is cut into segments.
    page = join_unique(page, first, "digest").withColumn("nth", F.monotonically_increasing_id())
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    block = F.when(again, F.lit("")).otherwise(F.concat(F.lit(HTTP), chunked(F.col("payload"), chunk)))
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    address = lambda url: F.regexp_replace(url, r"[\x00-\x20]", "%20")
    refers = F.concat(
        header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To-Target-URI", address("first_url")),
        header("WARC-Refers-To-Date", F.lit(DATE)), header("Refers-To-Page-ID", F.col("first_id")),
    )
    about = F.concat(
        header("WARC-Target-URI", address("url")), header("Page-ID", F.col("page_id")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.when(again, refers).otherwise(F.lit("")),
    )
    own = record_id(F.col("page_id"), F.col("digest"), F.col("nth"))
    page = page.select(F.when(again, "revisit").otherwise("response").alias("type"), own.alias("id"), about.alias("about"), block.cast("binary").alias("block"))
    cut = F.when(F.octet_length("block") == 0, F.array(F.col("block"))).otherwise(pieces(F.col("block"), segment))
    page = page.withColumns({"total": F.octet_length("block"), "n": F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment))}).select("type", "id", "about", "total", "n", F.posexplode(cut).alias("i", "part"))
    more, last = F.col("i") > 0, F.col("i") == F.col("n") - 1
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(more, "continuation").otherwise(F.col("type")), F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}"),
        header("WARC-Record-ID", F.when(more, F.concat(F.substring("id", 1, 46), F.lit("."), F.col("i").cast("string"), F.lit(">"))).otherwise(F.col("id"))),
        F.when(more, header("WARC-Segment-Origin-ID", F.col("id"))).otherwise(F.col("about")),
        F.when(F.col("n") > 1, header("WARC-Segment-Number", F.col("i") + 1)).otherwise(F.lit("")),
        F.when(more & last, header("WARC-Segment-Total-Length", F.col("total"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"), header("Content-Length", F.octet_length("part")), F.lit(CRLF),
    )
    # The writer ends each row with the second CRLF that ends a record.
    line = F.concat(head, raw(F.col("part")), F.lit(CRLF))
    page.select(line.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF).option("maxRecordsPerFile", RECORDS).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The (headers, block) of each record of an archive, by the records' own lengths."""
    view, at = memoryview(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
        n = int(fields["Content-Length"])
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record {fields.get('WARC-Record-ID')} does not end where its length says")
        yield fields, view[end + 4 : end + 4 + n]
        at = end + 8 + n


def decode_chunked(body: memoryview) -> bytes:
    """The entity of a body in chunked transfer framing."""
    data, at, out = bytes(body), 0, []
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        if len(out[-1]) != n or data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        at = end + 4 + n


def payload_of(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return decode_chunked(memoryview(body)) if b"transfer-encoding: chunked" in head.lower() else body


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


COLUMNS = "id string, type string, page_id long, url string, refers_to long, declared string"
PAYLOAD = "payload binary, payload_bytes long, payload_digest string"
PAYLOADS = f"{COLUMNS}, {PAYLOAD}"
RECORD = f"{COLUMNS}, number int, total long, block binary, {PAYLOAD}"
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def arrow_schema(text: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in text.split(", "))])


def about(fields: dict[str, str]) -> dict:
    """A record's row; continuation records go by the identifier of their first one."""
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "id": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"),
        "refers_to": number("Refers-To-Page-ID"), "declared": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        "number": number("WARC-Segment-Number"), "total": number("WARC-Segment-Total-Length"),
    }


def whole(row: dict, message: bytes, keep: bool) -> dict:
    payload = payload_of(message)
    found = digest_of(payload)
    if row["declared"] and row["declared"] != found:
        raise ValueError(f"the payload of {row['id']} does not have its digest")
    return row | {"payload": payload if keep else None, "payload_bytes": len(payload), "payload_digest": found}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a page's record: COLUMNS, payload (null if not asked for), payload_bytes, payload_digest.

    The files are read once: what they hold is written to the shared folder, payloads of records in one piece already
    decoded, segments as they are.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    record, page = arrow_schema(RECORD), arrow_schema(PAYLOADS)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in records(gzip.decompress(content.as_py())):
                    if fields["WARC-Type"] not in ("response", "revisit", "continuation"):
                        continue
                    row = about(fields)
                    if row["number"] is not None:
                        row["block"] = bytes(block)
                    elif row["type"] == "response":
                        row = whole(row, bytes(block), payloads)
                    rows.append(row)
                    held += len(block)
                    if len(rows) == RECORDS or held > RUN_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=record)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=record)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                blocks = {x["number"]: x["block"] for x in row.pop("parts")}
                total = row.pop("total")
                message = b"".join(blocks[k] for k in sorted(blocks))
                if sorted(blocks) != list(range(1, len(blocks) + 1)) or len(message) != total:
                    raise ValueError(f"segments of {row['id']} are missing or do not have its total length")
                yield pa.RecordBatch.from_pylist([whole(row, message, payloads)], schema=page)

    found = materialize(files.mapInArrow(opened, RECORD), "records")
    head = [x.split()[0] for x in COLUMNS.split(", ") if not x.startswith("id ")]
    firsts = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in head]
    parts = found.where("number is not null").groupBy("id").agg(*firsts, F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    names = [x.split()[0] for x in PAYLOADS.split(", ")]
    return found.where("number is null").select(*names).unionByName(parts.mapInArrow(joined, PAYLOADS))


def resolve(found: DataFrame) -> DataFrame:
    """Give revisits the length and digest of the response whose payload they name."""
    response = found.where("type = 'response'").groupBy(F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("_n"))
    out = join_unique(found, response, "declared")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_n"), "payload_digest": F.coalesce("payload_digest", "declared")}).drop("_n")


def digest(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = resolve(read_archives(spark, path, payloads=False).drop("payload"))
    return found.select("page_id", "payload_digest", "payload_bytes", F.col("type").alias("record_type"), "refers_to")
