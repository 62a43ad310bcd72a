"""WARC archives: writing records with segments and chunked framing, and reassembling them.

Writing: a page whose payload another page with a larger page_id has too becomes a revisit record, every other
page a response record. A response is an HTTP message with chunked framing; a message longer than the segment
size becomes a first record with segment number 1 and continuation records that name it as their origin, the
last with the total length. A record's id holds its page and a number that was stored with its row, so a revisit names
the response that was written. Records are written by Spark's text writer, whose line separator is the end of a
WARC record, a bounded number to a compressed file.

Reading: whole files are parsed record by record by their content lengths. Whole messages are decoded at once;
only the parts of segmented ones are shuffled, grouped by their origin, ordered by segment number, checked for
gaps and against the total length, and decoded. A revisit is resolved by the id that it refers to: the response's
page and payload length are its own, and one that refers to no response, or to one of another digest, is an error.

Defined cases: null html is an empty payload, a null url leaves out the target. Rows that repeat a page_id and
its payload are the same page: each is written, and of equal type. A null page_id is written without a number
and read back as null; it's a response only if no numbered page has its payload. Equal payloads below
`min_revisit` bytes are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm._shared import Scratch, shared_path

SEGMENT, CHUNK, FILE, END = 8192, 4096, 16 << 20, "\r\n\r\n"
_PARSED = "origin string, type string, page_id long, refers string, digest string, number int, total long, block binary, payload binary, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for at in range(0, len(payload), size) for part in [payload[at : at + size]]) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk isn't as long as it says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\s*$", head) else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the empty lines that end it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def record_name(page: int | None, serial: int) -> str:
    return f"urn:page:{'' if page is None else page}:{serial}"


def records(page: int | None, url: str | None, payload: bytes, payload_digest: str, refers: str | None, date: str, segment: int, chunk: int, serial: int = 0) -> Iterator[bytes]:
    """The records of a page: one, or a first and its continuations. refers: the name of the response that a revisit refers to."""
    name = record_name(page, serial)
    common = [("WARC-Date", date), *([("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http; msgtype=response")]
    first = [("WARC-Record-ID", f"<{name}>"), *common]
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), *first, ("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], start + b"\r\n")
        return
    block = start + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *first], block)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), *first, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts))
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), *common[:-1], ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k)), *total], part)


def _hashed(pages: DataFrame) -> DataFrame:
    """page, url, digest, size and the compressed payload of every row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page"), "url", "html")

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            payloads = [x.as_py() or b"" for x in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(digest, payloads), pa.string()), pa.array(map(len, payloads), pa.int64()), pa.array(map(pack, payloads), pa.binary())],
                names=["page", "url", "digest", "size", "packed"],
            )

    return rows.mapInArrow(run, "page long, url string, digest string, size long, packed binary")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int | None = None) -> None:
    """pages: page_id, url, html. Writes the archives below path."""
    scratch = Scratch(pages.sparkSession, "warc-payloads")
    rows = scratch.cut(_hashed(pages).withColumn("serial", F.monotonically_increasing_id()), "rows")
    last = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max(F.struct("page", "serial")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    # Only groups of two or more meet here; the many copies of a group are on the side that AQE splits.
    other = F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last.page"))
    known = rows.join(last, "digest", "left").select("page", "serial", "url", "digest", "packed", F.when(other, F.col("last.page")).alias("last_page"), F.when(other, F.col("last.serial")).alias("last_serial"))

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, size = [], 0
            for page, serial, url, said, packed, last_page, last_serial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = None if last_serial is None else record_name(last_page, last_serial)
                for r in records(page, url, unpack(packed), said, refers, date, segment, chunk, serial):
                    out.append(r)
                    size += len(r)
                    if size > FILE:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = known.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", per_file or max(1, FILE // segment)).option("compression", "gzip").text(path)
    scratch.drop("rows")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, compressed or not."""
    if data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        first, length = end + 4, int(fields["content-length"])
        yield fields, data[first : first + length]
        at = first + length + len(END)


def _name(value: str | None) -> str | None:
    return value and value.strip("<>")


def _page(name: str | None) -> int | None:
    number = name.split(":")[2] if name else ""
    return int(number) if number else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes, payload: a row per record, segments joined.

    A missing or repeated segment, a wrong total length, bad framing, a wrong digest or a revisit of no response is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for fields, block in parse(data.as_py()):
                    kind, own, origin = fields["warc-type"], _name(fields["warc-record-id"]), _name(fields.get("warc-segment-origin-id"))
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = int(fields.get("warc-segment-number", 0))
                    whole = payload_of(block) if kind == "response" and not number else None
                    total = fields.get("warc-segment-total-length")
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if whole is not None and said != digest(whole):
                        raise ValueError(f"the payload of {own} has another digest")
                    out.append((origin or own, kind, _page(own), _name(fields.get("warc-refers-to")), said, number, int(total) if total else None, block if number else None, whole if with_payload else None, None if whole is None else len(whole)))
                for at in range(0, len(out), 512):
                    yield _batch(_PARSED, list(zip(*out[at : at + 512], strict=True)))

    scratch = Scratch(spark, "warc-records")
    parsed = scratch.cut(files.mapInArrow(run, _PARSED), "parsed")
    first = F.col("type") != "continuation"
    joined = parsed.where("number > 0").groupBy("origin").agg(
        F.max(F.when(first, F.col("type"))).alias("type"), F.max(F.when(first, F.col("page_id"))).alias("page_id"), F.max("digest").alias("digest"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
    )
    schema = "name string, page_id long, payload_digest string, payload_bytes long, payload binary"

    def assemble(batches):
        for batch in batches:
            for r in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                parts = r["parts"]
                message = b"".join(p["block"] for p in parts)
                if r["type"] is None or [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or len(message) != r["total"]:
                    raise ValueError(f"segments of {r['origin']} are missing, repeated or of another length")
                payload = payload_of(message)
                if r["digest"] != digest(payload):
                    raise ValueError(f"the payload of {r['origin']} has another digest")
                yield _batch(schema, [(x,) for x in (r["origin"], r["page_id"], r["digest"], len(payload), payload if with_payload else None)])

    whole = parsed.where("number = 0")
    plain = whole.where("type = 'response'").select(F.col("origin").alias("name"), "page_id", F.col("digest").alias("payload_digest"), "payload_bytes", "payload")
    responses = scratch.cut(plain.unionByName(joined.mapInArrow(assemble, schema)), "responses")
    repeats = scratch.cut(whole.where("type = 'revisit'").select("page_id", "refers", F.col("digest").alias("payload_digest")), "revisits")
    scratch.drop("parsed")
    known = responses.select(F.col("name").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("held"), "payload_bytes")
    revisits = repeats.join(known, "refers", "left")
    wrong = F.raise_error(F.concat(F.lit("no response of the same digest is named "), F.coalesce("refers", F.lit("by a revisit"))))
    length = F.when(F.col("held") == F.col("payload_digest"), F.col("payload_bytes")).otherwise(wrong.cast("long"))
    columns = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    told = revisits.select("page_id", F.lit("revisit").alias("record_type"), "refers_to", "payload_digest", length.alias("payload_bytes"), F.lit(None).cast("binary").alias("payload"))
    return responses.select(F.col("page_id"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_digest", "payload_bytes", "payload").unionByName(told.select(*columns))


def _batch(schema: str, columns: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, as read back from its archives."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_revisit=min_revisit)
    return read_warc(pages.sparkSession, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
