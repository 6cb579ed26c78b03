"""Zstandard WARC archives: written and read as sets of files in a shared store.

An archive starts with a skippable frame that holds its dictionary; then each record is a frame of its own. Tasks stream
both ways: a writer holds one record besides a bounded number of pages from which the dictionary is made, a reader one
record. Files go through Arrow's file systems, so the folder can be in any store that these reach.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.rows import arrow_schema, bounded_batches
from ostinato.llm.storage import cut, keep_columns, new_folder, open_store, read_table

# Fixed values of the formats.
SKIPPABLE, MARK, VERSION = 0x184D2A5D, struct.pack("<I", 0xFD2FB528), b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000
CHUNK = 1 << 18
#: The dictionary is made from so many pages, or bytes, at the start of an archive, and has at most so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 20, 32 << 10
ARCHIVE_BYTES = 256 << 20


class Malformed(ValueError):
    """A record or archive that can't be read."""


# --- records


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; raises Malformed where version, headers or lengths are wrong."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[: max(0, end)].split(b"\r\n")
    if end < 0 or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Malformed("no WARC version or end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Malformed("a header line has no name")
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    for needed in ("warc-type", "warc-record-id", "content-length"):
        if needed not in headers:
            raise Malformed(f"no {needed}")
    if not headers["content-length"].isdigit():
        raise Malformed("content-length isn't a number")
    block = raw[end + 4 : -4]
    if raw[-4:] != b"\r\n\r\n" or len(raw) < end + 8 or len(block) != int(headers["content-length"]):
        raise Malformed("content-length differs from the block")
    return headers, block


def http_block(payload: bytes | None, size: int) -> bytes:
    """A response's header and payload; a revisit has the header only, which tells the payload's size."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")


def http_parts(block: bytes) -> tuple[bytes, int | None]:
    """Payload and stated size of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.IGNORECASE)
    return payload, int(stated[1]) if stated else None


def bare_digest(stated: str | None) -> str | None:
    """Hexadecimal digits of a stated SHA-1 in base 32 or 16."""
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


# --- archives


def make_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; where they are too few to train one, their content itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def compressor(dictionary: bytes, level: int = 6) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def write_head(to: BinaryIO, dictionary: bytes) -> int:
    to.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
    return 8 + len(dictionary)


def frames(source: BinaryIO, most_bytes: int | None = None) -> Iterator[tuple[int, bytes | Malformed]]:
    """(offset, content) of each frame; the dictionary comes from a leading skippable frame, if there is one.

    A frame that can't be decoded, or that holds more than ``most_bytes`` (for archives that aren't trusted), gives a
    Malformed in place of its content; reading goes on where the next frame's mark stands.
    """
    held, at = source.read(CHUNK), 0
    dictionary = b""
    if len(held) >= 8 and struct.unpack_from("<I", held)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", held, 4)[0]
        while len(held) < 8 + size and (more := source.read(max(CHUNK, 8 + size - len(held)))):
            held += more
        dictionary, held, at = held[8 : 8 + size], held[8 + size :], 8 + size
        if dictionary[:4] == MARK:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while held or (held := source.read(CHUNK)):
        frame, parts, size, packed = reader.decompressobj(), [], 0, [held]
        try:
            while True:
                parts.append(frame.decompress(packed[-1]))
                size += len(parts[-1])
                if most_bytes is not None and size > most_bytes:
                    raise Malformed("a record is too large")
                if frame.eof:
                    break
                if not (more := source.read(CHUNK)):
                    raise Malformed("the last frame is cut off")
                packed.append(more)
            yield at, b"".join(parts)
            held = frame.unused_data
            at += sum(map(len, packed)) - len(held)
        except (zstandard.ZstdError, Malformed) as e:
            yield at, Malformed(str(e))
            held, seek = b"".join(packed), 1
            while (found := held.find(MARK, seek)) < 0 and (more := source.read(CHUNK)):
                gone = max(seek, len(held) - 3)  # a mark may be cut in two
                held, at, seek = held[gone:] + more, at + gone, 0
            if found < 0:
                return
            held, at = held[found:], at + found


# --- Spark


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, those with the largest page_id are responses, the others
    revisit it. A null page_id is below all others; if all are null, all are responses. Repeated rows of the largest
    page_id are responses each. Payloads that occur once, the most of them, are dropped from the side that is joined;
    what is left of it is broadcast only if Spark finds it small when it runs, else large partitions of it are split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    shared = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("shared_digest"), "keeper")
    joined = rows.join(shared, F.col("payload_digest") == F.col("shared_digest"), "left")
    revisits = F.col("shared_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("keeper")).alias("refers_to"),
    )


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_record(row: dict, date: str) -> bytes:
    """The WARC record of a row of with_revisits."""
    uri = re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), row["url"] or "")
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", page_urn(row["page_id"])), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", uri)] if uri else []
    headers += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())]
    if row["record_type"] == "revisit":
        headers += [("WARC-Refers-To", page_urn(row["refers_to"])), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("Content-Type", "application/http; msgtype=response")]
    return record_bytes(headers, http_block(row["payload"], row["payload_bytes"]))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_revisits to archives in ``folder`` and returns (path, records, bytes) of these.

    A task writes its partition to one archive, or to more of about ``archive_bytes``. Names are new on each attempt and
    only archives that are in the returned table count, so a task that is run again leaves no doubled records. The table
    is materialised.
    """
    schema = "path string, records long, bytes long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        rows = (page_record(row, date) for batch in batches for row in batch.to_pylist())
        first = next(rows, None)
        while first is not None:
            sample, size = [first], len(first)
            while len(sample) < SAMPLE_PAGES and size < SAMPLE_BYTES and (row := next(rows, None)) is not None:
                sample.append(row)
                size += len(row)
            dictionary = make_dictionary(sample)
            packed = compressor(dictionary)
            name, n, first = f"{path}/pages-{uuid.uuid4().hex}.warc.zst", 0, None
            with store.open_output_stream(name, compression=None) as out:  # else Arrow would pack a .zst file once more
                written = write_head(out, dictionary)
                for row in sample:
                    written += out.write(packed.compress(row))
                    n += 1
                sample = []
                for row in rows:
                    if written >= archive_bytes:
                        first = row
                        break
                    written += out.write(packed.compress(row))
                    n += 1
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [n], "bytes": [written]}, schema=to)

    return cut(bounded_batches(records).mapInArrow(run, schema))


def read_archives(archives: DataFrame, payloads: bool = True, most_bytes: int | None = None) -> DataFrame:
    """One row per record of the archives in (path): place, type, ids, addresses, the payload's size and digest.

    Version, header lines and lengths of each record are validated, and a response's payload against its digest; a record
    that fails has a text in ``error`` and nulls otherwise. Where ``archives`` tells the number of their ``records``, an
    archive with another number of frames has one more row with an ``error``. ``payloads=False`` leaves the payloads
    themselves out.
    """
    schema = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary, error string"
    to = arrow_schema(schema)

    def read(path: str, offset: int, raw: bytes | Malformed) -> dict:
        row: dict = dict.fromkeys(to.names) | {"path": path, "offset": offset}
        try:
            if isinstance(raw, Malformed):
                raise raw
            headers, block = parse_record(raw)
            http = headers.get("content-type", "").startswith("application/http")
            payload, size = http_parts(block) if http else (block, None)
            digest = bare_digest(headers.get("warc-payload-digest"))
            if headers["warc-type"] == "revisit":
                payload = b""
            elif size not in (None, len(payload)):
                raise Malformed("the payload's length differs from the stated one")
            else:
                size, own = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                if digest not in (None, own):
                    raise Malformed("the payload's digest differs from the stated one")
                digest = own
            return row | {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"], "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "payload": payload if payloads else None}
        except (Malformed, ValueError) as e:
            return row | {"error": str(e) or type(e).__name__}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, own = open_store(path)
                held, size, n = [], 0, 0
                with store.open_input_stream(own, compression=None) as source:
                    for offset, raw in frames(source, most_bytes):
                        n += 1
                        held.append(read(path, offset, raw))
                        size += len(held[-1]["payload"] or b"") + 500
                        if size > CHUNK * 32:
                            yield pa.RecordBatch.from_pylist(held, schema=to)
                            held, size = [], 0
                if records not in (None, n):
                    held.append(read(path, 0, Malformed(f"{n} records in place of {records}")))
                yield pa.RecordBatch.from_pylist(held, schema=to)

    return bounded_batches(keep_columns(archives, ["path", "records"])).mapInArrow(run, schema)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record per page, reads the archives back and returns what they say of each page.

    A record that can't be read, or is missing, fails the query: no page is left out silently.
    """
    archives = write_archives(with_revisits(read_table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    records = read_archives(archives, payloads=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    fault = F.raise_error(F.concat_ws(" ", "path", "offset", "error"))
    return records.select(
        F.when(F.col("error").isNull(), number("record_id")).otherwise(fault).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), k AS (SELECT h, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, payload_bytes, sha1(p.h) AS payload_digest,
    CASE WHEN k.h IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN k.h IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h
"""
