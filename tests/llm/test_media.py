"""TIFF pages and WARC archives: round trips, other writers' layouts, broken bytes, and the queries' own definitions."""

from __future__ import annotations

import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ostinato.llm import tiff, warc

# --- TIFF

SHAPES = [(1, 1), (3, 192), (70, 200), (257, 64), (64, 64)]


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 48)])
def test_pages_go_round(compression, predictor, tile):
    r = np.random.default_rng(1)
    images = [r.integers(0, 4 if k % 2 else 256, s).astype(np.uint8) for k, s in enumerate(SHAPES)]
    media = tiff.write([(x, compression, predictor, tile, 7) for x in images])
    pages = list(tiff.pages(media))
    assert [(p.height, p.width, p.tiled, p.predictor) for p in pages] == [(*s, bool(tile), predictor) for s in SHAPES]
    assert [p.data for p in pages] == [x.tobytes() for x in images]


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 70_000])
def test_codecs_go_round(n):
    r = random.Random(n)
    for data in (bytes(r.randrange(256) for _ in range(n)), b"ab" * (n // 2), bytes(n), bytes(r.choice(b"aab") for _ in range(n))):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_lzw_of_the_format():
    """A row of few values, with its codes written out."""
    assert tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    want = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == want


def by_hand(order: str, kind: np.dtype, image: np.ndarray, raw: bytes, predictor: int, bits: int, samples: int) -> bytes:
    """A one-strip file in either byte order."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    fields = [(256, image.shape[1]), (257, image.shape[0]), (258, bits), (259, 8), (262, 1), (273, 0), (277, samples), (278, image.shape[0]), (279, len(raw)), (317, predictor)]
    at = 8 + 2 + 12 * len(fields) + 4
    entries = b"".join(struct.pack(order + "HHII", t, 4, 1, at if t == 273 else v) for t, v in fields)
    return head + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + raw


@pytest.mark.parametrize("order", ["<", ">"])
def test_wide_samples_and_predictors(order):
    r = np.random.default_rng(2)
    for bits in (16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        image = r.integers(0, 1 << bits, (5, 8), dtype=np.uint64).astype(kind)
        diff = image.astype(kind.newbyteorder("=")).copy()
        diff[:, 1:] -= diff[:, :-1].copy()
        media = by_hand(order, kind, image, zlib.compress(diff.astype(kind).tobytes()), 2, bits, 1)
        assert next(tiff.pages(media)).data == image.tobytes()
    image = r.normal(size=(4, 6)).astype(f"{order}f4")
    planes = np.concatenate([image.astype(">f4").view(np.uint8).reshape(4, 6, 4)[:, :, k] for k in range(4)], axis=1)
    diff = planes.copy()
    diff[:, 1:] -= planes[:, :-1]
    media = by_hand(order, image.dtype, image, zlib.compress(diff.tobytes()), 3, 32, 1)
    assert next(tiff.pages(media)).data == image.tobytes()
    colour = r.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    diff = colour.copy()
    diff[:, 1:] -= colour[:, :-1]
    assert next(tiff.pages(by_hand(order, colour.dtype, colour, zlib.compress(diff.tobytes()), 2, 8, 3))).data == colour.tobytes()


def test_broken_pictures_give_an_error_row(spark):
    good = tiff.store(tiff.padded("some text " * 9000)[0])
    loop = bytearray(tiff.write([(np.zeros((2, 2), np.uint8), tiff.PLAIN, 1, None, 2)]))
    loop[-4:] = loop[4:8]
    rows = [(0, good), (1, None), (2, b""), (3, b"II*\0\xff\xff\xff\0"), (4, good[: len(good) // 2]), (5, bytes(loop)), (6, good.replace(struct.pack("<HHI", 259, 3, 1) + struct.pack("<I", 8), struct.pack("<HHI", 259, 3, 1) + struct.pack("<I", 7)))]
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumn("page", F.lit(0)).withColumn("error", F.lit("clash"))
    made = tiff.read_pages(df).collect()
    errors = {r["doc_id"] for r in made if r["error"]}
    assert errors == {1, 2, 3, 4, 5, 6}
    assert b"".join(r["data"] for r in sorted((r for r in made if r["doc_id"] == 0), key=lambda r: r["page"])) == tiff.padded("some text " * 9000)[0]
    assert tiff.read_pages(df.where("doc_id < 0")).count() == 0


def test_every_text_is_read_back(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 192), (-4, "é" * 100_000), (-5, None)], docs.schema)
    both = docs.unionByName(odd)
    made = {r["doc_id"]: r for r in tiff.digests(tiff.store_texts(both)).collect()}
    assert len(made) == both.count()
    for r in both.collect():
        raw = (r["text"] or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        got = made[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert got["media_bytes"] > 0 and len(got["media_sha256"]) == 64
    assert list(made[-1])[1:] == list(made[-5])[1:] == list(made[-2])[1:]
    clash = both.selectExpr("*", "'clash' AS media", "'clash' AS n_bytes", "0 AS page")
    assert tiff.digests(tiff.store_texts(clash)).count() == len(made)
    assert tiff.digests(tiff.store_texts(both.where("doc_id = 10000000"))).count() == 0


def test_codecs_are_dealt_to_pages_of_every_size():
    r = np.random.default_rng(4)
    seen: dict[bool, set] = {True: set(), False: set()}
    for n in [192] * 60 + [192 * 700] * 6:
        payload = r.integers(97, 100, n).astype(np.uint8).tobytes()
        made = list(tiff.pages(tiff.store(payload)))
        assert b"".join(p.data for p in made) == payload
        seen[n > 192].update(p.compression for p in made)
    assert seen[True] == seen[False] == {"packbits", "lzw", "deflate"}
    assert {p.compression for p in tiff.pages(tiff.store(payload, (tiff.LZW,)))} == {"lzw"}


# --- WARC


def archive(records: list[bytes], dictionary: bytes = b"") -> bytes:
    out = io.BytesIO()
    if dictionary:
        warc.write_head(out, dictionary)
    packed = warc.compressor(dictionary)
    for r in records:
        out.write(packed.compress(r))
    return out.getvalue()


def record(n: int, payload: bytes = b"body") -> bytes:
    return warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:page:{n}>")], payload)


class Slow(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 11) if n > 0 else n)


@pytest.mark.parametrize("kind", [io.BytesIO, Slow])
def test_frames_with_and_without_dictionaries(kind):
    records = [record(i, b"payload " * i) for i in range(9)]
    raw = b"".join(records) * 3
    for dictionary in (b"", raw, warc.make_dictionary(records * 40)):
        data = archive(records, dictionary)
        assert [r for _, r in warc.frames(kind(data))] == records
    packed = zstandard.ZstdCompressor().compress(raw)
    data = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + archive(records, raw)[8 + len(raw) :]
    assert [r for _, r in warc.frames(kind(data))] == records
    assert list(warc.frames(kind(b""))) == []
    assert [type(r) for _, r in warc.frames(kind(archive(records)[:-3]))] == [bytes] * 8 + [warc.Malformed]
    offsets = [at for at, _ in warc.frames(kind(archive(records, raw)))]
    whole = archive(records, raw)
    assert all(whole[at : at + 4] == warc.MARK for at in offsets)


@pytest.mark.parametrize("kind", [io.BytesIO, Slow])
def test_reading_goes_on_after_a_frame_that_is_broken(kind):
    records = [record(i, b"payload %d " % i * 40) for i in range(5)]
    data = bytearray(archive(records))
    offsets = [at for at, _ in warc.frames(io.BytesIO(bytes(data)))]
    data[offsets[2] + 5 : offsets[3] - 1] = b"\xff" * (offsets[3] - 1 - offsets[2] - 5)
    made = list(warc.frames(kind(bytes(data))))
    assert [at for at, _ in made] == offsets
    assert [r if isinstance(r, bytes) else None for _, r in made] == [*records[:2], None, *records[3:]]
    assert [type(r) for _, r in warc.frames(kind(archive(records)), most_bytes=10)] == [warc.Malformed] * 5


def test_a_missing_record_is_told(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([record(1), record(2)]))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst", 3)], "path string, records long")
    assert [r["error"] for r in warc.read_archives(paths).collect()] == [None, None, "2 records in place of 3"]


def test_no_page_is_left_out_silently(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x")], PAGES)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "page_record", lambda row, date: b"no record")
    with pytest.raises(Exception, match="no WARC version"):
        warc.op3_warc_archives(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("bad", [b"", b"WARC/2.0\r\n\r\n", record(1).replace(b"Content-Length: 4", b"Content-Length: 5"), record(1).replace(b"Content-Length: 4", b"Content-Length: x"), record(1).replace(b"WARC-Type", b"WARC-Tipe"), record(1)[:-2], record(1).replace(b"WARC-Type: ", b"WARC-Type ")])
def test_records_are_validated(bad):
    assert warc.parse_record(record(1))[1] == b"body"
    with pytest.raises(warc.Malformed):
        warc.parse_record(bad)


def test_bad_records_have_an_error(spark, tmp_path):
    wrong = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:3>"), ("WARC-Payload-Digest", "sha1:" + "A" * 32), ("Content-Type", "application/http")], warc.http_block(b"x", 1))
    (tmp_path / "a.warc.zst").write_bytes(archive([record(1), b"nonsense", wrong, record(4)])[:-2])
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string")
    made = sorted(warc.read_archives(paths).collect(), key=lambda r: r["offset"])
    assert [r["error"] is None for r in made] == [True, False, False, False]
    assert made[0]["payload"] == b"body" and made[0]["record_id"] == "<urn:page:1>"


PAGES = "page_id long, url string, html string"


def described(spark, pages, folder):
    archives = warc.write_archives(warc.with_revisits(pages), folder, archive_bytes=2000)
    made = warc.read_archives(archives)
    assert made.where("error is not null").count() == 0
    return made


def test_pages_with_nulls_ties_and_repeats(spark, tmp_path):
    big, other = "<p>é</p>" * 200, "z" * 1000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (2, "again", big), (7, "u", other), (8, "u", other[:-1])]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).withColumn("keeper", F.lit(0))
    made = described(spark, pages, f"file://{tmp_path}/w").collect()
    assert len(made) == len(rows)
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in made)
    assert got == sorted(
        [("<urn:page:1>", "revisit", "<urn:page:2>", 1800), ("<urn:page:none>", "revisit", "<urn:page:2>", 1800), *[("<urn:page:2>", "response", "", 1800)] * 2]
        + [(f"<urn:page:{k}>", "response", "", n) for k, n in ((3, 0), (4, 0), (5, 5), (6, 5), (7, 1000), (8, 999))]
    )
    assert {r["payload_digest"] for r in made if r["payload_bytes"] == 1800} == {hashlib.sha1(big.encode()).hexdigest()}
    assert described(spark, pages.where("page_id = 99"), f"file://{tmp_path}/v").count() == 0


def test_the_query_is_its_sql(spark, data):
    made = sorted(map(tuple, warc.op3_warc_archives(spark, data).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    assert made == sorted(con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP3_SQL})").fetchall())


def test_archives_on_disk_are_of_the_format(spark, tmp_path):
    """A leading skippable frame with the dictionary, then a frame for each record, that any zstandard reader decodes."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], PAGES).coalesce(1)
    (row,) = warc.write_archives(warc.with_revisits(pages).coalesce(1), f"file://{tmp_path}/w").collect()
    data = open(row["path"].removeprefix("file://"), "rb").read()
    assert len(data) == row["bytes"]
    kind, size = struct.unpack_from("<II", data)
    assert kind == warc.SKIPPABLE
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, n = data[8 + size :], 0
    while rest:
        frame = reader.decompressobj()
        assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = frame.unused_data, n + 1
    assert n == row["records"] == 40


def test_features_are_those_of_plain_loops():
    r = np.random.default_rng(6)
    for n in (192, 192 * 5, 192 * 300):
        data = bytes(r.integers(32, 120, n).astype(np.uint8))
        mean = sum(data) / n
        deviation = math.sqrt(sum((b - mean) ** 2 for b in data) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
        parts = [data[k * n // 64 : (k + 1) * n // 64] for k in range(64)]
        bits = "".join("1" if sum(p) / len(p) > mean else "0" for p in parts)
        made = dict(x.split("=") for x in tiff.feature(data, 3).split(";"))
        assert (made["pages"], made["hash"]) == ("3", f"{int(bits, 2):016x}")
        assert [float(made[k]) for k in ("mean", "deviation", "entropy")] == pytest.approx([mean, deviation, entropy], abs=1e-4)
