import gzip
import hashlib

from lotline.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, chunk_no int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [(5, "http://a/5", "p" * 100), (3, "http://a/3", "p" * 100), (9, None, "p" * 100),
        (3, "http://a/3", "p" * 100), (4, "u\r\nX: y", "q" * 99), (6, "u", "q" * 99), (7, "u", None),
        (None, "n", "p" * 100), (None, "n", "r" * 500), (None, "n", "r" * 500), (11, "u", ""),
        (12, "long", "é\r\n\r\nWARC/1.1\r\n" * 60_000)]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(made(spark, ROWS).repartition(3), path, chunk_bytes=1000, archive_bytes=3000)
    chunks = warc.read_chunks(spark, path, chunk_bytes=4096)
    got = sorted(warc.records(chunks).collect(), key=str)
    assert len(got) == len(ROWS) and all(r.intact for r in got)
    small = {}
    for page_id, _, html in ROWS:
        raw = (html or "").encode()
        if page_id is not None:
            small[raw] = min(page_id, small.get(raw, page_id))
    want = []
    for page_id, _, html in ROWS:
        raw = (html or "").encode()
        first = small.get(raw)
        again = len(raw) >= 100 and first is not None and first != page_id
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(),
                     "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(
        str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_chunks_carry_the_payload(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(made(spark, ROWS[-1:]), path)
    rows = warc.read_chunks(spark, path, chunk_bytes=10_000).orderBy("chunk_no").collect()
    assert len(rows) > 50 and max(len(r.chunk) for r in rows) == 10_000
    so_far = b""
    for r in rows:
        so_far += r.chunk
        assert r.bytes_so_far == len(so_far) and r.digest_so_far == hashlib.sha256(so_far).hexdigest()
    assert so_far.decode() == ROWS[-1][2] and [r.is_last for r in rows].count(True) == 1


def test_archives_are_plain_gzip_members(spark, tmp_path):
    warc.write_archives(made(spark, ROWS[4:5]).coalesce(1), str(tmp_path / "w"))
    [file] = (tmp_path / "w").glob("*.warc.gz")
    text = gzip.decompress(file.read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"q" * 99 + b"\r\n\r\n")
    assert b"\r\nX: y" not in text


def test_empty_table(spark, tmp_path):
    warc.write_archives(made(spark, []), str(tmp_path / "w"))
    assert warc.records(warc.read_chunks(spark, str(tmp_path / "w"))).collect() == []
