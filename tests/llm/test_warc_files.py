"""Archives read through Spark: plain and gzip files, damage, gaps, and tiers of record sizes."""

import glob
import gzip
import hashlib
import logging
import os

from plotline.llm import warc


def record(body: bytes, i: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (i, hashlib.sha1(body).hexdigest().encode(), len(block)) + block + b"\r\n\r\n"


def test_damaged_files_give_records_and_gaps(spark, tmp_path, caplog):
    parts = [record(b"<p>%d</p>" % i * 50, i) for i in range(6)]
    plain = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    plain[at] ^= 0xFF  # inside the payload of record 1
    (tmp_path / "a.warc").write_bytes(bytes(plain))
    members = [gzip.compress(p) for p in parts]
    broken = members[0] + b"\0\0\0" + members[1] + members[2][: len(members[2]) // 2] + members[3]
    os.mkdir(tmp_path / "deep")
    (tmp_path / "deep" / "b.warc.gz").write_bytes(broken)
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "junk.warc").write_bytes(b"no archive at all")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    ids = lambda name: sorted(r.page_id for r in rows if r.kind == "record" and r.path.endswith(name))
    gaps = lambda name: sorted((r.start, r.stop) for r in rows if r.kind == "gap" and r.path.endswith(name))
    assert ids("a.warc") == [0, 2, 3, 4, 5] and gaps("a.warc") == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    assert [i for i in ids("b.warc.gz") if i != 2] == [0, 1, 3] and gaps("b.warc.gz")[0] == (len(members[0]), len(members[0]) + 3)
    assert gaps("junk.warc") == [(0, 17)] and not [r for r in rows if r.path.endswith("empty.warc")]
    assert all(r.payload == b"<p>%d</p>" % r.page_id * 50 for r in rows if r.kind == "record")
    with caplog.at_level(logging.WARNING, logger=warc.__name__):
        kept = warc.quarantine(warc.read_warc(spark, f"file://{tmp_path}")).collect()
    assert len(kept) == sum(r.kind == "gap" for r in rows) and "quarantined" in caplog.text


def test_files_are_bounded_by_bytes(spark, tmp_path):
    sizes = [10] * 40 + [3000] * 9 + [60_000] * 3
    pages = spark.createDataFrame([(i, f"u{i}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/out"
    warc.write_warc(pages, path, tiers=((2000, 16), (8000, 4), (None, 1)))
    files = [os.path.getsize(f) for f in glob.glob(f"{path}/*/part-*")]
    assert max(files) < 62_000 and sum(n > 0 for n in files) == 3 + 3 + 3
    got = warc.read_warc(spark, path).where("kind = 'record'").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, n + len(str(i))) for i, n in enumerate(sizes)]
