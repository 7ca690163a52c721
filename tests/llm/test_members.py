"""Salvage of gzip members that hold several records."""

import gzip
import hashlib

import pytest

from plotline.llm import warc


def record(body: bytes, i: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (i, hashlib.sha1(body).hexdigest().encode(), len(block)) + block + b"\r\n\r\n"


def kept(data):
    found = list(warc.salvage(data))
    return [int(f["warc-page-id"]) for k, _, _, f, _ in found if k == "record"], [(a, b, why) for k, a, b, why, _ in found if k == "gap"]


BODIES = [hashlib.sha512(b"%d" % i).hexdigest().encode() * 40 for i in range(6)]


def test_a_bad_record_loses_only_itself():
    parts = [record(b, i) for i, b in enumerate(BODIES)]
    parts[2] = parts[2].replace(BODIES[2][:9], b"#" * 9)
    member, after = gzip.compress(b"".join(parts)), gzip.compress(record(b"x", 9))
    ids, gaps = kept(member + after)
    lo = len(b"".join(parts[:2]))
    assert ids == [0, 1, 3, 4, 5, 9]
    assert gaps == [(0, len(member), f"bytes {lo} to {lo + len(parts[2])} of the member: payload digest differs")]


@pytest.mark.parametrize("level", [0, 9])
@pytest.mark.parametrize("how", ["cut", "checksum", "late"])
def test_a_damaged_member_gives_what_came_out(how, level):
    whole = bytearray(gzip.compress(b"".join(record(b, i) for i, b in enumerate(BODIES)), level))
    if how == "cut":
        del whole[len(whole) * 3 // 4 :]
    elif how == "checksum":
        whole[-6] ^= 0xFF
    else:
        whole[len(whole) * 3 // 4] ^= 0xFF
    ids, gaps = kept(bytes(whole) + gzip.compress(record(b"x", 9)))
    assert ids[-1] == 9 and len(set(ids)) == len(ids) and ids[:3] == [0, 1, 2]
    assert how != "checksum" or ids == [0, 1, 2, 3, 4, 5, 9]
    assert gaps and gaps[-1][:2] == (0, len(whole))
