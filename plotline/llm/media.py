"""Media columns: progressive JPEG files in a binary column, decoded to coefficient arrays and full-resolution RGB tensors.

``decode`` accumulates the scans of a progressive (SOF2) file, spectral selection and successive approximation alike, into one
coefficient array per component, inverse-transforms all blocks by two matrix products, replicates subsampled chroma and converts
to RGB. Scans whose Huffman table has a single code have a fixed stride and are read as whole arrays; all others go through a
bit reader, so that ordinary files decode too.

``payload_jpeg`` stores arbitrary bytes losslessly in such a file. The unit of the format is the quantised coefficient: 64 payload
bytes are the 64 coefficients (in zigzag order) of an 8x8 block, byte b as the value 256 + b, blocks dealt to Y, Cb and Cr of a
4:2:0 picture. All values lie in one magnitude class, so every table has one code: the first pass of a scan is one byte for each
coefficient (code bit, then its six upper bits), and each refinement one bit.

Cases: null and empty texts have the payload of 64 zero bytes; equal texts give equal files and features, in whatever batch they
stand (the transform is exact in integers). Repeated rows stay repeated; ids may be null. A null or damaged file raises in ``decode``;
in a column it gives its row nulls and the reason, and other rows are not touched. Files may be grey, have any quantisers (16 bits as
well), sampling factors and component numbers. Very long texts are one file each. An empty table gives no rows. ``store_texts`` reads
``doc_id`` and ``text`` only; ``read_media`` keeps the other columns."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm._text import chunks, flat
from plotline.session import stored

BLOCK = 64
OFFSET = 256
#: (spectral start, spectral end, previous point transform, point transform) of the scans of a component, in file order.
SCRIPT = ((0, 0, 0, 2), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 2, 1), (1, 63, 1, 0), (0, 0, 1, 0))


def _zigzag() -> np.ndarray:
    """Zigzag order: diagonals in turn, up and down alternating."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_SCALE = 12
#: Orthonormal cosine basis times 2**_SCALE, rounded: products of these integers are exact in float64.
COSINE = np.array([[np.round((np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * (1 << _SCALE)) for x in range(8)] for u in range(8)])


# --- writing payloads -------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(klass: int, number: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([klass << 4 | number, 1, *[0] * 15, symbol]))


def _scan_header(component: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([1, component, int(ah > 0), ss, se, ah << 4 | al]))


def _grid(blocks: int) -> tuple[int, int]:
    """MCU columns and rows that hold ``blocks`` blocks, six to an MCU, near a square."""
    mcus = -(-blocks // 6)
    cols = max(1, int(np.sqrt(mcus)))
    return cols, -(-mcus // cols)


_QUANT = _segment(0xDB, bytes([0, *[1] * 64]))
#: DC first pass: differences of class 7 (restarted at every block); AC first pass: run 0, class 7; refinements: end of block.
_TABLES = _one_code_table(0, 0, 7) + _one_code_table(1, 0, 7) + _one_code_table(1, 1, 0)
_RESTART = {True: _segment(0xDD, b"\x00\x01"), False: _segment(0xDD, b"\x00\x00")}


def payload_jpeg(payloads: list[np.ndarray]) -> list[bytes]:
    """A progressive JPEG file for each payload (uint8, a positive multiple of 64 long); arrays over all payloads at once."""
    grids = [_grid(len(p) // BLOCK) for p in payloads]
    counts = np.array([c * r for c, r in grids])
    first = np.concatenate([[0], np.cumsum(counts * 6)])
    coef = np.zeros((first[-1], BLOCK), np.uint8)
    for p, at in zip(payloads, first, strict=False):
        coef.reshape(-1)[at * BLOCK : at * BLOCK + len(p)] = p
    dc_first = np.empty((len(coef), 3), np.uint8)
    dc_first[:, 0] = 0x40 | coef[:, 0] >> 2
    dc_first[:, 1] = 0xFF
    low = coef[:, :, None] >> np.array([1, 0], np.uint8) & 1
    bits = np.zeros((len(coef), BLOCK), np.uint8)
    refine = []
    for k in (0, 1):
        bits[:, 1:] = low[:, 1:, k]  # a zero code bit, then 63 correction bits
        refine.append(np.packbits(bits, axis=1))
    first_bytes = 0x40 | coef >> 2
    out = []
    for i, (cols, rows) in enumerate(grids):
        n = cols * rows
        lo = first[i]
        parts = [b"\xff\xd8", _QUANT, _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
        for component, (a, b) in enumerate(((lo, lo + 4 * n), (lo + 4 * n, lo + 5 * n), (lo + 5 * n, lo + 6 * n)), 1):
            for ss, se, ah, al in SCRIPT:
                if (ss, se, ah) in ((0, 0, 0), (1, 5, 0)):
                    parts.append(_RESTART[se == 0])
                parts.append(_scan_header(component, ss, se, ah, al))
                if se == 0 and not ah:
                    rst = dc_first[a:b].copy()
                    rst[:, 2] = 0xD0 | np.arange(b - a) & 7
                    parts.append(rst.tobytes()[:-2])  # no restart marker after the last block
                elif se == 0:
                    ones = np.packbits(np.concatenate([low[a:b, 0, 2 - ah], np.ones(-(b - a) % 8, np.uint8)]))
                    parts.append(ones.tobytes().replace(b"\xff", b"\xff\x00"))
                elif not ah:
                    parts.append(first_bytes[a:b, ss : se + 1].tobytes())
                else:
                    parts.append(refine[2 - ah][a:b].tobytes().replace(b"\xff", b"\xff\x00"))
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --- reading files ----------------------------------------------------------------------------------------------------------


class _Bits:
    """Bit reader over entropy-coded bytes without stuffing; ones after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.acc = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.have < n:
            self.acc = self.acc << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.have += 8
        self.have -= n
        x = self.acc >> self.have
        self.acc &= (1 << self.have) - 1
        return x

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        x = self.take(size) if size else 0
        return x if size == 0 or x >> (size - 1) else x - (1 << size) + 1


@functools.lru_cache(maxsize=256)
def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


class Scan:
    """One scan: its parameters, tables and entropy-coded segments (split at restart markers, stuffing still in)."""

    __slots__ = ("ac", "al", "ah", "comps", "data", "dc", "restart", "se", "ss")

    def __init__(self, comps, ss, se, ah, al, dc, ac, restart, data):
        self.comps, self.ss, self.se, self.ah, self.al, self.dc, self.ac, self.restart, self.data = comps, ss, se, ah, al, dc, ac, restart, data


class Picture:
    """Frame of a progressive file: size, components (id -> h, v, quantiser, block grid) and its scans."""

    def __init__(self, file: bytes):
        if file[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.comps: dict[int, dict] = {}
        self.scans: list[Scan] = []
        quant: dict[int, np.ndarray] = {}
        tables: dict[int, dict] = {}
        restart, at = 0, 2
        while True:
            if at + 2 > len(file) or file[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            marker = file[at + 1]
            if marker == 0xD9:
                break
            if marker == 0xFF:
                at += 1
                continue
            size = file[at + 2] << 8 | file[at + 3]
            body = file[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    q = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    quant[body[0] & 15] = q.astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self.height, self.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
                for i in range(body[5]):
                    c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                    self.comps[c] = {"h": hv >> 4, "v": hv & 15, "q": q}
                self.hmax, self.vmax = max(c["h"] for c in self.comps.values()), max(c["v"] for c in self.comps.values())
                self.mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                for c in self.comps.values():
                    c["grid"] = self.mcus[1] * c["v"], self.mcus[0] * c["h"]  # stored rows, columns of blocks
                    c["own"] = -(-(-(-self.height * c["v"] // self.vmax)) // 8), -(-(-(-self.width * c["h"] // self.hmax)) // 8)
            elif marker in range(0xC0, 0xD0) and marker not in (0xC8, 0xCC):
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xDD:
                restart = body[0] << 8 | body[1]
            elif marker == 0xDA:
                n, end = body[0], at
                while True:
                    end = file.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(file):
                        raise ValueError("the file ends in a scan")
                    if file[end + 1] != 0 and not 0xD0 <= file[end + 1] <= 0xD7:
                        break
                    if restart and file[end + 1] and (jump := self._run_of_restarts(file, end)):
                        end = jump
                        continue
                    end += 2
                comps = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
                ss, se, a = body[1 + 2 * n : 4 + 2 * n]
                self.scans.append(Scan([c[0] for c in comps], ss, se, a >> 4, a & 15, [tables.get(c[1]) for c in comps], tables.get(0x10 | comps[0][2]), restart, file[at:end]))
                at = end
        self.quant = {c: quant[x["q"]] for c, x in self.comps.items()}

    def signature(self) -> tuple:
        """Components and scan parameters: files that share it can be accumulated together."""
        return tuple(self.comps), tuple((*s.comps, s.ss, s.se, s.ah, s.al, s.restart, *map(id, s.dc), id(s.ac)) for s in self.scans)

    @staticmethod
    def _run_of_restarts(file: bytes, end: int) -> int:
        """Where a run of equally spaced restart markers that begins at ``end`` is over (0 if there's none)."""
        step = file.find(b"\xff", end + 2) - end
        if not 2 < step < 64:
            return 0
        return re.compile(rb"(?:\xff[\xd0-\xd7][^\xff]{%d})+" % (step - 2)).match(file, end).end()


def _single(table: dict | None) -> int | None:
    """The symbol of a table whose only code is one zero bit."""
    return table[1, 0] if table and len(table) == 1 and (1, 0) in table else None


def _scan_fixed(scans: list[Scan], coef: np.ndarray, blocks: list[int]) -> bool:
    """Add the same one-component scan of several files to ``coef`` (all their blocks, 64) if it has a fixed stride."""
    scan, n = scans[0], len(coef)
    raws = [s.data for s in scans]
    if scan.ss == 0 and scan.ah:
        if scan.restart:
            return False
        raws = [r.replace(b"\xff\x00", b"\xff") for r in raws]
        if any(len(r) != (k + 7) // 8 for r, k in zip(raws, blocks, strict=True)):
            return False
        bits = np.unpackbits(np.frombuffer(b"".join(raws), np.uint8))
        counts = np.array(blocks)
        ends, bytes_before = np.cumsum(counts), np.cumsum([0, *(len(r) for r in raws[:-1])])
        at = np.arange(n) + np.repeat(8 * bytes_before - (ends - counts), counts)  # each file's bits begin at a byte
        coef[:, 0] |= bits[at].astype(coef.dtype) << scan.al
        return True
    symbol = _single(scan.dc[0] if scan.ss == 0 else scan.ac)
    if scan.ss == 0:
        if symbol != 7 or scan.restart != 1 or any(len(r) != 3 * k - 2 for r, k in zip(raws, blocks, strict=True)):
            return False
        coef[:, 0] = _CLASS_7[np.frombuffer(b"\xff\xd0".join(raws), np.uint8)[::3]] << scan.al
        return True
    width = scan.se - scan.ss + 1
    part = coef[:, scan.ss : scan.se + 1]
    if scan.restart or symbol != (0 if scan.ah else 7):
        return False
    if not scan.ah:
        if any(len(r) != k * width or b"\xff" in r for r, k in zip(raws, blocks, strict=True)):
            return False
        part[:] = _CLASS_7[np.frombuffer(b"".join(raws), np.uint8).reshape(n, width)] << scan.al
        return True
    raws = [r.replace(b"\xff\x00", b"\xff") for r in raws]
    if width != 63 or any(len(r) != 8 * k for r, k in zip(raws, blocks, strict=True)) or not part.all():
        return False  # a coefficient that is still zero could become one
    step = np.unpackbits(np.frombuffer(b"".join(raws), np.uint8)).reshape(n, 64)[:, 1:].astype(coef.dtype)
    step *= np.where(part > 0, coef.dtype.type(1 << scan.al), coef.dtype.type(-(1 << scan.al)))
    part += step
    return True


#: One zero code bit and seven magnitude bits in a byte: 64..127, or -127..-64 with a leading zero.
_CLASS_7 = np.array([x if x & 64 else (x & 63) - 127 for x in range(128)] * 2, np.int16)


def _scan_serial(pic: Picture, scan: Scan, coefs: dict[int, np.ndarray]) -> None:
    """Any progressive scan, bit by bit."""
    pieces, raw, at = [], scan.data, 0
    while at < len(raw):  # split at restart markers
        hit = raw.find(b"\xff", at)
        while hit >= 0 and raw[hit + 1] == 0:
            hit = raw.find(b"\xff", hit + 2)
        pieces.append(raw[at : hit if hit >= 0 else len(raw)].replace(b"\xff\x00", b"\xff"))
        at = hit + 2 if hit >= 0 else len(raw)
    order = []  # (component position, block index), one list for each MCU
    if len(scan.comps) == 1:
        rows, cols = pic.comps[scan.comps[0]]["own"]
        across = pic.comps[scan.comps[0]]["grid"][1]
        order = [[(0, r * across + c)] for r in range(rows) for c in range(cols)]
    else:
        for my in range(pic.mcus[1]):
            for mx in range(pic.mcus[0]):
                one = []
                for k, c in enumerate(scan.comps):
                    x = pic.comps[c]
                    one += [(k, (my * x["v"] + v) * x["grid"][1] + mx * x["h"] + h) for v in range(x["v"]) for h in range(x["h"])]
                order.append(one)
    piece, bits, run, last = 0, _Bits(pieces[0] if pieces else b""), 0, [0] * len(scan.comps)
    for i, one in enumerate(order):
        if scan.restart and i and i % scan.restart == 0:
            piece, run, last = piece + 1, 0, [0] * len(scan.comps)
            bits = _Bits(pieces[piece] if piece < len(pieces) else b"")
        for k, b in one:
            block = coefs[scan.comps[k]][b]
            if scan.ss == 0:
                if scan.ah:
                    block[0] |= bits.take(1) << scan.al
                else:
                    last[k] += bits.signed(bits.symbol(scan.dc[k]))
                    block[0] = last[k] << scan.al
                continue
            run = (_ac_refine if scan.ah else _ac_first)(bits, scan, block, run)


def _ac_first(bits: _Bits, scan: Scan, block: np.ndarray, run: int) -> int:
    if run:
        return run - 1
    k = scan.ss
    while k <= scan.se:
        s = bits.symbol(scan.ac)
        zeros, size = s >> 4, s & 15
        if size:
            k += zeros
            if k > 63:
                raise ValueError("a run leaves its block")
            block[k] = bits.signed(size) << scan.al
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
    return 0


def _ac_refine(bits: _Bits, scan: Scan, block: np.ndarray, run: int) -> int:
    step, k = 1 << scan.al, scan.ss

    def correct(at: int) -> None:
        if bits.take(1):
            block[at] += step if block[at] > 0 else -step

    if not run:
        while k <= scan.se:
            s = bits.symbol(scan.ac)
            zeros, size = s >> 4, s & 15
            value = 0
            if size:
                value = step if bits.take(1) else -step
            elif zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            while k <= scan.se:
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    if value:
                        block[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run:
        for at in range(k, scan.se + 1):
            if block[at]:
                correct(at)
        return run - 1
    return 0


def coefficients(files: list[bytes]) -> tuple[list[Picture], list[dict[int, np.ndarray]]]:
    """Accumulated coefficients of each file: component id -> (blocks in raster order, 64 in zigzag order).

    Files with the same sequence of scans are accumulated together, scan by scan."""
    pics = [Picture(bytes(f)) for f in files]
    out: list[dict[int, np.ndarray]] = [{} for _ in pics]
    alike: dict[tuple, list[int]] = {}
    for i, pic in enumerate(pics):
        alike.setdefault(pic.signature(), []).append(i)
    for group in alike.values():
        head, joint, blocks = pics[group[0]], {}, {}
        for c in head.comps:
            blocks[c] = [pics[i].comps[c]["grid"][0] * pics[i].comps[c]["grid"][1] for i in group]
            joint[c] = np.zeros((sum(blocks[c]), BLOCK), np.int16)
            ends = np.cumsum(blocks[c])
            for i, n, end in zip(group, blocks[c], ends, strict=True):
                out[i][c] = joint[c][end - n : end]
        for k, scan in enumerate(head.scans):
            c = scan.comps[0]
            whole = len(scan.comps) == 1 and all(pics[i].comps[c]["own"] == pics[i].comps[c]["grid"] for i in group)
            if not (whole and _scan_fixed([pics[i].scans[k] for i in group], joint[c], blocks[c])):
                for i in group:
                    _scan_serial(pics[i], pics[i].scans[k], out[i])
    return pics, out


def planes(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples 0..255 of blocks (n, 8, 8): dequantised, inverse-transformed exactly in scaled integers, rounded and clipped."""
    at = np.empty((len(coef), BLOCK))
    at[:, ZIGZAG] = coef * quant
    at = at.reshape(-1, 8, 8)
    x = COSINE.T @ (at.reshape(-1, 8, 8)) @ COSINE
    return np.clip(np.floor(x * 2.0 ** (-2 * _SCALE) + 128.5), 0, 255).astype(np.uint8)


def rgb(pic: Picture, coefs: dict[int, np.ndarray], samples: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """(height, width, 3) uint8: chroma replicated to full resolution, YCbCr (or grey) converted with fixed-point weights."""
    full = []
    for c, x in pic.comps.items():
        rows, cols = x["grid"]
        p = (samples[c] if samples else planes(coefs[c], pic.quant[c])).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        p = p.repeat(pic.vmax // x["v"], 0).repeat(pic.hmax // x["h"], 1) if (pic.vmax, pic.hmax) != (x["v"], x["h"]) else p
        full.append(p[: pic.height, : pic.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2)
    y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + (91881 * cr + 32768 >> 16), 0, 255)
    out[..., 1] = np.clip(y - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
    out[..., 2] = np.clip(y + (116130 * cb + 32768 >> 16), 0, 255)
    return out


def decode(file: bytes) -> np.ndarray:
    """RGB tensor of one progressive JPEG file."""
    pics, coefs = coefficients([file])
    return rgb(pics[0], coefs[0])


def tensor_features(x: np.ndarray) -> str:
    """Size, mean and spread of each channel, and mean steps to the right and down, all from exact sums."""
    n = x.shape[0] * x.shape[1]
    flat_x = x.reshape(-1, 3)
    s = flat_x.sum(0, dtype=np.int64)
    v = x.astype(np.int16)
    sq = np.einsum("ij,ij->j", flat_x, flat_x, dtype=np.int64, casting="unsafe")
    right, down = int(np.abs(np.diff(v, axis=1)).sum(dtype=np.int64)), int(np.abs(np.diff(v, axis=0)).sum(dtype=np.int64))
    return f"{x.shape[1]}x{x.shape[0]};" + ",".join(f"{a / n:.3f}:{b / n - (a / n) ** 2:.2f}" for a, b in zip(s.tolist(), sq.tolist(), strict=True)) + f";{right / (3 * n):.3f},{down / (3 * n):.3f}"


#: What damaged files raise.
_DAMAGE = (ValueError, IndexError, KeyError, TypeError, AttributeError)


# --- the operators ----------------------------------------------------------------------------------------------------------


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: each whole text as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches, "text", 1 << 20):
            n = np.diff(off)
            padded = np.maximum(1, -(-n // BLOCK)) * BLOCK
            payloads = []
            for i in range(len(n)):
                p = np.zeros(padded[i], np.uint8)
                p[: n[i]] = data[off[i] : off[i + 1]]
                payloads.append(p)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(padded), pa.array(payload_jpeg(payloads), pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def _accumulated(files: list[bytes | None]) -> tuple[list[Picture | None], list[dict[int, np.ndarray]], list[str | None]]:
    """``coefficients`` of the files that can be read, and for each file what is wrong with it, if anything."""
    pics: list[Picture | None] = [None] * len(files)
    coefs: list[dict[int, np.ndarray]] = [{} for _ in files]
    wrong: list[str | None] = [None if f is not None else "no media" for f in files]
    some = [i for i, f in enumerate(files) if f is not None]
    try:
        for i, pic, k in zip(some, *coefficients([files[i] for i in some]), strict=True):
            pics[i], coefs[i] = pic, k
    except _DAMAGE:  # one by one, to tell which
        for i in some:
            try:
                (pics[i],), (coefs[i],) = coefficients([files[i]])
            except _DAMAGE as e:
                pics[i], coefs[i], wrong[i] = None, {}, f"damaged: {e}"
    return pics, coefs, wrong


def read_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Decode ``media``: the columns that came, then payload (the coefficients as bytes, if ``payload_bytes`` says how many are meant),
    height, width, feature, with ``tensors`` rgb (height * width * 3 bytes), and media_error: null, or why all of these are null."""
    names = media.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches, "media", 2 << 20):
            pics, coefs, wrong = _accumulated(rows.column("media").to_pylist())
            sizes = rows.column("payload_bytes").to_pylist()
            alike: dict[bytes, list[tuple[int, int]]] = {}  # one transform for all planes of the slice with the same quantisers
            for i, pic in enumerate(pics):
                for c in pic.comps if pic else ():
                    alike.setdefault(pic.quant[c].tobytes(), []).append((i, c))
            samples: list[dict[int, np.ndarray]] = [{} for _ in pics]
            for group in alike.values():
                i, c = group[0]
                all_of = planes(np.concatenate([coefs[i][c] for i, c in group]), pics[i].quant[c])
                at = 0
                for i, c in group:
                    samples[i][c] = all_of[at : at + len(coefs[i][c])]
                    at += len(coefs[i][c])
            payload, features, whole, shape = [], [], [], []
            for pic, k, own, size in zip(pics, coefs, samples, sizes, strict=True):
                x = rgb(pic, k, own) if pic else None
                payload.append(None if pic is None or size is None else (np.concatenate([k[c] for c in pic.comps]).reshape(-1)[:size] - OFFSET).astype(np.uint8).tobytes())
                features.append(tensor_features(x) if pic else None)
                shape.append(x.shape if pic else (None, None))
                if tensors:
                    whole.append(x.tobytes() if pic else None)
            out = [*rows.columns, pa.array(payload, pa.binary()), pa.array([s[0] for s in shape], pa.int32()), pa.array([s[1] for s in shape], pa.int32()), pa.array(features, pa.string())]
            out += [pa.array(whole, pa.binary())] * tensors + [pa.array(wrong, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "payload", "height", "width", "feature"] + ["rgb"] * tensors + ["media_error"])

    return media.mapInArrow(run, f"{kinds}, payload binary, height int, width int, feature string" + ", rgb binary" * tensors + ", media_error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """What was stored and read back, for each document: sizes, digests of payload and file, and the features."""
    kept, _ = stored(store_texts(docs), "media", "zstd")
    got = read_media(kept, tensors=False)
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )
