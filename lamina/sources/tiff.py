"""Multi-page grey TIFF, classic and big: plain, deflated, LZW or PackBits strips, with predictors; standard library and numpy only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np

#: Field types of the TIFF 6.0 and BigTIFF specifications that pages use: id -> (struct code, bytes).
FIELDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, BYTES, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
KINDS = {1: "u", 2: "i", 3: "f"}


def _pages(data: bytes):
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    head, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    at = struct.unpack_from(order + place, data, 8 if big else 4)[0]
    while at:
        n = struct.unpack_from(order + head, data, at)[0]
        at += struct.calcsize(head)
        tags = {}
        for k in range(n):
            spot = at + k * entry
            tag, kind = struct.unpack_from(order + "HH", data, spot)
            count = struct.unpack_from(order + place, data, spot + 4)[0]
            if kind in FIELDS:
                code, size = FIELDS[kind]
                spot += 4 + struct.calcsize(place)
                if count * size > struct.calcsize(place):
                    spot = struct.unpack_from(order + place, data, spot)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, spot)
        yield order, tags
        at = struct.unpack_from(order + place, data, at + n * entry)[0]


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count of 0 to 127 before that many bytes and one more, or of -1 to -127 before a byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit on, 9 to 12 bits wide, widened one code early; 256 clears, 257 ends."""
    out, bits, held, width = bytearray(), 0, 0, 9
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    known, last = list(first), b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            known, width, last = list(first), 9, b""
            continue
        if code > len(known) or (code == len(known) and not last):
            raise ValueError("damaged LZW strip")
        entry = known[code] if code < len(known) else last + last[:1]
        out += entry
        if last:
            known.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(known) + 1).bit_length()))
    return bytes(out)


#: How strips are unpacked, by the number of their compression.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def _restored(body: bytes, kind: np.dtype, height: int, width: int, predictor: int) -> np.ndarray:
    """Pixels of a page whose predictor is 1 (none), 2 (differences along a row) or 3 (those of a float's byte planes)."""
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(body, np.uint8, height * width * kind.itemsize).reshape(height, -1), axis=1, dtype=np.uint8)
        high_first = planes.reshape(height, kind.itemsize, width).swapaxes(1, 2)
        return np.ascontiguousarray(high_first).view(kind.newbyteorder(">"))[:, :, 0].astype(kind.newbyteorder("="))
    a = np.frombuffer(body, kind, height * width).reshape(height, width).astype(kind.newbyteorder("="))
    return np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a


def read(data: bytes) -> Iterable[np.ndarray]:
    """The pages, one after another, so a caller needn't hold them all."""
    for order, t in _pages(data):
        one = lambda tag, default: t.get(tag, (default,))[0]
        how, predictor, samples = one(COMPRESSION, 1), one(PREDICTOR, 1), one(SAMPLES, 1)
        if how not in UNPACK or samples != 1 or predictor not in (1, 2, 3) or STRIPS not in t:
            raise ValueError(f"TIFF page not supported: compression {how}, {samples} samples, predictor {predictor}, {'strips' if STRIPS in t else 'no strips'}")
        body = b"".join(UNPACK[how](data[a : a + n]) for a, n in zip(t[STRIPS], t[BYTES]))
        kind = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
        yield _restored(body, kind, one(HEIGHT, 0), one(WIDTH, 0), predictor)


def narrowed(a: np.ndarray) -> np.ndarray:
    """float64 as float32; what is neither int16 nor float32 after that as int16."""
    if a.dtype == np.float64:
        return a.astype(np.float32)
    return a if a.dtype in (np.int16, np.float32) else a.astype(np.int16)


def write(out, pages: Iterable[np.ndarray]) -> None:
    """Pages as a deflated big TIFF into a binary file, page by page."""
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    link, at = 8, 16
    for page in pages:
        page = np.ascontiguousarray(narrowed(page))
        body = zlib.compress(page.tobytes())
        fields = [(WIDTH, 4, page.shape[1]), (HEIGHT, 4, page.shape[0]), (BITS, 3, page.itemsize * 8), (COMPRESSION, 3, 8), (PHOTOMETRIC, 3, 1), (STRIPS, 16, at),
                  (SAMPLES, 3, 1), (ROWS, 4, page.shape[0]), (BYTES, 16, len(body)), (FORMAT, 3, 3 if page.dtype.kind == "f" else 2)]
        body += b"\0" * (-len(body) % 8)
        out.write(body + struct.pack("<Q", len(fields)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, v) for tag, kind, v in fields) + struct.pack("<Q", 0))
        here, at = at + len(body), at + len(body) + 16 + 20 * len(fields)
        out.seek(link)
        out.write(struct.pack("<Q", here))
        out.seek(at)
        link = at - 8
