"""Progressive JPEG in numpy: a decoder for baseline-size Huffman-coded progressive files, and a byte-carrying encoder.

The encoder keeps bytes losslessly where JPEG itself is lossless, in the quantised AC coefficients: byte u becomes
the coefficient u if u >= 128, else u - 255. These are the 256 values of magnitude category 8, whose eight appended
bits are u itself. One successive-approximation step sends seven of them first and the last one in a refinement.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: The zigzag order of an 8 x 8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_K = np.arange(8)
#: Rows are frequencies: samples = DCT.T @ coefficients @ DCT.
DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.125), 0.5)[:, None]).astype(np.float32)
BLOCK_BYTES = 63
#: MCUs of 16 pixels in a row or column, as a side has at most 65,535 pixels.
MOST_MCUS = 4095
#: What ends a scan: any marker but a stuffed byte or a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: bytes) -> bytes:
    """A Huffman table with one code of each length from 1 on: 0, 10, 110, ..."""
    return _segment(0xC4, bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + symbols)


def _scan(components: list[tuple[int, int]], low: int, high: int, before: int, after: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes(c) for c in components) + bytes([low, high, before << 4 | after])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _filled(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones as entropy-coded data must be."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _refinement(u: np.ndarray) -> tuple[bytes, bytes]:
    """Huffman symbols and data that send the last bit of every coefficient of u (blocks x 63).

    All coefficients are nonzero already, so a block is an end of band with correction bits, and runs of such
    blocks share one code.
    """
    last = ((u & 1) ^ (u < 128)).astype(np.uint8)
    runs = [min(32767, len(u) - s) for s in range(0, len(u), 32767)]
    symbols = sorted({(r.bit_length() - 1) << 4 for r in runs})
    bits, at = [], 0
    for r in runs:
        k = r.bit_length() - 1
        code = [1] * symbols.index(k << 4) + [0] + [(r >> i) & 1 for i in range(k - 1, -1, -1)]
        bits += [np.array(code, np.uint8), last[at : at + r].ravel()]
        at += r
    return bytes(symbols), _filled(np.concatenate(bits))


def _grid(mcus: int) -> tuple[int, int]:
    """Columns and rows that hold so many MCUs: as near to a square as leaves at most one in 32 places empty."""
    root = math.isqrt(mcus - 1) + 1
    if root > MOST_MCUS:
        raise ValueError("the payload does not fit one image")
    for high in range(root, 0, -1):
        wide = -(-mcus // high)
        if wide <= MOST_MCUS and wide * high - mcus <= mcus // 32:
            return wide, high
    return root, -(-mcus // root)


def encode_bytes(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose AC coefficients carry the payload; its length stands in a comment segment."""
    wide, high = _grid(max(1, -(-len(payload) // (6 * BLOCK_BYTES))))
    n = wide * high
    u = np.full(n * 6 * BLOCK_BYTES, 255, np.uint8)
    u[: len(payload)] = np.frombuffer(payload, np.uint8)
    u = u.reshape(n * 6, BLOCK_BYTES)
    parts = u[: 4 * n], u[4 * n : 5 * n], u[5 * n :]
    zeros = _filled(np.zeros(6 * n, np.uint8))
    out = [
        b"\xff\xd8", _segment(0xFE, b"payload" + struct.pack(">Q", len(payload))), _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"),
        _table(0x00, b"\x00"), _table(0x10, b"\x07"),
        _scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, zeros),
    ]
    bands = [(1, 0, 1, 5), (2, 1, 1, 63), (3, 2, 1, 63), (1, 0, 6, 63)]
    out += [_scan([(name, 0)], a, b, 0, 1, (parts[c][:, a - 1 : b] >> 1).tobytes()) for name, c, a, b in bands]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, zeros))
    for c in range(3):
        symbols, data = _refinement(parts[c])
        out += [_table(0x10, symbols), _scan([(c + 1, 0)], 1, 63, 1, 0, data)]
    return b"".join([*out, b"\xff\xd9"])


# ---- reading


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a non-interleaved scan
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # zigzag order, padded to whole MCUs


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def raw(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends too early")
        return self.bits[self.at - n : self.at]

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _ac_first(parts: list[bytes], blocks: np.ndarray, codes: dict, low: int, high: int, shift: int, every: int) -> None:
    n, width = len(blocks), high - low + 1
    if len(parts) == 1 and len(codes) == 1 and (size := codes.get((1, 0), 0)) and size < 16:  # every code is 0 and size bits: fixed width
        if size == 7:  # a byte each
            if len(parts[0]) < n * width:
                raise ValueError("the scan ends too early")
            v = np.frombuffer(parts[0], np.uint8, n * width).astype(np.int32)
        else:
            v = _Bits(parts[0]).raw(n * width * (size + 1)).reshape(-1, size + 1) @ (1 << np.arange(size, -1, -1, dtype=np.int32))
        if (v >> size).any():
            raise ValueError("no such Huffman code")
        blocks[:, low : high + 1] = np.where(v >> (size - 1), v << shift, -(((1 << size) - 1 - v) << shift)).reshape(n, width)
        return
    for p, s in zip(parts, range(0, n, every)):
        bits, run = _Bits(p), 0
        for block in blocks[s : s + every]:
            if run:
                run -= 1
                continue
            k = low
            while k <= high:
                skip, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += skip
                    block[k] = bits.signed(size) * (1 << shift)
                    k += 1
                elif skip == 15:
                    k += 16
                else:
                    run = (1 << skip) - 1 + bits.take(skip)
                    break


def _ac_refine(parts: list[bytes], blocks: np.ndarray, codes: dict, low: int, high: int, shift: int, every: int) -> None:
    step = 1 << shift
    band = blocks[:, low : high + 1]
    for p, s in zip(parts, range(0, len(blocks), every)):
        bits, at, end = _Bits(p), s, min(s + every, len(blocks))
        dense = bool((band[s:end] != 0).all())
        run = 0
        while at < end:
            if dense:  # nothing can become nonzero: ends of band and correction bits alone
                skip, size = divmod(bits.symbol(codes), 16)
                if size or skip == 15:
                    raise ValueError("a new coefficient in a full band")
                n = (1 << skip) + bits.take(skip)
                part = band[at : at + n]
                part += np.sign(part) * bits.raw(part.size).reshape(part.shape).astype(part.dtype) * step
                at += n
                continue
            block, k = blocks[at], low

            def correct(k, block=block):
                if bits.take(1):
                    block[k] += step if block[k] > 0 else -step

            while k <= high and not run:
                skip, size = divmod(bits.symbol(codes), 16)
                value = 0
                if size:
                    value = step if bits.take(1) else -step
                elif skip < 15:
                    run = (1 << skip) + bits.take(skip)
                    break
                while k <= high:
                    if block[k]:
                        correct(k)
                    elif skip == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        skip -= 1
                    k += 1
            if run:
                for k in range(k, high + 1):
                    if block[k]:
                        correct(k)
                run -= 1
            at += 1


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisation: dict[int, np.ndarray]
    comment: bytes = b""

    def samples(self, c: Component) -> np.ndarray:
        """The component's samples before upsampling, as float32 around 0."""
        rows, cols, _ = c.coefficients.shape
        natural = np.empty((rows * cols, 64), np.float32)
        natural[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * self.quantisation[c.table]
        half = (natural.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1)
        full = (np.ascontiguousarray(half).reshape(-1, 8) @ DCT).reshape(rows, cols, 8, 8)  # [.., x, y]
        return full.transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8-bit; chroma is repeated to full resolution."""
        most_h, most_v = max(c.h for c in self.components), max(c.v for c in self.components)
        planes = []
        for c in self.components:
            s = self.samples(c)
            s = np.repeat(np.repeat(s, most_v // c.v, axis=0), most_h // c.h, axis=1)
            planes.append(s[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
        y, cb, cr = planes[0] + 128, planes[1], planes[2]
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(data: bytes) -> Image:
    """Read a progressive JPEG: accumulate its scans into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quantisation, codes, image, every = 2, {}, {}, None, 0
    comment = b""
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in comps), max(c.v for c in comps)
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for c in comps:
                c.wide, c.high = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
                c.coefficients = np.zeros((down * c.v, across * c.h, 64), np.int32)
            image = Image(width, height, comps, quantisation)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            if not (found := MARKER.search(data, at)):
                raise ValueError("the file ends in a scan")
            end = found.start()
            raw, at = data[at:end], end
            parts, begin = [], 0
            if every:
                k = 0
                while (k := raw.find(b"\xff", k)) >= 0:
                    if 0xD0 <= raw[k + 1] <= 0xD7:
                        parts.append(raw[begin:k])
                        begin = k + 2
                    k += 2
            parts = [p.replace(b"\xff\x00", b"\xff") for p in [*parts, raw[begin:]]]
            n = body[0]
            names = [(next(c for c in image.components if c.name == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            low, high, steps = body[1 + 2 * n : 4 + 2 * n]
            before, shift = steps >> 4, steps & 15
            if low:
                c, tables = names[0]
                own = np.ascontiguousarray(c.coefficients[: c.high, : c.wide]).reshape(-1, 64)
                run = _ac_refine if before else _ac_first
                run(parts, own, codes[0x10 | tables & 15], low, high, shift, every or max(1, len(own)))
                c.coefficients[: c.high, : c.wide] = own.reshape(c.high, c.wide, 64)
                continue
            # DC: the places of the blocks in the order of the scan
            if n == 1:
                c = names[0][0]
                places = [(0, c.coefficients[: c.high, : c.wide, 0])]
                flat = [(0, np.arange(c.high * c.wide))]
                per = 1
            else:
                flat, per = [], sum(c.h * c.v for c, _ in names)
                places = [(i, c.coefficients[:, :, 0]) for i, (c, _) in enumerate(names)]
            dcs = [np.ascontiguousarray(p) for _, p in places]
            if n == 1:
                comp_of, index_of = np.zeros(dcs[0].size, np.int64), flat[0][1]
            else:
                comp_cols, index_cols = [], []
                for i, (c, _) in enumerate(names):
                    rows, cols = dcs[i].shape
                    grid = np.arange(rows * cols).reshape(rows // c.v, c.v, cols // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)
                    index_cols.append(grid)
                    comp_cols.append(np.full(grid.shape, i))
                comp_of, index_of = np.concatenate(comp_cols, axis=1).ravel(), np.concatenate(index_cols, axis=1).ravel()
            chunk = (every or len(comp_of)) * (per if every else 1)
            if before:
                got = np.concatenate([_Bits(p).raw(min(chunk, len(comp_of) - s)) for p, s in zip(parts, range(0, len(comp_of), chunk))])
                for i, d in enumerate(dcs):
                    d.reshape(-1)[index_of[comp_of == i]] |= got[comp_of == i].astype(np.int32) << shift
            elif len(parts) > 1 or any(codes[t >> 4] != {(1, 0): 0} for _, t in names):
                tables = [codes[t >> 4] for _, t in names]
                for p, s in zip(parts, range(0, len(comp_of), chunk)):
                    bits, last = _Bits(p), [0] * n
                    for i, j in zip(comp_of[s : s + chunk].tolist(), index_of[s : s + chunk].tolist()):
                        last[i] += bits.signed(bits.symbol(tables[i]))
                        dcs[i].reshape(-1)[j] = last[i] * (1 << shift)
            elif _Bits(parts[0]).raw(len(comp_of)).any():  # the one code, 0, means no difference
                raise ValueError("no such Huffman code")
            for (c, _), d in zip(names, dcs):
                if n == 1:
                    c.coefficients[: c.high, : c.wide, 0] = d
                else:
                    c.coefficients[:, :, 0] = d
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def payload_of(image: Image) -> bytes:
    """The bytes that encode_bytes() put into the coefficients."""
    if image.comment[:7] != b"payload":
        raise ValueError("this image carries no payload")
    (n,) = struct.unpack(">Q", image.comment[7:15])
    v = np.concatenate([c.coefficients.reshape(-1, 64)[:, 1:] for c in image.components])
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()[:n]
