"""Progressive JPEG: a decoder for Huffman-coded progressive frames, and a lossless byte store.

The decoder accumulates spectral-selection and successive-approximation scans into one
coefficient array per component, inverse-transforms the arrays in numpy, upsamples chroma and
gives full-resolution RGB. Where a scan has an even structure (all symbols of one kind, or runs
of blocks that only refine), the decoder predicts it, verifies every symbol, and then reads all
values at once; otherwise it goes symbol by symbol.

The byte store writes a payload into the coefficients themselves, which JPEG keeps exactly: the
256 values of magnitude category 8 (-255..-128, 128..255) stand for the 256 bytes. A unit of 192
bytes fills one 4:2:0 MCU: six blocks of 32 AC coefficients each.
"""

from __future__ import annotations

import re
import struct

import numpy as np

UNIT = 192
#: MCUs in a row of a stored payload.
COLUMNS = 64
#: Rows of units in a frame: its height is a 16-bit number.
MOST_ROWS = 4095
_BAND = 32  # AC coefficients 1..32 carry the payload
_NOTE = b"payload "


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: anti-diagonals of the 8x8 block, turning each time."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def _inverse_dct() -> np.ndarray:
    """64x64 matrix from zigzag coefficients to the samples of a block."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[_zigzag()].astype(np.float32)


_IDCT = _inverse_dct()
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.S)


class JpegError(ValueError):
    """The bytes are not a progressive JPEG that this decoder reads."""


class Codes:
    """A Huffman table: codes in order of length, as in a DHT segment."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.of: dict[tuple[int, int], int] = {}
        self.code: dict[int, tuple[int, int]] = {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.of[length, code] = symbols[k]
                self.code[symbols[k]] = (length, code)
                code, k = code + 1, k + 1
            code <<= 1
        self.segment = counts + symbols


class Bits:
    """Reads bits of one entropy-coded segment (byte stuffing removed)."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at = data, 8 * len(data), 0

    def get(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        if self.at > self.size:
            raise JpegError("entropy-coded data ends early")
        word = int.from_bytes(self.data[at >> 3 : (at >> 3) + 4].ljust(4, b"\0"), "big")
        return (word >> (32 - n - (at & 7))) & ((1 << n) - 1)

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.get(1)
            if (length, code) in codes.of:
                return codes.of[length, code]
        raise JpegError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.get(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def array(self, n: int) -> np.ndarray:
        """The next n bits."""
        at, self.at = self.at, self.at + n
        if self.at > self.size:
            raise JpegError("entropy-coded data ends early")
        part = np.frombuffer(self.data, np.uint8, (self.at + 7 >> 3) - (at >> 3), at >> 3)
        return np.unpackbits(part)[at & 7 : (at & 7) + n]


class Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table
        self.across = self.down = self.stride = 0
        self.coefficients = np.zeros((0, 64), np.int16)


class Frame:
    """Coefficient arrays of a progressive JPEG, filled scan by scan."""

    def __init__(self, data: bytes):
        self.notes: list[bytes] = []
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, Codes] = {}
        self.components: dict[int, Component] = {}
        self.restart = self.scans = self.width = self.height = 0
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        at = 2
        while True:
            if data[at : at + 1] != b"\xff":
                raise JpegError("a marker is missing")
            kind = data[at + 1]
            if kind == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xFE:
                self.notes.append(body)
            elif kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == 0xC2:
                self._frame(body)
            elif kind == 0xDA:
                m = _MARKER.search(data, at)
                if not m:
                    raise JpegError("no end of image")
                self._scan(body, data[at : m.start()])
                at = m.start()
            elif 0xC0 <= kind <= 0xCF:
                raise JpegError("not a progressive Huffman frame")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, n = divmod(body[at], 16)
            self.quant[n] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int32)
            at += 129 if wide else 65

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.huffman[body[at]] = Codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or not self.height or not self.width:
            raise JpegError("only 8-bit frames of a known size")
        for k in range(n):
            name, hv, table = body[6 + 3 * k : 9 + 3 * k]
            self.components[name] = Component(hv >> 4, hv & 15, table)
        all_ = self.components.values()
        self.h, self.v = max(c.h for c in all_), max(c.v for c in all_)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in all_:
            c.across = -(-(-(-self.width * c.h // self.h)) // 8)
            c.down = -(-(-(-self.height * c.v // self.v)) // 8)
            c.stride = self.across * c.h
            c.coefficients = np.zeros((c.stride * self.down * c.v, 64), np.int16)

    def _scan(self, head: bytes, data: bytes) -> None:
        self.scans += 1
        parts = [(self.components[head[1 + 2 * k]], head[2 + 2 * k]) for k in range(head[0])]
        first, last, bits = head[-3:]
        high, low = bits >> 4, bits & 15
        if len(parts) == 1:
            c, table = parts[0]
            order = np.arange(c.down * c.across)
            order = [(c, table, order // c.across * c.stride + order % c.across)]
            units = [c.down * c.across]
        else:
            order, units = [], [self.across * self.down]
            y, x = np.divmod(np.arange(self.across * self.down), self.across)
            for c, table in parts:
                v, h = np.divmod(np.arange(c.h * c.v), c.h)
                rows = (y[:, None] * c.v + v) * c.stride + x[:, None] * c.h + h
                order.append((c, table, rows))
        pieces = _RESTART.split(data) if self.restart else [data]
        step = self.restart or units[0]
        for k, piece in enumerate(pieces):
            a, b = k * step, min(units[0], (k + 1) * step)
            if a >= b:
                break
            stream = Bits(piece.replace(b"\xff\x00", b"\xff"))
            now = [(c, t, rows[a:b]) for c, t, rows in order]
            if first == 0:
                self._dc(stream, now, high, low)
            else:
                c, table, rows = now[0]
                (self._ac_refine if high else self._ac_first)(stream, self.huffman[16 + (table & 15)], c.coefficients, rows, first, last, low)

    def _dc(self, bits: Bits, parts: list, high: int, low: int) -> None:
        each = sum(1 if rows.ndim == 1 else rows.shape[1] for _, _, rows in parts)
        total = each * len(parts[0][2])
        if high:
            got = bits.array(total).reshape(-1, each)
            k = 0
            for c, _, rows in parts:
                n = 1 if rows.ndim == 1 else rows.shape[1]
                c.coefficients[rows.ravel(), 0] |= got[:, k : k + n].ravel().astype(np.int16) << low
                k += n
            return
        if len({t >> 4 for _, t, _ in parts}) == 1 and 0 in (codes := self.huffman[parts[0][1] >> 4]).code:
            length, code = codes.code[0]  # all differences zero?
            if bits.size >= total * length and code == 0 and not bits.array(total * length).any():
                return
            bits.at = 0
        last = [0] * len(parts)
        for unit in range(len(parts[0][2])):
            for k, (c, t, rows) in enumerate(parts):
                for row in np.atleast_1d(rows[unit]):
                    last[k] += bits.value(bits.symbol(self.huffman[t >> 4]))
                    c.coefficients[row, 0] = last[k] << low

    @staticmethod
    def _ac_first(bits: Bits, codes: Codes, into: np.ndarray, rows: np.ndarray, first: int, last: int, low: int) -> None:
        run, size = divmod(bits.symbol(codes), 16)
        length, stride, total = bits.at, bits.at + size, len(rows) * (last - first + 1)
        bits.at = 0
        if not run and size and bits.size >= stride * total:  # is it this symbol all the way?
            if stride == 8:
                words = np.frombuffer(bits.data, np.uint8, total).astype(np.int16)
            else:
                words = bits.array(stride * total).reshape(total, stride) @ (1 << np.arange(stride - 1, -1, -1))
                bits.at = 0
            if (words >> size == words[0] >> size).all():
                v = words & ((1 << size) - 1)
                v = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low
                _put(into, rows, first, last, v.reshape(len(rows), -1))
                return
        del length
        skip = 0
        for row in rows:
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += run
                    into[row, k] = bits.value(size) << low
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.get(run) - 1
                    break

    @staticmethod
    def _ac_refine(bits: Bits, codes: Codes, into: np.ndarray, rows: np.ndarray, first: int, last: int, low: int) -> None:
        at, one = 0, 1 << low
        while at < len(rows):
            k, done = first, False
            block = into[rows[at]]
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if not size and run < 15:
                    n = (1 << run) + bits.get(run)
                    if k > first:  # the rest of this block, then whole blocks
                        for j in range(k, last + 1):
                            if block[j] and bits.get(1):
                                block[j] += one if block[j] > 0 else -one
                        into[rows[at]] = block
                        at, n = at + 1, n - 1
                    if n:
                        _refine(bits, into, rows[at : at + n], first, last, one)
                    at, done = at + n, True
                    break
                new = (one if bits.get(1) else -one) if size else 0
                while k <= last:
                    if block[k]:
                        if bits.get(1):
                            block[k] += one if block[k] > 0 else -one
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
            if not done:
                into[rows[at]] = block
                at += 1

    def rgb(self) -> np.ndarray:
        """Full-resolution samples, height x width x 3 (a grey image has three equal planes)."""
        planes = []
        for c in self.components.values():
            values = (c.coefficients * self.quant[c.table]).astype(np.float32) @ _IDCT
            down = self.down * c.v
            plane = values.reshape(down, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, c.stride * 8)
            if self.v > c.v:
                plane = np.repeat(plane, self.v // c.v, 0)
            if self.h > c.h:
                plane = np.repeat(plane, self.h // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        out = np.empty((self.height, self.width, 3), np.uint8)
        y = planes[0] + np.float32(128.5)
        if len(planes) < 3:
            out[:] = np.clip(y, 0, 255)[..., None]
            return out
        cb, cr = planes[1:3]
        out[..., 0] = np.clip(y + np.float32(1.402) * cr, 0, 255)
        out[..., 1] = np.clip(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, 0, 255)
        out[..., 2] = np.clip(y + np.float32(1.772) * cb, 0, 255)
        return out


def _put(into: np.ndarray, rows: np.ndarray, first: int, last: int, values: np.ndarray) -> None:
    if len(rows) == len(into):
        into[:, first : last + 1] = values
    else:
        into[rows, first : last + 1] = values


def _refine(bits: Bits, into: np.ndarray, rows: np.ndarray, first: int, last: int, one: int) -> None:
    """Correction bits for all that is nonzero in whole blocks."""
    now = into[rows, first : last + 1]
    live = now != 0
    n = int(np.count_nonzero(live))
    got = bits.array(n).astype(np.int16) * one
    if n == live.size:
        now += np.where(now > 0, 1, -1).astype(np.int16) * got.reshape(now.shape)
    else:
        now[live] += np.sign(now[live]) * got
    _put(into, rows, first, last, now)


# --- the byte store ---------------------------------------------------------------------------

#: Tables of the store: zero differences; one nonzero value of 7 bits; runs of blocks.
_DC = Codes(bytes([1] + [0] * 15), bytes([0]))
_FIRST = Codes(bytes([1] + [0] * 15), bytes([0x07]))
_RUNS = Codes(bytes([0, 0, 0, 15] + [0] * 12), bytes(n << 4 for n in range(15)))


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _scan_head(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(map(bytes, parts)) + bytes([first, last, high << 4 | low]))


_TABLES = (
    _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC4, b"\x00" + _DC.segment)
    + _segment(0xC4, b"\x10" + _FIRST.segment)
    + _segment(0xC4, b"\x11" + _RUNS.segment)
)
_DC_HEAD = _scan_head([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0)
#: (component, first, last, scan head): luma in two spectral bands, chroma in one.
_FIRST_HEADS = [(c, a, b, _scan_head([(c + 1, 0)], a, b, 0, 1)) for c, a, b in ((0, 1, 8), (0, 9, 32), (1, 1, 32), (2, 1, 32))]
_LAST_HEADS = [_scan_head([(c + 1, 1)], 1, 32, 1, 0) for c in range(3)]


def pad(raw: bytes) -> bytes:
    """``raw`` and then spaces, to a positive multiple of a unit."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of a unit)."""
    units = len(payload) // UNIT
    across = min(units, max(COLUMNS, -(-units // MOST_ROWS)))  # a frame of up to 3.2 GB
    down = -(-units // across)
    data = np.frombuffer(payload.ljust(across * down * UNIT, b"\0"), np.uint8).reshape(down, across, 6, _BAND)
    luma = data[:, :, :4].reshape(down, across, 2, 2, _BAND).transpose(0, 2, 1, 3, 4).reshape(-1, _BAND)
    planes = [luma, data[:, :, 4].reshape(-1, _BAND), data[:, :, 5].reshape(-1, _BAND)]
    out = [
        b"\xff\xd8",
        _segment(0xFE, _NOTE + str(len(payload)).encode()),
        _TABLES,
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _DC_HEAD,
        bytes(-(-6 * across * down // 8)),
    ]
    for c, first, last, head in _FIRST_HEADS:
        # Code 0 and then the upper seven bits of the byte; never 0xFF, so nothing to stuff.
        out += [head, (planes[c][:, first - 1 : last] >> 1).tobytes()]
    for plane, head in zip(planes, _LAST_HEADS, strict=True):
        bits = []
        for at in range(0, len(plane), 32767):
            part = plane[at : at + 32767]
            n = len(part).bit_length() - 1
            length, code = _RUNS.code[n << 4]
            prefix = (code << n) | (len(part) - (1 << n))
            bits.append(np.array([prefix >> k & 1 for k in range(length + n - 1, -1, -1)], np.uint8))
            bits.append(((part & 1) ^ (part < 128)).ravel())
        whole = np.concatenate(bits)
        tail = np.ones(-len(whole) % 8, np.uint8)
        out += [head, np.packbits(np.concatenate([whole, tail])).tobytes().replace(b"\xff", b"\xff\x00")]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(frame: Frame) -> bytes:
    """The payload that :func:`store` wrote, from the coefficient arrays."""
    size = next((int(n[len(_NOTE) :]) for n in frame.notes if n.startswith(_NOTE)), None)
    if size is None:
        raise JpegError("no stored payload")
    down, across = frame.down, frame.across
    data = np.empty((down, across, 6, _BAND), np.uint8)
    luma, cb, cr = (c.coefficients[:, 1 : _BAND + 1] for c in frame.components.values())
    to_byte = lambda v: np.where(v > 0, v, v + 255).astype(np.uint8)
    data[:, :, :4] = to_byte(luma).reshape(down, 2, across, 2, _BAND).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, _BAND)
    data[:, :, 4] = to_byte(cb).reshape(down, across, _BAND)
    data[:, :, 5] = to_byte(cr).reshape(down, across, _BAND)
    return data.tobytes()[:size]
