"""FLAC in numpy: an encoder for lossless storage and a decoder for any subset stream.

The decoder handles constant, verbatim, fixed and LPC subframes, both Rice methods with escapes
and partitions, wasted bits and stereo decorrelation, and verifies the CRC-8 of headers, the CRC-16 of
frames and the MD5 of the samples. Rice codes are found without a loop over samples: the next
one-bit of every position gives the jump from codeword to codeword, and jumps are doubled four times.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

BLOCK, LPC_ORDER, PRECISION = 4096, 4, 10
#: samples that are coded at once, and decoded at once
GROUP, DECODED = 1 << 18, 1 << 20
#: seek points that one metadata block can hold
_POINTS = ((1 << 24) - 1) // 18
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {i: 256 << (i - 8) for i in range(8, 16)}
SIZE_CODES = {v: k for k, v in SIZES.items()}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
DEPTH_CODES = {v: k for k, v in DEPTHS.items()}


class FlacError(ValueError):
    """A stream that can't be decoded."""


def _table(width: int, polynomial: int) -> list[int]:
    out = []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c >> (width - 1) else c << 1) & ((1 << width) - 1)
        out.append(c)
    return out


_SYNC = re.compile(rb"\xff[\xf8\xf9]")
_CRC8 = _table(8, 0x07)
_CRC16 = np.array(_table(16, 0x8005), np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


class _Crc16:
    """CRC-16 of many byte runs at once: row j holds what each byte value adds when j bytes follow."""

    def __init__(self) -> None:
        self.rows = _CRC16[None, :].copy()

    def _grow(self, n: int) -> None:
        if n > len(self.rows):
            rows = np.empty((max(n, 2 * len(self.rows)), 256), np.uint16)
            rows[: len(self.rows)] = self.rows
            for j in range(len(self.rows), len(rows)):
                c = rows[j - 1]
                rows[j] = (c << np.uint16(8)) ^ _CRC16[c >> np.uint16(8)]
            self.rows = rows

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of ``data[s : s + n]`` for non-empty runs that follow each other without gaps."""
        self._grow(int(lengths.max()))
        left = np.repeat(starts + lengths, lengths) - 1 - np.arange(starts[0], starts[-1] + lengths[-1])
        parts = self.rows.reshape(-1)[left * 256 + data[starts[0] : starts[-1] + lengths[-1]]]
        return np.bitwise_xor.reduceat(parts, starts - starts[0])

    def one(self, data: np.ndarray) -> int:
        return int(self.of(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0

    def extended(self, total: int, data: np.ndarray, step: int = 1 << 13) -> int:
        """The sum of bytes with sum ``total`` followed by ``data``, in pieces of ``step`` bytes."""
        for at in range(0, len(data), step):
            part = data[at : at + step].copy()
            part[: min(2, len(part))] ^= np.array([total >> 8, total & 255], np.uint8)[: len(part)]
            carried = (total & 255) << 8 if len(part) == 1 else 0
            total = self.one(part) ^ carried
        return total


_SUM16 = _Crc16()


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    for size in range(2, 8):
        if n < 1 << (5 * size + 1 if size < 7 else 36):
            tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
            return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])
    raise FlacError("number too large")


def _frame_header(number: int, block: int, channels: int, depth: int) -> bytes:
    code, extra = (SIZE_CODES[block], b"") if block in SIZE_CODES else (7, struct.pack(">H", block - 1))
    head = bytes([0xFF, 0xF8, code << 4, (channels - 1) << 4 | DEPTH_CODES[depth] << 1]) + _coded_number(number) + extra
    return head + bytes([crc8(head)])


def _bits(value: int, width: int) -> str:
    return format(value & ((1 << width) - 1), f"0{width}b") if width else ""


def _levinson(auto: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients of each row of autocorrelations, newest sample first."""
    rows = len(auto)
    a, error = np.zeros((rows, order)), auto[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / error
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    return a


def _rice_parameter(mean: np.ndarray) -> np.ndarray:
    ratio = -0.4812118250596 / np.log(np.maximum(mean, 1e-6) / (np.maximum(mean, 1e-6) + 1))
    return np.clip(1 + np.floor(np.log2(ratio)), 0, 14).astype(np.int64)


def _encode_channel_rows(x: np.ndarray, n: np.ndarray, depth: int, lpc_order: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row of samples: the bits before the residual codes, order, Rice parameter, residuals and their mask."""
    rows, width = x.shape
    at = np.arange(width)
    inside = at < n[:, None]
    best, choice = np.full(rows, np.inf), np.zeros(rows, np.int64)
    residuals, current = [], x
    for order in range(5):
        mask = inside & (at >= order)
        cost = (np.abs(current) * mask).sum(axis=1) / np.maximum(n - order, 1)
        cost = np.log2(cost + 0.3) * (n - order) + order * depth
        usable = (n > order) & (cost < best)
        best, choice = np.where(usable, cost, best), np.where(usable, order, choice)
        residuals.append(current)
        if order < 4:
            current = current.copy()
            current[:, 1:] = current[:, 1:] - residuals[-1][:, :-1]
    coefficients = shift = None
    if lpc_order:
        y = x.astype(np.float64)
        auto = np.stack([np.einsum("ij,ij->i", y[:, : width - lag], y[:, lag:]) for lag in range(lpc_order + 1)], axis=1)
        a = _levinson(auto, lpc_order)
        top = np.abs(a).max(axis=1)
        shift = np.clip(PRECISION - 2 - np.ceil(np.log2(top + 1e-9)), 0, 15).astype(np.int64)
        coefficients = np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int64)
        guess = np.zeros_like(x)
        for j in range(lpc_order):
            guess[:, j + 1 :] += coefficients[:, j : j + 1] * x[:, : width - j - 1]
        residual = x - (guess >> shift[:, None])
        mask = inside & (at >= lpc_order)
        cost = (np.abs(residual) * mask).sum(axis=1) / np.maximum(n - lpc_order, 1)
        cost = np.log2(cost + 0.3) * (n - lpc_order) + lpc_order * (depth + PRECISION) + 9
        usable = (n > lpc_order) & (cost < best)
        choice = np.where(usable, 5, choice)
        residuals.append(residual)
    constant = ((x == x[:, :1]) | ~inside).all(axis=1)
    order = np.where(choice == 5, lpc_order, choice)
    chosen = np.empty_like(x)
    for c, r in enumerate(residuals):
        chosen[choice == c] = r[choice == c]
    mask = inside & (at >= order[:, None]) & ~constant[:, None]
    folded = np.where(chosen < 0, -2 * chosen - 1, 2 * chosen) * mask
    parameter = _rice_parameter(folded.sum(axis=1) / np.maximum(n - order, 1))
    coded = (folded >> parameter[:, None]).sum(axis=1) + (parameter + 1) * (n - order)
    verbatim = (coded + order * depth + 10 >= n * depth) & ~constant
    mask &= ~verbatim[:, None]
    heads = []
    for i in range(rows):
        if constant[i]:
            heads.append("00000000" + _bits(int(x[i, 0]), depth))
        elif verbatim[i]:
            heads.append("00000010" + "".join(_bits(v, depth) for v in x[i, : n[i]].tolist()))
        else:
            o = int(order[i])
            kind = f"01{_bits(o - 1, 5)}0" if choice[i] == 5 else f"0001{_bits(o, 3)}0"
            warm = "".join(_bits(v, depth) for v in x[i, :o].tolist())
            lpc = _bits(PRECISION - 1, 4) + _bits(int(shift[i]), 5) + "".join(_bits(v, PRECISION) for v in coefficients[i].tolist()) if choice[i] == 5 else ""
            heads.append(kind + warm + lpc + "00" + "0000" + _bits(int(parameter[i]), 4))
    return heads, order, parameter, folded, mask


def _encode_frames(frames: list[np.ndarray], numbers: list[int], depth: int, lpc_order: int) -> list[bytes]:
    """Mono frames of similar length."""
    n = np.array([len(f) for f in frames])
    x = np.zeros((len(frames), int(n.max())), np.int64)
    for i, f in enumerate(frames):
        x[i, : len(f)] = f
    heads, _, parameter, folded, mask = _encode_channel_rows(x, n, depth, lpc_order)
    prefix = []
    for f, number, head in zip(frames, numbers, heads, strict=True):
        h = _frame_header(number, len(f), 1, depth)
        prefix.append(np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8)), np.frombuffer(head.encode(), np.uint8) - 48]))
    row, _ = np.nonzero(mask)
    u = folded[mask]
    k = parameter[row]
    q = u >> k
    lengths = q + 1 + k
    body = np.bincount(row, lengths, len(frames)).astype(np.int64)
    first = np.array([len(p) for p in prefix])
    size = (first + body + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(base[-1]) * 8, np.uint8)
    for p, b in zip(prefix, base.tolist(), strict=False):
        bits[8 * b : 8 * b + len(p)] = p
    if len(u):
        ends = np.cumsum(lengths)
        before = np.concatenate([[0], np.cumsum(body)])[:-1]
        start = ends - lengths - before[row] + 8 * base[row] + first[row] + q
        bits[start] = 1
        for b in range(int(k.max())):
            has = k > b
            bits[(start + k - b)[has]] = (u >> b & 1)[has]
    data = np.packbits(bits)
    sums = _SUM16.of(data, base[:-1], size)
    return [data[b : b + s].tobytes() + struct.pack(">H", c) for b, s, c in zip(base.tolist(), size.tolist(), sums.tolist(), strict=False)]


def encode_many(signals: list[np.ndarray], depth: int = 8, rate: int = 8000, block: int = BLOCK, lpc_order: int = LPC_ORDER) -> list[bytes]:
    """FLAC streams of mono integer signals of any integer type, with a seek point for every frame.

    Frames of similar length are coded side by side, ``GROUP`` samples at once, so memory beside the signals and
    the coded bytes doesn't grow with the length of a signal.
    """
    parts = [(min(block, len(s) - at), i, at // block) for i, s in enumerate(signals) for at in range(0, len(s), block)]
    parts.sort()
    coded: dict[tuple[int, int], bytes] = {}
    at = 0
    while at < len(parts):
        end = at + 1
        while end < len(parts) and parts[end][0] <= 1.3 * parts[at][0] + 64 and (end - at) * parts[end][0] < GROUP:
            end += 1
        own = parts[at:end]
        frames = _encode_frames([signals[i][j * block : j * block + n] for n, i, j in own], [j for _, _, j in own], depth, lpc_order)
        coded |= {(i, j): f for (_, i, j), f in zip(own, frames, strict=True)}
        at = end
    out = []
    for i, s in enumerate(signals):
        own = [coded.pop((i, j)) for j in range(-(-len(s) // block))]
        whole = hashlib.md5()
        for at in range(0, len(s), GROUP):
            whole.update(pcm_bytes(s[at : at + GROUP].reshape(-1, 1), depth))
        sizes = [len(f) for f in own] or [0]
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | (depth - 1) << 36 | len(s)).to_bytes(8, "big") + whole.digest()
        seek, offset = [], 0
        for j, f in enumerate(own):
            seek.append(struct.pack(">QQH", j * block, offset, min(block, len(s) - j * block)))
            offset += len(f)
        tables = [seek[j : j + _POINTS] for j in range(0, len(seek), _POINTS)]
        heads = [b"\x00" + (34).to_bytes(3, "big") + info, *(b"\x03" + (18 * len(t)).to_bytes(3, "big") + b"".join(t) for t in tables)]
        heads[-1] = bytes([heads[-1][0] | 0x80]) + heads[-1][1:]
        out.append(b"fLaC" + b"".join(heads) + b"".join(own))
    return out


@dataclass
class Stream:
    """Metadata of a stream: frames begin at ``start`` and have ``largest`` bytes at most (0: unknown); ``seek`` has (sample, offset, samples)."""

    rate: int
    channels: int
    depth: int
    samples: int
    block: int
    md5: bytes
    start: int
    largest: int = 0
    seek: list[tuple[int, int, int]] = field(default_factory=list)


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, stream, seek = 4, None, []
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata cut off")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            raise FlacError("metadata cut off")
        if kind & 0x7F == 0 and size >= 34:
            packed = int.from_bytes(body[10:18], "big")
            stream = Stream(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(body[2:4], "big"), body[18:34], 0, int.from_bytes(body[7:10], "big"))
        elif kind & 0x7F == 3:
            seek += [p for p in struct.iter_unpack(">QQH", body[: size // 18 * 18]) if p[0] != (1 << 64) - 1]
        if kind & 0x80:
            break
    if stream is None:
        raise FlacError("no stream information")
    stream.start, stream.seek = at, seek
    return stream


@dataclass
class Frame:
    """A frame header: the frame is ``data[start:stop]``, its samples start at ``sample``."""

    start: int
    stop: int
    body: int
    block: int
    assignment: int
    depth: int
    sample: int
    ok: bool


def _header_at(data: bytes, at: int, stream: Stream) -> Frame | None:
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    code, rate, assignment, depth = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if code == 0 or rate == 15 or assignment > 10 or depth in (3, 7):
        return None
    lead = head[4]
    size = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size > 7 or lead == 0xFF or 0x80 <= lead < 0xC0:
        return None
    number = lead if size == 1 else lead & (0x7F >> size)
    for b in head[5 : 4 + size]:
        if b >> 6 != 2:
            return None
        number = number << 6 | b & 0x3F
    p = 4 + size
    if code == 6:
        block, p = head[p] + 1, p + 1
    elif code == 7:
        block, p = int.from_bytes(head[p : p + 2], "big") + 1, p + 2
    else:
        block = SIZES[code]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(head) or crc8(head[:p]) != head[p]:
        return None
    return Frame(at, 0, at + p + 1, block, assignment, DEPTHS.get(depth, stream.depth), number if head[1] & 1 else number * stream.block, True)


def find_frames(data: bytes, stream: Stream) -> list[Frame]:
    """All frames of a stream. A frame ends where its CRC-16 holds and another header or the end follows.

    Every later header is tried, up to the largest frame that the metadata state; the sum is carried from one to the
    next. Where no end verifies, the frame up to the next header is returned with ``ok`` false.
    """
    raw = np.frombuffer(data, np.uint8)
    heads = [h for m in _SYNC.finditer(data, stream.start) if (h := _header_at(data, m.start(), stream))]
    out, i = [], 0
    if heads and heads[0].start != stream.start:
        out.append(Frame(stream.start, heads[0].start, stream.start, 0, 0, stream.depth, 0, False))
    while i < len(heads):
        start, total, at = heads[i].start, 0, heads[i].start
        heads[i].ok, after = False, i + 1
        heads[i].stop = heads[i + 1].start if i + 1 < len(heads) else len(data)
        for j in range(i + 1, len(heads) + 1):
            end = heads[j].start if j < len(heads) else len(data)
            if stream.largest and end - start > stream.largest:
                break
            if end - start <= 4:
                continue
            total, at = _SUM16.extended(total, raw[at : end - 2]), end - 2
            if total == int.from_bytes(data[end - 2 : end], "big"):
                heads[i].ok, heads[i].stop, after = True, end, j
                break
        out.append(heads[i])
        i = after
    return out


class _Bits:
    """Bits of a frame with, for every position, the next one-bit at or after it."""

    def __init__(self, data: np.ndarray) -> None:
        self.bits = np.unpackbits(data)
        ones = np.flatnonzero(self.bits.view(bool))
        rank = np.cumsum(self.bits, dtype=np.intp)
        rank -= self.bits
        self.end = len(self.bits)
        self.next = np.append(ones, self.end).take(rank)
        self.at = 0

    def unsigned(self, width: int) -> int:
        if self.at + width > self.end:
            raise FlacError("frame cut off")
        v = 0
        for b in self.bits[self.at : self.at + width].tolist():
            v = v << 1 | b
        self.at += width
        return v

    def signed(self, width: int) -> int:
        v = self.unsigned(width)
        return v - (1 << width) if width and v >> width - 1 else v

    def signed_row(self, n: int, width: int) -> np.ndarray:
        if self.at + n * width > self.end:
            raise FlacError("frame cut off")
        rows = self.bits[self.at : self.at + n * width].reshape(n, width).astype(np.int64) if width else np.zeros((n, 0), np.int64)
        self.at += n * width
        if not width:
            return np.zeros(n, np.int64)
        weights = 1 << np.arange(width - 1, -1, -1, dtype=np.int64)
        weights[0] = -weights[0]
        return rows @ weights

    def rice(self, n: int, k: int) -> np.ndarray:
        """``n`` Rice codes of parameter ``k`` as signed numbers."""
        if not n:
            return np.zeros(0, np.int64)
        base, end = self.at, self.end
        jump = np.empty(end - base + 1, np.intp)
        np.add(self.next[base:], 1 + k - base, out=jump[:-1])
        jump[-1] = end - base
        np.minimum(jump, end - base, out=jump)
        jumps = [jump]
        if n >= 64:
            for _ in range(4):
                jumps.append(jumps[-1].take(jumps[-1]))
        step, far = 1 << (len(jumps) - 1), jumps[-1]
        heads, p = [], 0
        for _ in range(-(-n // step)):
            heads.append(p)
            p = far[p]
        starts = np.array(heads, np.intp)
        for j in reversed(jumps[:-1]):
            both = np.empty((len(starts), 2), np.intp)
            both[:, 0], both[:, 1] = starts, j.take(starts)
            starts = both.reshape(-1)
        starts = starts[:n] + base
        if starts[-1] >= end or jump[starts[-1] - base] + base > end or self.next[starts[-1]] >= end:
            raise FlacError("residual cut off")
        stops = self.next.take(starts)
        if stops[-1] + k >= end:
            raise FlacError("residual cut off")
        u = stops - starts
        for b in range(k):
            u = u << 1 | self.bits[stops + 1 + b]
        self.at = int(stops[-1]) + 1 + k
        return (u >> 1) ^ -(u & 1)


def _residual(bits: _Bits, block: int, order: int) -> np.ndarray:
    method, partitions = bits.unsigned(2), 1 << bits.unsigned(4)
    if method > 1 or block % partitions or block // partitions < order:
        raise FlacError("bad residual")
    width, out = 4 + method, []
    for i in range(partitions):
        k, n = bits.unsigned(width), block // partitions - (order if i == 0 else 0)
        out.append(bits.signed_row(n, bits.unsigned(5)) if k == (1 << width) - 1 else bits.rice(n, k))
    return np.concatenate(out) if len(out) > 1 else out[0]


@dataclass
class _Subframe:
    samples: np.ndarray | None
    warm: np.ndarray | None = None
    residual: np.ndarray | None = None
    coefficients: np.ndarray | None = None
    shift: int = 0
    wasted: int = 0


def _read_subframe(bits: _Bits, block: int, depth: int) -> _Subframe:
    if bits.unsigned(1):
        raise FlacError("bad subframe")
    kind, wasted = bits.unsigned(6), 0
    if bits.unsigned(1):
        stop = int(bits.next[bits.at]) if bits.at < bits.end else bits.end
        wasted = stop - bits.at + 1
        bits.at = stop + 1
    depth -= wasted
    if kind == 0:
        return _Subframe(np.full(block, bits.signed(depth), np.int64) << wasted)
    if kind == 1:
        return _Subframe(bits.signed_row(block, depth) << wasted)
    if 8 <= kind <= 12:
        order = kind - 8
        warm = bits.signed_row(order, depth)
        residual = _residual(bits, block, order)
        return _Subframe(_fixed(warm, residual, order) << wasted)
    if kind >= 32:
        order = kind - 31
        warm = bits.signed_row(order, depth)
        precision, shift = bits.unsigned(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise FlacError("bad predictor")
        coefficients = bits.signed_row(order, precision)
        return _Subframe(None, warm, _residual(bits, block, order), coefficients, shift, wasted)
    raise FlacError("reserved subframe")


def _fixed(warm: np.ndarray, residual: np.ndarray, order: int) -> np.ndarray:
    """Undo ``order`` differences; the warm-up samples give the start of each sum."""
    x, lead = residual, [warm]
    for _ in range(order):
        lead.append(np.diff(lead[-1]))
    for i in range(order - 1, -1, -1):
        x = np.cumsum(np.concatenate([lead[i][-1:], x]))[1:]
    return np.concatenate([warm, x])


def _restore(jobs: list[_Subframe]) -> None:
    """Run the linear predictors of many subframes side by side, one step a sample."""
    jobs = sorted(jobs, key=lambda j: (len(j.coefficients), -len(j.residual)))
    at = 0
    while at < len(jobs):
        order, end = len(jobs[at].coefficients), at
        while end < len(jobs) and len(jobs[end].coefficients) == order and end - at < 2048:
            end += 1
        own = jobs[at:end]
        lengths = np.array([len(j.residual) for j in own])  # falling
        width = int(lengths[0])
        x = np.zeros((order + width, len(own)), np.int64)
        for i, j in enumerate(own):
            x[:order, i] = j.warm
            x[order : order + len(j.residual), i] = j.residual
        taps = np.stack([j.coefficients[::-1] for j in own], axis=1)
        shift = np.array([j.shift for j in own])
        alive = len(own) - np.searchsorted(lengths[::-1], np.arange(width), side="right")
        for t, m in enumerate(alive.tolist()):
            x[order + t, :m] += np.einsum("ij,ij->j", x[t : t + order, :m], taps[:, :m]) >> shift[:m]
        for i, j in enumerate(own):
            j.samples = x[: order + len(j.residual), i] << j.wasted
        at = end


def decode_frames(pieces: list[tuple[np.ndarray, Frame]]) -> list[np.ndarray | None]:
    """Samples (block x channels) of each frame, None where it can't be decoded."""
    parsed: list[list[_Subframe] | None] = []
    for raw, frame in pieces:
        if not frame.ok:
            parsed.append(None)
            continue
        try:
            bits = _Bits(raw[frame.body : frame.stop - 2])
            channels = frame.assignment + 1 if frame.assignment < 8 else 2
            sides = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(frame.assignment, (0,) * channels)
            parsed.append([_read_subframe(bits, frame.block, frame.depth + s) for s in sides])
        except (FlacError, IndexError):
            parsed.append(None)
    _restore([s for subs in parsed if subs for s in subs if s.samples is None])
    out: list[np.ndarray | None] = []
    for (_, frame), subs in zip(pieces, parsed, strict=True):
        if subs is None:
            out.append(None)
            continue
        a = [s.samples for s in subs]
        if frame.assignment == 8:
            a[1] = a[0] - a[1]
        elif frame.assignment == 9:
            a[0] = a[0] + a[1]
        elif frame.assignment == 10:
            middle = 2 * a[0] + (a[1] & 1)
            a = [(middle + a[1]) >> 1, (middle - a[1]) >> 1]
        out.append(np.stack(a, axis=1))
    return out


def pcm_bytes(samples: np.ndarray, depth: int) -> bytes:
    """Little-endian signed PCM in whole bytes a sample, channels interleaved."""
    size = -(-depth // 8)
    if size == 1:
        return samples.astype(np.int8).tobytes()
    if size == 2:
        return samples.astype("<i2").tobytes()
    return samples.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


@dataclass
class Decoded:
    """What a stream's metadata and frames say: ``error`` where it is no stream; ``md5_ok`` once all frames are seen."""

    stream: Stream | None
    error: str | None = None
    samples: int = 0
    good: bool = True
    digest: object = field(default_factory=hashlib.md5)

    @property
    def md5_ok(self) -> bool:
        stream = self.stream
        return bool(stream and self.good and self.samples == stream.samples and stream.md5 in (self.digest.digest(), bytes(16)))


def decode_blocks(media: list[bytes | None], group: int = DECODED) -> Iterator[tuple[int, Decoded, Frame | None, np.ndarray | None]]:
    """(number of the stream, its state, frame, samples or None) of all streams, in order; a value that is no stream has one item without frame.

    Frames are decoded ``group`` samples at once, so memory doesn't grow with the length of a stream.
    """
    held: list[tuple[int, Decoded, np.ndarray, Frame]] = []
    size = 0

    def flush() -> Iterator[tuple[int, Decoded, Frame | None, np.ndarray | None]]:
        for (i, d, _, frame), samples in zip(held, decode_frames([(raw, f) for *_, raw, f in held]), strict=True):
            if samples is None:
                d.good = False
            else:
                d.samples += len(samples)
                d.digest.update(pcm_bytes(samples, d.stream.depth))
            yield i, d, frame, samples
        held.clear()

    for i, data in enumerate(media):
        try:
            stream = read_metadata(data or b"")
            frames = find_frames(data, stream)
        except FlacError as e:
            yield from flush()
            size = 0
            yield i, Decoded(None, str(e)), None, None
            continue
        state, raw = Decoded(stream), np.frombuffer(data, np.uint8)
        if not frames:
            yield from flush()
            size = 0
            yield i, state, None, None
        for frame in frames:
            held.append((i, state, raw, frame))
            size += max(frame.block, 1)
            if size >= group:
                yield from flush()
                size = 0
    yield from flush()
