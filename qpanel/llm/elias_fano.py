"""Elias-Fano sequences in numpy, and files of arrays in the shared folder.

A sorted sequence of n numbers below u is kept as n packed low parts of
log2(u / n) bits, and the high parts in unary: about 2 + log2(u / n) bits a
number.  ``get`` and ``find`` work on whole arrays of positions or values.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np

_BLOCK = 4  # words of 64 bits between two counts
_IN_BYTE = np.full(256 * 8, 8, np.int64)  # place of the k-th one of a byte, at byte * 8 + k
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _IN_BYTE[_b * 8 + _k] = _i
_U = [np.uint64(x) for x in range(65)]
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)  # one, or the top bit, in each byte
_PAIR, _NIBBLE, _BYTE = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _as_words(bits: np.ndarray, spare: int = 1) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros((len(raw) + 7) // 8 + spare, np.uint64)
    out.view(np.uint8)[:len(raw)] = raw
    return out


def _in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word, by sums over bytes."""
    s = w - ((w >> _U[1]) & _PAIR)
    s = (s & _NIBBLE) + ((s >> _U[2]) & _NIBBLE)
    s = ((s + (s >> _U[4])) & _BYTE) * _EACH                 # ones up to the end of each byte
    k = k.astype(np.uint64)
    byte = np.bitwise_count((((k * _EACH) | _TOP) - s) & _TOP).astype(np.uint64)  # bytes that end before it
    byte = np.minimum(byte, _U[7])
    shift = byte << _U[3]
    k = k - (((s << _U[8]) >> shift) & np.uint64(0xFF))
    return (shift + _IN_BYTE[(((w >> shift) & np.uint64(0xFF)) * _U[8] + np.minimum(k, _U[7])).astype(np.int64)].astype(np.uint64)).astype(np.int64)


def _select(words: np.ndarray, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th (from 0) one, or zero with ``flip``; ``counts``: ones
    (zeros) before each block."""
    block = np.searchsorted(counts, k, "right") - 1
    left = (k - counts[block]).astype(np.uint8)              # a block has 256 bits
    ones = np.bitwise_count(words[:len(words) // _BLOCK * _BLOCK].reshape(-1, _BLOCK)[block])
    if flip:
        ones = 64 - ones
    at, before, sums = block * _BLOCK, np.zeros(len(k), np.uint8), np.zeros(len(k), np.uint8)
    for i in range(_BLOCK - 1):  # on to the word that holds it
        sums += ones[:, i]
        on = left >= sums
        at += on
        before += ones[:, i] * on
    w = words[at]
    return at * 64 + _in_word(~w if flip else w, left - before)


def _bits_from(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 64 bits that begin at place ``bit``."""
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    return (words[word] >> shift) | (words[word + 1] << _U[1] << (_U[63] - shift))


class EliasFano:
    """View of the arrays made by ``encode``."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in arrays[f"{name}.meta"])
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self.ones, self.zeros = arrays[f"{name}.ones"], arrays[f"{name}.zeros"]

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((n + (int(high[-1]) if n else 0) + 2), np.uint8)
        unary[high + np.arange(n)] = 1
        words = _as_words(unary, 1 + _BLOCK)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if n and bits:  # low parts do not overlap, so a word is the sum of its shares
            part, bit = values & np.uint64((1 << bits) - 1), np.arange(n) * bits
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            for at, share in ((word, part << shift), (word + 1, np.where(shift > 0, part >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))):
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                low[at[first]] += np.add.reduceat(share, first)
        count = np.bitwise_count(words[:len(words) // _BLOCK * _BLOCK]).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        return {f"{name}.meta": np.array([n, bits], np.int64), f"{name}.low": low, f"{name}.high": words,
                f"{name}.ones": ones, f"{name}.zeros": np.arange(len(ones)) * 64 * _BLOCK - ones}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        return _bits_from(self.low, i * self.low_bits) & np.uint64((1 << self.low_bits) - 1)

    def value(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``, whose ones stand at ``place``."""
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def place(self, i: np.ndarray) -> np.ndarray:
        """Places of the ones that stand for positions ``i``."""
        return _select(self.high, self.ones, i, False)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        return self.value(self.place(i), i) if len(i) else np.zeros(0, np.uint64)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions ``i`` and at the positions after them: the next
        one is looked for in the 64 bits that follow."""
        place = self.place(i)
        view = _bits_from(self.high, place + 1)
        after = place + 1 + np.bitwise_count(~view & (view - _U[1]))
        far = np.flatnonzero(view == 0)
        after[far] = self.place(i[far] + 1)
        return self.value(place, i), self.value(after, i + 1)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None,
             bit: np.ndarray | None = None) -> np.ndarray:
        """Successor search: first position in [start, end) whose value is at
        least x, given that x is at least all values before start; -1 if the
        value there is not x.  ``bit``: the place after the one of position
        start - 1 (0 at the start), from where the search goes on if x is near."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = (high >= 0) & (high < int(self.zeros[-1]) - 64)  # beyond: larger than any value
        h = np.where(inside, high, 0)
        # the place after the h-th zero: the values with this high part follow
        if bit is None:
            place, far = np.zeros(len(x), np.int64), np.flatnonzero(h > 0)
        else:
            skip = h - (bit - start)                          # zeros still to pass
            gaps = ~_bits_from(self.high, bit)
            near = skip <= np.bitwise_count(gaps)
            place = bit + np.where(skip > 0, _in_word(gaps, np.where(near, np.maximum(skip, 1) - 1, 0)) + 1, 0)
            far = np.flatnonzero(~near)
        place[far] = _select(self.high, self.zeros, h[far] - 1, True) + 1
        lo = place - h
        view = _bits_from(self.high, place)
        run = np.bitwise_count(view & ~(view + _U[1])).astype(np.int64)
        hi = lo + run
        long = np.flatnonzero(run >= 64)
        hi[long] = _select(self.high, self.zeros, h[long], True) - h[long]
        if start is not None:
            lo = np.maximum(lo, start)
            hi = np.minimum(hi, end)
        out = np.full(len(x), -1, np.int64)
        open_ = np.flatnonzero(inside & (lo < hi))
        if not self.low_bits:
            out[open_] = lo[open_]
            return out
        lo, hi = lo[open_], hi[open_]
        want = x[open_] & np.uint64((1 << self.low_bits) - 1)
        while len(open_):
            mid = (lo + hi) >> 1
            low = self._lows(mid)
            same = low == want
            out[open_[same]] = mid[same]
            less = low < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            on = np.flatnonzero(lo < hi)
            open_, lo, hi, want = open_[on], lo[on], hi[on], want[on]
        return out


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; appears at once, so that a retried task may write it
    again."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (at, str(a.dtype), len(a))
        at += (a.nbytes + 7) // 8 * 8
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)

    def parts() -> Iterator[bytes]:
        yield len(top).to_bytes(8, "little") + top
        for a in arrays.values():
            yield a.tobytes() + b"\0" * (-a.nbytes % 8)

    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.writelines(parts())
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        for x in parts():
            f.write(x)
    store.move(part, path)


_open: dict[str, dict[str, np.ndarray]] = {}


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted,
    else read once a process."""
    if uri not in _open:
        path = _local(uri)
        if path is not None:
            raw = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain array: indexing a memmap costs more
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                raw = np.frombuffer(f.read_buffer(), np.uint8)
        size = int(raw[:8].view(np.int64)[0])
        head = json.loads(raw[8:8 + size].tobytes())
        _open[uri] = {k: raw[(a := 8 + size + at):a + n * np.dtype(t).itemsize].view(t) for k, (at, t, n) in head.items()}
    return _open[uri]
