"""Scanning of UTF-8 bytes in Arrow's buffers: classes of bytes, words, and words of one spelling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are scanned at once; a longer text is scanned in pieces that end at white space.
AT_ONCE = 1 << 20
#: Multiplier of the words' hashes (odd, so that it has an inverse modulo 2**64), and seed of the bytes' weights.
MULTIPLIER, SEED = 0x9E3779B97F4A7C15, 11
#: ASCII white space, and what counts as a symbol.
SPACES, SYMBOLS = b" \t\n\v\f\r", b"#$%&*|"

SPACE, CAPITAL, SYMBOL, LEADING = 1, 2, 4, 8


def classes(spaces: bytes = SPACES) -> np.ndarray:
    """Classes of each byte: white space, A-Z, a symbol, and whether it is the first byte of a code point."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(spaces)] |= SPACE
    out[ord("A") : ord("Z") + 1] |= CAPITAL
    out[list(SYMBOLS)] |= SYMBOL
    out[[b for b in range(256) if b & 0xC0 != 0x80]] |= LEADING
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Counts over a buffer of UTF-8 bytes."""

    def __init__(self, at_once: int = AT_ONCE, weight: np.ndarray | None = None, spaces: bytes = SPACES):
        self.at_once, self.classes = at_once, classes(spaces)
        self.weight = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) if weight is None else weight
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(MULTIPLIER, n), powers(pow(MULTIPLIER, -1, 2**64), n)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple:
        """Of documents that lie one behind another in `data`, document i from bounds[i] to bounds[i + 1]: first and last
        place of each word, its document and its hash, and the prefix sums of the classes."""
        kinds = self.classes[data]
        inside = (kinds & SPACE) == 0
        # a word begins where the byte before is white space or another document's
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        begins = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        self.grow(len(data) + 1)
        upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.weight[data] * self.up[: len(data)], out=upto[1:])
        hashes = (upto[ends] - upto[begins]) * self.down[begins]
        of = np.searchsorted(bounds, begins, side="right") - 1
        return begins, ends, of, hashes, kinds

    def distinct(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, one of each distinct one of each document. Equal hash, length and document make a run; a word
        whose bytes are those of its run's first is a repeat; a run with other words is told apart by its bytes."""
        length = ends - begins
        order = np.lexsort((length, hashes, of))
        same = np.zeros(len(order), dtype=bool)
        a, b = order[:-1], order[1:]
        same[1:] = (of[a] == of[b]) & (hashes[a] == hashes[b]) & (length[a] == length[b])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        at = np.flatnonzero(same)
        clash = self.unequal(data, begins[order[at]], begins[order[first[at]]], length[order[at]])
        kept = order[~same]
        if clash.any():
            more = []
            for run in np.unique(first[at[clash]]):
                seen = {data[begins[order[run]] : ends[order[run]]].tobytes()}
                for k in order[at[first[at] == run]]:
                    word = data[begins[k] : ends[k]].tobytes()
                    if word not in seen:
                        seen.add(word)
                        more.append(k)
            kept = np.concatenate([kept, np.array(more, dtype=kept.dtype)])
        return kept

    def groups(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, one of each distinct one, and for every word the place of its like among these. Words whose bytes
        are not those of the first of their hash are one each, so that what is said of a word's like always holds."""
        _, reps, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        length = ends - begins
        odd = length != length[reps[inverse]]
        same = np.flatnonzero(~odd)
        odd[same[self.unequal(data, begins[same], begins[reps[inverse[same]]], length[same])]] = True
        if odd.any():
            own = np.flatnonzero(odd)
            inverse[own] = len(reps) + np.arange(len(own))
            reps = np.concatenate([reps, own])
        return reps, inverse

    def unequal(self, data: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes from left[i] and from right[i] on, length[i] of them, differ."""
        out = np.zeros(len(left), dtype=bool)
        lo = 0
        while lo < len(left):
            total = np.cumsum(length[lo : lo + self.at_once])
            hi = lo + max(1, int(np.searchsorted(total, self.at_once, side="right")))
            n = length[lo:hi]
            starts = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(starts, n)
            differ = data[np.repeat(left[lo:hi], n) + step] != data[np.repeat(right[lo:hi], n) + step]
            out[lo:hi] = np.bitwise_or.reduceat(differ, starts)
            lo = hi
        return out

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Words, distinct words, capitals, symbols and code points (columns) of each document (row)."""
        n = len(bounds) - 1
        out = np.zeros((n, 5), dtype=np.int64)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + self.at_once, side="right")) - 1)
            if bounds[hi] - bounds[lo] > self.at_once:
                out[lo] = self.long(data[bounds[lo] : bounds[hi]])
            else:
                part, cut = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                begins, ends, of, hashes, kinds = self.words(part, cut)
                out[lo:hi, 0] = np.bincount(of, minlength=hi - lo)
                out[lo:hi, 1] = np.bincount(of[self.distinct(part, begins, ends, of, hashes)], minlength=hi - lo)
                out[lo:hi, 2:] = self.sums(kinds, cut)
            lo = hi
        return out

    def sums(self, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Capitals, symbols and code points between the bounds, by prefix sums."""
        out = np.empty((len(bounds) - 1, 3), dtype=np.int64)
        upto = np.zeros(len(kinds) + 1, dtype=np.int64)
        for k, kind in enumerate((CAPITAL, SYMBOL, LEADING)):
            np.cumsum((kinds & kind) != 0, out=upto[1:])
            out[:, k] = upto[bounds[1:]] - upto[bounds[:-1]]
        return out

    def long(self, data: np.ndarray) -> np.ndarray:
        """The counts of one document, piece by piece; only its distinct words are kept from piece to piece."""
        out = np.zeros(5, dtype=np.int64)
        begins, ends, hashes = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
        at = 0
        while at < len(data):
            end = self.boundary(data, at + self.at_once)
            part, cut = data[at:end], np.array([0, end - at])
            b, e, of, h, kinds = self.words(part, cut)
            out[0] += len(b)
            out[2:] += self.sums(kinds, cut)[0]
            kept = self.distinct(part, b, e, of, h)
            begins, ends, hashes = np.concatenate([begins, b[kept] + at]), np.concatenate([ends, e[kept] + at]), np.concatenate([hashes, h[kept]])
            kept = self.distinct(data, begins, ends, np.zeros(len(begins), np.int64), hashes)
            begins, ends, hashes = begins[kept], ends[kept], hashes[kept]
            at = end
        out[1] = len(begins)
        return out

    def boundary(self, data: np.ndarray, at: int) -> int:
        """The first place from `at` on behind white space, or the end."""
        while at < len(data):
            spaces = np.flatnonzero(self.classes[data[at - 1 : at - 1 + self.at_once]] & SPACE)
            if len(spaces):
                return at + int(spaces[0])
            at += self.at_once
        return len(data)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column without nulls, as they lie in Arrow's buffers."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]
