"""Words of whole texts, as SQL columns and as 64-bit hashes of Arrow text batches.

The hash of a word is a polynomial over a fixed random table of byte values, modulo 2**64, mixed
at the end. Windows of words are hashed from their words' hashes. Equal words have equal hashes on
every machine; two different ones meet with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once inside a worker; about forty times as much memory is used.
PIECE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words: everything but white space; digits, Latin letters and all beyond ASCII.
NOT_SPACE, ALNUM = ~_SPACE, _ALNUM
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a batch of texts: `hash`, byte span `start`/`end`, and `first`, where the words
    of text i are first[i] to first[i + 1]. `raw` holds the texts' bytes, `offset` their bounds."""

    def __init__(self, texts: pa.Array, lower: bool, inside: np.ndarray):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, bounds, data = texts.buffers()
        offset = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if data is not None else np.zeros(0, np.uint8)
        self.raw, self.offset = raw, offset - offset[0]
        word = inside[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offset] = True
        before = np.empty_like(word)
        before[1:], before[:1] = word[:-1], False
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[:-1], after[-1:] = word[1:], False
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offset)
        self.hash = self._hashes(word, lower)

    def _hashes(self, word: np.ndarray, lower: bool) -> np.ndarray:
        values = _VALUES[_LOWER] if lower else _VALUES
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + PIECE_BYTES)))
            lo, hi = self.start[at], self.end[to - 1]
            begin = self.start[at:to] - lo
            length = self.end[at:to] - self.start[at:to]
            if to == at + 1 and length[0] > PIECE_BYTES:
                total = 0
                for k in range(lo, hi, PIECE_BYTES):  # one word longer than a piece
                    part = values[self.raw[k : min(hi, k + PIECE_BYTES)]]
                    total = (total * pow(_BASE, len(part), 1 << 64) + int((part * _powers(_BASE, len(part))[::-1]).sum(dtype=np.uint64))) % (1 << 64)
                out[at] = total
            else:
                # the last byte of a word has power 0, the one before it power 1, and so on
                back = np.repeat(begin + length - 1, np.diff(np.append(begin, hi - lo))) - np.arange(hi - lo)
                part = values[self.raw[lo:hi]] * _powers(_BASE, int(length.max()))[np.maximum(back, 0)]
                part[~word[lo:hi]] = 0
                out[at:to] = np.add.reduceat(part, begin)
            at = to
        return mix(out)

    def __len__(self) -> int:
        return len(self.hash)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index) and hash of every window of `size` words inside one text."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts())
        at = np.flatnonzero(np.arange(len(self)) + size <= last)
        return at, mix(_joined(self.hash, size)[at])


def _joined(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial over each `size` neighbours, built by doubling."""
    step, done, width, out = values, 0, 1, None
    n = len(values) - size + 1
    while size:
        if size & 1:
            tail = step[done:]
            out = tail if out is None else out[: len(tail)] * np.uint64(pow(_STEP, width, 1 << 64)) + tail
            done += width
        size >>= 1
        if size:
            step = step[:-width] * np.uint64(pow(_STEP, width, 1 << 64)) + step[width:]
            width *= 2
    return out[:n]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = run[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(run, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


# columns

#: The characters between words, for `trim` and in a regular expression.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, use) -> Column:
    """`use(v)` with `value` computed once, also where lambdas refer to it many times."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Array of the words between white space; empty for NULL."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
