"""Numpy kernels over Arrow string buffers: words, 64-bit word hashes and shingle hashes.

All of them work on whole texts. A batch is cut into pieces of about ``PIECE`` bytes at document
ends (within a longer document, between words), so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
U64 = np.uint64

#: Word bytes after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, np.bool_)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of tokens: all but space and \t \n \v \f \r.
SOLID = np.ones(256, np.bool_)
SOLID[0x20] = SOLID[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
AS_IS = np.arange(256, dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        out = np.empty(n, U64)
        out[0] = 1
        done = 1
        while done < n:  # doubling: p^(i+done) = p^i * p^done
            take = min(done, n - done)
            with np.errstate(over="ignore"):
                out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
            done += take
        if n > 4 * PIECE:
            return out
        _powers[key] = out
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of consecutive documents: ``of`` is the document's index in the batch."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word offsets of the documents docs[0]..docs[-1], with one more at the end
    docs: range
    buf: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs.start, self.docs.stop), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets (rows + 1) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _hash_piece(buf: np.ndarray, solid: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``buf``; no word crosses a position in ``breaks``."""
    n = len(buf)
    edge = np.empty(n + 1, np.bool_)
    edge[0] = edge[n] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:n])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    keep = solid[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, U64)
        run[0] = 0
        np.cumsum((buf.astype(U64) + U64(1)) * _power(_BASE, n), out=run[1:])
        hashes = mix((run[ends] - run[starts]) * _power(_BASE_INV, n)[starts])
    return starts, ends, hashes


def words(column: pa.Array, kind: np.ndarray = ALNUM, piece: int = PIECE, fold: np.ndarray = LOWER) -> Iterator[Words]:
    """The words of a string column, in runs of whole documents of about ``piece`` bytes; ``fold`` maps bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = buffers(column)
    rows, row = len(column), 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + piece, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        buf = fold[data[lo:hi]]
        solid = kind[buf]
        inner = offsets[row : stop + 1] - lo
        if hi - lo == 0:
            empty = np.zeros(0, np.int64)
            yield Words(np.zeros(0, U64), empty, empty, np.zeros(stop - row + 1, np.int64), range(row, stop), buf)
        else:
            if stop - row == 1 and hi - lo > 2 * piece:
                starts, ends, hashes = _long(buf, solid, piece)
            else:
                starts, ends, hashes = _hash_piece(buf, solid, inner[(inner > 0) & (inner < hi - lo)])
            yield Words(hashes, starts, ends, np.searchsorted(starts, inner), range(row, stop), buf)
        row = stop


def _long(buf: np.ndarray, solid: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One long document, hashed piece by piece; cuts fall between words."""
    cuts, at = [0], 0
    while at < len(buf):
        to = min(at + piece, len(buf))
        while to < len(buf):
            gap = np.flatnonzero(~solid[to : to + piece])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + piece, len(buf))
        cuts.append(to)
        at = to
    none = np.zeros(0, np.int64)
    parts = [[x + (a if i < 2 else 0) for i, x in enumerate(_hash_piece(buf[a:b], solid[a:b], none))] for a, b in zip(cuts, cuts[1:]) if b > a]
    for p in parts:
        p[2] = p[2].astype(U64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their offsets by document.

    A document of fewer, but not no, words has one shingle of all its words.
    """
    counts = np.diff(w.first)
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(have)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - w.first[:-1], have)
    h = w.hashes
    with np.errstate(over="ignore"):
        short = np.repeat(counts < n, have)
        out = np.zeros(len(at), U64)
        full = at[~short]
        acc = np.zeros(len(full), U64)
        for k in range(n):
            acc = acc * U64(_BASE) + h[full + k]
        out[~short] = mix(acc)
        for i in np.flatnonzero(short):
            doc = int(np.searchsorted(offsets, i, "right")) - 1
            acc1 = U64(0)
            for x in h[w.first[doc] : w.first[doc + 1]]:
                acc1 = acc1 * U64(_BASE) + x
            out[i] = mix(np.array([acc1 ^ U64(counts[doc])]))[0]
    return out, offsets


def unique_by_document(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, with new offsets."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    keep = np.ones(len(values), np.bool_)
    keep[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[keep], np.searchsorted(of[keep], np.arange(len(offsets)))


def hex_rows(packed: np.ndarray) -> list[str]:
    """Each row of a byte matrix as lower-case hex."""
    width = packed.shape[1] * 2
    text = packed.tobytes().hex()
    return [text[i : i + width] for i in range(0, len(text), width)]
