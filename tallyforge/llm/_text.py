"""Vectorised text primitives shared by the Arrow-batch operators.

A batch of documents is one byte buffer plus offsets.  Words are found with a
256-entry class table, and each word gets a 64-bit hash by masked 8-byte
loads, so the cost is a few numpy operations per word and no Python object is
made for a word unless an operator asks for it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U8, U64 = np.uint8, np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_S33 = U64(33)

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=U8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+` after lower-casing.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all
#: bytes of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)
#: Words of more bytes are hashed one at a time.
_LONG = 256


def mix(x):
    """Finalizer of a 64-bit hash, elementwise."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text.

    Offsets are int64 and start at 0; bytes has 8 spare zero bytes at its end.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(8, U8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    lo, hi = off[0], off[-1]
    out = np.zeros(hi - lo + 8, U8)
    if hi > lo:
        out[: hi - lo] = np.frombuffer(data, dtype=U8)[lo:hi]
    return out, off - lo


def chunks(offsets: np.ndarray, limit: int = 1 << 21):
    """Row ranges of about `limit` bytes; a row is never split."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
    """(starts, ends, first): byte spans of the words and, for each row, the
    index of its first word (one entry more than rows).  `data` is already
    lower-cased; its 8 spare bytes aren't read as text."""
    n = int(offsets[-1])
    inside = keep[data[:n]]
    edge = np.empty(n, bool)
    if n:
        edge[0] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        cut = offsets[1:-1]
        edge[cut[cut < n]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], n)
    word = inside[at] if n else np.zeros(0, bool)
    starts, ends = at[word], ends[word]
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes everywhere."""
    size = ends - starts
    h = (size.astype(U64) + U64(seed & (2**64 - 1))) * U64(0x9E3779B97F4A7C15)
    if not len(starts):
        return h
    load = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at, left, who = starts, size, None
    long = np.flatnonzero(size > _LONG)
    if len(long):
        who = np.flatnonzero(size <= _LONG)
        at, left = starts[who], size[who]
    while len(at):
        part = mix(load[at] & _MASK[np.minimum(left, 8)])
        if who is None:
            h = mix(h ^ part)
        else:
            h[who] = mix(h[who] ^ part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    for i in long:
        raw = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=(seed & (2**64 - 1)).to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(raw, "little")
    return h


def hash_word(word: str | bytes, seed: int = 0) -> int:
    """hash_spans() of one word."""
    raw = word.encode() if isinstance(word, str) else word
    data = np.frombuffer(raw + bytes(8), dtype=U8)
    return int(hash_spans(data, np.array([0]), np.array([len(raw)]), seed)[0])


def hashed_words(column, keep: np.ndarray, limit: int = 1 << 21):
    """(hashes, first) of all words of a string column, A-Z lower-cased; `first`
    has the index of each row's first word and then the number of words."""
    data, offsets = buffers(column)
    hashes, first, base = [], [np.zeros(1, np.int64)], 0
    for a, b in chunks(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        part = np.empty(hi - lo + 8, U8)
        part[: hi - lo] = LOWER[data[lo:hi]]
        part[hi - lo :] = 0
        s, e, f = words(part, offsets[a : b + 1] - lo, keep)
        hashes.append(hash_spans(part, s, e))
        first.append(f[1:] + base)
        base += len(s)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(first).astype(np.int64)


def slices(batches, rows: int = 1 << 30, size: int = 1 << 23):
    """Record batches cut so that each holds about `size` bytes at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, n, int(n * size / max(1, batch.nbytes))))
        for a in range(0, n, step):
            yield batch.slice(a, step)
