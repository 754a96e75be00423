"""Vectorised text helpers used inside tasks: words and shingles as hashes.

A batch of texts is one Arrow string column: a byte buffer and offsets. Words
are byte spans found with numpy over the whole buffer; nothing is looped per
word. Word hashes are polynomial hashes modulo 2**64 with an odd base, taken
from one running sum over the buffer, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that separate words: white space (0x09-0x0D and 0x20).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words when only ASCII letters, digits and bytes from 0x80 on are word bytes.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_TABLES: dict[int, np.ndarray] = {}


def _power_table(b: int, n: int) -> np.ndarray:
    """b ** 0 to b ** (n - 1) modulo 2**64, from a table that only grows."""
    table = _TABLES.get(b)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.ones(size, np.uint64)
        done, factor = 1, b  # factor: b ** done
        while done < size:
            np.multiply(table[:done], np.uint64(factor), out=table[done:2 * done])
            done, factor = 2 * done, factor * factor % 2**64
        _TABLES[b] = table
    return table[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse."""
    return _power_table(int(BASE), n), _power_table(pow(int(BASE), -1, 2**64), n)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets into them; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n+1 offsets of texts into them."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = np.empty(len(raw) + 1, bool)
    np.logical_not(separators[raw], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] = inside[cut]  # a text's first byte begins a word even where the text before ends in one
    starts = np.flatnonzero(begins)
    ends_here = inside[:-1] & ~inside[1:]
    ends_here[cut - 1] = inside[cut - 1]
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    run = np.empty(len(raw) + 1, np.uint64)
    run[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts])


def chunks(raw: np.ndarray, off: np.ndarray, most: int = 1 << 21):
    """Runs of whole texts of about ``most`` bytes (a longer text alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words in each text, and n+1 offsets of texts
    into them. A text of fewer words, but not none, has one: all its words."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate(([0], np.cumsum(count)))
    if not len(words):
        return np.zeros(0, np.uint64), out_at
    first = np.repeat(at[:-1] - out_at[:-1], count) + np.arange(out_at[-1])  # word that each shingle begins at
    pad = np.concatenate((words, np.zeros(k, np.uint64)))
    h = np.zeros(len(first), np.uint64)
    for i in range(k):
        h = h * BASE + pad[first + i]
    for t in np.flatnonzero((n > 0) & (n < k)):  # short texts: their own words only
        x = np.uint64(int(n[t]))
        for w in words[at[t]:at[t + 1]]:
            x = np.uint64((int(x) * int(BASE) + int(w)) % 2**64)
        h[out_at[t]] = x
    return mix(h), out_at
