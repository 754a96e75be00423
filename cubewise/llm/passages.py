"""Repeated passages, found with compact windows.

A hash function over a text's shingles has one minimum in every passage. The
Cartesian tree of the hashes tells, for each shingle, the interval in which it
is the minimum: a *compact window* stands for all passages inside it that hold
the shingle. Windows narrower than the passages looked for are left out, so
about two in ``SHINGLES`` positions remain. Equal shingles one after another
(a word said many times) are one minimum, as their first and last place.

Passages that agree share windows of the same minimum. Windows meet by

* the minimum under further hash functions (near-duplicates: a pair of texts
  must meet under at least two of ``MINIMA``), and
* under the first hash function, the minimum with the 23 shingles after or
  before it: a passage of ``SHINGLES`` equal shingles holds at least one of
  the two, wherever its minimum lies, so no exact repeat is missed.

In each group the first text is the leader, and the others are paired with it.
A pair's windows are rectangles, an interval of one text by an interval of the
other. They are joined by a sweep along each band of diagonals: a place is
kept where the rectangles of two functions at least share room for a passage
that holds both minima, or where shingles are equal as far as a window with
room reaches. Kept places are verified on the texts.

Where a minimum is not covered by a verified passage then, its leader was not
the right one. All windows of such groups meet again under two functions at
once: within each text the same sweep joins the windows of every two
functions that a passage can lie in, and their two minima together are the
key of a new, far smaller group. Its members are compared by the shingles of
their windows, in blocks if there are many. Windows that met by equal shingles but are not
covered by a verified passage as far as they reach may still repeat in a third
text: they are resolved exactly, by all their runs of ``SHINGLES`` shingles.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .scratch import Scratch, few, read_table

WORDS = 5
#: Passages of more than 50 words: 51 words are 47 shingles.
LEAST_WORDS = 51
SHINGLES = LEAST_WORDS - WORDS + 1
SIDE = SHINGLES // 2
#: Further hash functions, whose minima alone are compared.
MINIMA = 6
#: Marks the last place of a run of equal shingles in a window's kind.
LAST = 8
#: Shingles within which an alignment goes on after a break, on any diagonal.
BAND = 32
#: Two passages of at least ``SHINGLES`` that are 0.8 similar have so many in common: m / (2n - m) >= 0.8.
LEAST_COMMON = -(-8 * SHINGLES // 9)
#: Shingles that a window is known to reach to either side of its minimum.
FAR = 255
#: Shingles kept on either side of a place whose group is compared in blocks, and rows of a block, about.
REACH = 2 * SHINGLES
BLOCK = 1024
#: Pairs of windows that are compared at a time, and bits by which it is told that two have little in common.
PAIRS = 1_000_000
MARKS = 1024
#: Keys that are broadcast.
KEYS = 200_000
#: Keys that Spark would not broadcast by itself either.
HASHED = 1_000_000
#: Windows that are packed, or met, at a time; buckets of keys at least; bytes of a bucket that stay in memory.
HELD = 500_000
BUCKETS = 1024
SPOOLED = 1 << 26
#: Passages that are broadcast to be cut out; more are shuffled.
CUTS = 500_000


def _place(centre, left, right):
    """A window in one number: its minimum, and how far it reaches left and right (as far as ``FAR``)."""
    return (centre << 16) | (np.minimum(left, FAR) << 8) | np.minimum(right, FAR)


def _window(place):
    """Centre, first and last shingle of a window."""
    centre = place >> 16
    return centre, centre - (place >> 8 & FAR), centre + (place & FAR)


def _texts(column):
    """Of each chunk of texts: first row, byte spans of words, shingles and their offsets."""
    raw, off = K.buffers(column)
    for i, j, r, o in K.chunks(raw, off, 1 << 20):
        starts, ends, at = K.word_spans(r, o, K.SPACE)
        sh, sat = K.shingles(K.word_hashes(K.LOWER[r], starts, ends), at, WORDS)
        yield i, j, at, sh, sat


def _intervals(at: np.ndarray, width: int) -> np.ndarray:
    """First place of each interval of ``width`` in each text."""
    count = np.maximum(np.diff(at) - width + 1, 0)
    return np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def _smaller(value: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, step: int) -> np.ndarray:
    """For each node the nearest one of a smaller value in the same text, ``step`` -1 before
    or 1 behind it; -1 if there is none as far as ``FAR``."""
    found = np.full(len(value), -1)
    k = np.arange(len(value))
    j = k + step
    while len(k):
        ok = (j >= 0) & (j < len(value))
        k, j = k[ok], j[ok]
        apart = first[k] - last[j] if step < 0 else first[j] - last[k]
        ok = (text[j] == text[k]) & (apart <= FAR + 1)
        k, j = k[ok], j[ok]
        less = value[j] < value[k]
        found[k[less]] = j[less]
        k, j = k[~less], j[~less] + step
    return found


def window_centres(h: np.ndarray, at: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of at least ``width`` in each text (``first``: see
    :func:`_intervals`): the text, the place of the minimum, how far the window
    reaches left and right (as far as ``FAR`` at least), and whether the place
    is the last of a run. Equal shingles one after another are one minimum. A
    passage in its window holds the first place of the run, the last one, or
    lies in it: the first and last place stand for the run, and of a longer one
    every ``width``-th, which any passage in it holds."""
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    bits = np.uint64(int(len(h)).bit_length())
    coded = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the place breaks ties: the first one wins
    least, have = coded, 1
    while have < width:  # minima of `have` values become minima of up to twice as many
        step = min(have, width - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    centre = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    centre = centre[np.diff(centre, prepend=-1) != 0]  # minima of one interval after another never go back
    new = np.append(True, h[1:] != h[:-1])  # runs of equal values
    new[at[(at > 0) & (at < len(h))]] = True
    centre = centre[new[centre]]
    begins = np.append(np.flatnonzero(new), len(h))
    end = begins[np.searchsorted(begins, centre, side="right")] - 1
    text = np.searchsorted(at, centre, side="right") - 1
    # The nearest smaller values of a node are its ancestors in the Cartesian tree, and so are centres too.
    value = coded[centre]
    before, behind = _smaller(value, centre, end, text, -1), _smaller(value, centre, end, text, 1)
    low = np.where(before >= 0, end[before] + 1, np.maximum(at[text], centre - FAR))
    high = np.where(behind >= 0, centre[behind] - 1, np.minimum(at[text + 1], end + FAR + 1) - 1)
    size = end - centre
    more = np.flatnonzero(size)
    times = (size[more] + width - 1) // width  # places after the first one
    run = np.repeat(more, times)
    place = np.minimum(centre[run] + width * (np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + 1), end[run])
    node = np.concatenate((np.arange(len(centre)), run))
    place = np.concatenate((centre, place))
    last = (place == end[node]) & (size[node] > 0)
    return text[node], place, place - low[node], high[node] - place, last


def _runs(sh: np.ndarray):
    """A function that hashes shingles a to b (without b) of the chunk."""
    up, down = K.powers(len(sh) + 1)
    run = np.empty(len(sh) + 1, np.uint64)
    run[0] = 0
    np.cumsum(sh * up[:len(sh)], out=run[1:])
    return lambda a, b: K.mix((run[b] - run[a]) * down[a])


def _windows(batches):
    """key, doc_id, place (see :func:`_place`), kind (0: equal shingles, else the hash function; ``LAST`` more at the end of a run)."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, _, _, sh, at in _texts(batch.column(1)):
            out = []
            hashed = _runs(sh)
            first = _intervals(at, SHINGLES)
            for f in range(MINIMA + 1):
                h = K.mix(sh + np.uint64(0x51ED270B * (f + 1)))
                text, c, left, right, last = window_centres(h, at, first, SHINGLES)
                place = _place(c - at[text], left, right)
                kind = f + LAST * last
                if f:
                    out.append((K.mix(h[c] + np.uint64(f)), text, place, kind))
                    continue
                after, before = right >= SIDE, left >= SIDE
                out.append((hashed(c[after], c[after] + SIDE + 1) ^ np.uint64(0xA5A5), text[after], place[after], kind[after]))
                out.append((hashed(c[before] - SIDE, c[before] + 1) ^ np.uint64(0x5A5A), text[before], place[before], kind[before]))
            key, text, place, kind = (np.concatenate(c) for c in zip(*out))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[i + text]), pa.array(place), pa.array(kind.astype(np.int8))],
                                  names=["key", "doc_id", "place", "kind"])


def _packed_windows(buckets: int):
    """A function that gives the windows of texts packed by buckets of their keys."""
    def packed(batches):
        held, size = [], 0
        for windows in _windows(batches):
            held.append(tuple(c.to_numpy() for c in windows.columns))
            size += windows.num_rows
            if size >= HELD:
                yield _packed(held, buckets)
                held, size = [], 0
        if size:
            yield _packed(held, buckets)

    return packed


def _packed(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """A row for each bucket of keys: bucket, windows (all keys, then the bytes
    of all documents and of all places with their kinds, highest ones together)."""
    key, doc, place, kind = (np.concatenate(c) for c in zip(*held))
    key = key.view(np.uint64)
    bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    key, doc, place = key[order], doc[order], (place << 4 | kind.astype(np.int64))[order]
    edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
    some = np.flatnonzero(np.diff(edge))
    doc, place = (np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8) for c in (doc, place))
    rows = [key[i:j].tobytes() + doc[i:j].T.tobytes() + place[i:j].T.tobytes() for i, j in zip(edge[some].tolist(), edge[some + 1].tolist())]
    return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "windows"])


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, doc_id, place with kind."""
    columns = []
    for row in rows:
        n = len(row) // 24
        raw = np.frombuffer(row, np.uint8)
        columns.append((raw[:8 * n].view(np.uint64), *(np.ascontiguousarray(raw[c * n:(c + 8) * n].reshape(8, n).T).view(np.int64)[:, 0] for c in (8, 16))))
    return tuple(np.concatenate(c) for c in zip(*columns))


def _grouped(key: np.ndarray, least: np.ndarray, most: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each key the least and the most of its documents and its windows."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[new], np.minimum.reduceat(least[order], new), np.maximum.reduceat(most[order], new), np.add.reduceat(size[order], new)


class _Bucket:
    """The packed rows of a bucket of keys, on disk if they are many (one key may have them all)."""

    def __init__(self):
        self.file, self.sizes = tempfile.SpooledTemporaryFile(SPOOLED), []

    def add(self, row: bytes) -> None:
        self.file.write(row)
        self.sizes.append(len(row))

    def rows(self):
        self.file.seek(0)
        for n in self.sizes:
            yield self.file.read(n)

    def parts(self):
        """All windows, about ``HELD`` at a time."""
        rows, size = [], 0
        for row in self.rows():
            rows.append(row)
            size += len(row)
            if size >= 24 * HELD:
                yield _unpacked(rows)
                rows, size = [], 0
        if rows:
            yield _unpacked(rows)

    def shared(self):
        """Rows of the windows whose key several documents have, see :data:`SHARED`."""
        parts = self.parts
        if sum(self.sizes) < 24 * HELD:
            once = list(self.parts())
            parts = lambda: once
        groups = None
        for key, doc, _ in parts():
            own = _grouped(key, doc, doc, np.ones(len(key), np.int64))
            groups = _grouped(*(np.concatenate(c) for c in zip(groups, own))) if groups else own
        several = groups[1] < groups[2]
        keys, leader, _, count = (g[several] for g in groups)
        if not len(keys):
            return
        none = np.iinfo(np.int64).max
        px = np.full((2, len(keys)), none)  # the leader's first place of each group: as a minimum alone or as the first one of a run, as the last one of a run

        def met():
            for key, doc, place in parts():
                g = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[g] == key
                g, place = g[hit], place[hit]
                yield key[hit], doc[hit], place >> 4, place & (LAST - 1), (place & LAST) > 0, g

        for _, doc, place, _, last, g in met():
            own = doc == leader[g]
            np.minimum.at(px, (last[own].astype(np.int64), g[own]), place[own])
        for key, doc, place, kind, last, g in met():
            given = (px[:, g] < none) & (doc != leader[g])
            one = np.where(given[0], px[0, g], px[1, g])
            two = np.flatnonzero(given.all(axis=0))
            row = np.concatenate((np.arange(len(g)), two))
            yield pa.record_batch([pa.array(key[row].view(np.int64)), pa.array(leader[g[row]]), pa.array(count[g[row]]), pa.array(doc[row]), pa.array(place[row]), pa.array(kind[row].astype(np.int32)),
                                   pa.array(np.concatenate((one, px[1, g[two]])), mask=~given.any(axis=0)[row]), pa.array(np.arange(len(row)) >= len(g))],
                                  names=["key", "leader", "size", "doc_id", "place", "kind", "px", "again"])


#: ``px``: a place of the leader, for windows of other documents. One that has two is a row ``again``.
SHARED = "key long, leader long, size long, doc_id long, place long, kind int, px long, again boolean"


def _by_bucket(batches):
    """Buckets of rows (bucket, packed) that come sorted by bucket."""
    at, bucket = None, _Bucket()
    for batch in batches:
        for number, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            if number != at and at is not None:
                yield bucket
                bucket = _Bucket()
            at = number
            bucket.add(row.as_py())
    if at is not None:
        yield bucket


def _shared(batches):
    """The windows that documents share."""
    for bucket in _by_bucket(batches):
        yield from bucket.shared()


def _meetings(group: np.ndarray, kind: np.ndarray, centre: np.ndarray, sides: list[np.ndarray]):
    """Sweep over windows sorted by ``group`` and ``centre``: pairs (i, j) of
    windows of two functions whose intervals, on all ``sides``, share room for
    a passage that holds both minima."""
    views = [_window(s) for s in sides]
    k = 1
    while k < len(group):
        i = np.flatnonzero((group[k:] == group[:-k]) & (centre[k:] - centre[:-k] < SHINGLES))
        if not len(i):
            return
        j = i + k
        ok = kind[i] != kind[j]
        for c, first, last in views:
            a, b = np.maximum(first[i], first[j]), np.minimum(last[i], last[j])
            ok &= (b - a + 1 >= SHINGLES) & (a <= np.minimum(c[i], c[j])) & (np.maximum(c[i], c[j]) <= b)
        yield i[ok], j[ok]
        k += 1


def _supported(batches):
    """Pairs with the seeds that are worth verifying."""
    for batch in batches:
        seeds = batch.column("seeds")
        flat = seeds.flatten()
        px, py, kind = (flat.field(f).to_numpy().astype(np.int64) for f in ("px", "py", "kind"))
        pair = pa.compute.list_parent_indices(seeds).to_numpy()
        (cx, fx, lx), (cy, fy, ly) = _window(px), _window(py)
        room = np.minimum(cx - fx, cy - fy) + np.minimum(lx - cx, ly - cy) + 1 >= SHINGLES
        keep = room & (kind == 0)
        minima = np.flatnonzero(room & (kind > 0))
        for shift in (0, BAND):  # two seeds within BAND diagonals share a band of one of both
            band = (cx - cy + shift + (1 << 40))[minima] // (2 * BAND)
            own = minima[np.lexsort((cx[minima], band, pair[minima]))]
            band = (cx - cy + shift + (1 << 40))[own] // (2 * BAND)
            group = np.cumsum((np.diff(pair[own], prepend=-1) != 0) | (np.diff(band, prepend=-1) != 0))
            for i, j in _meetings(group, kind[own], cx[own], [px[own], py[own]]):
                keep[own[i]] = keep[own[j]] = True
        size = np.bincount(pair[keep], minlength=batch.num_rows)
        rows = pa.array(np.flatnonzero(size))
        at = pa.array(np.concatenate(([0], np.cumsum(size[size > 0]))).astype(np.int32))
        yield pa.record_batch([batch.column("leader").take(rows), batch.column("doc_id").take(rows), pa.ListArray.from_arrays(at, flat.filter(pa.array(keep)))],
                              names=["leader", "doc_id", "seeds"])


def _pairs(batches):
    """:func:`_supported` of seeds that come as rows, sorted by pair."""
    def given(held):
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).to_numpy() for c in ("leader", "doc_id", "px", "py", "kind")]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        change = [np.append(True, c[1:] != c[:-1]) for c in columns]
        new = np.flatnonzero(np.logical_or.reduce(change))  # each seed once
        pair = np.flatnonzero((change[0] | change[1])[new])
        leader, doc, px, py, kind = (pa.array(c[new]) for c in columns)
        seeds = pa.ListArray.from_arrays(pa.array(np.append(pair, len(new)).astype(np.int32)), pa.StructArray.from_arrays([px, py, kind], ["px", "py", "kind"]))
        return pa.record_batch([leader.take(pa.array(pair)), doc.take(pa.array(pair)), seeds], names=["leader", "doc_id", "seeds"])

    def lists():
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < HELD // 4:
                continue
            leader, doc = (batch.column(c).to_numpy() for c in ("leader", "doc_id"))
            cut = np.flatnonzero((leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1]))
            if len(cut):  # the last pair may go on
                yield given([*held[:-1], batch.slice(0, int(cut[-1]) + 1)])
                held = [batch.slice(int(cut[-1]) + 1)]
                size = held[0].num_rows
        if held:
            yield given(held)

    return _supported(lists())


def _joint(batches):
    """Of each text's ``members`` the windows of two functions that a passage
    can lie in both of: key (of both minima), doc_id, place (the first
    minimum, and the room around it), open (both are)."""
    for batch in batches:
        members = batch.column("members")
        flat = members.flatten()
        key, place, kind, opened = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("key", "place", "kind", "open"))
        text = pa.compute.list_parent_indices(members).to_numpy()
        centre = place >> 16
        order = np.lexsort((kind, centre, text))
        key, place, kind, opened, text, centre = (v[order] for v in (key, place, kind, opened, text, centre))
        docs = batch.column("doc_id").to_numpy()
        for i, j in _meetings(text, kind, centre, [place]):
            low, high = (np.where(kind[i] < kind[j], a, b) for a, b in ((i, j), (j, i)))
            both = K.mix(key[low].view(np.uint64) * K.BASE + key[high].view(np.uint64) + (kind[low] * 64 + kind[high]).astype(np.uint64))
            (ci, fi, li), (_, fj, lj) = _window(place[i]), _window(place[j])
            yield pa.record_batch([pa.array(both.view(np.int64)), pa.array(docs[text[i]]), pa.array(_place(ci, ci - np.maximum(fi, fj), np.minimum(li, lj) - ci)),
                                   pa.array(opened[i] & opened[j])], names=["key", "doc_id", "place", "open"])


def _hopeless(m: int, i: int, j: int, rest: int, beyond: int) -> bool:
    """True if no stretch that ends beyond i and j, with m shingles in common
    so far, can be similar: not with ``rest`` more, and ``beyond`` on the other side."""
    return 9 * m - 4 * (i + j) + rest + beyond < 0  # m / (nx + ny - m) >= 0.8, as 9 m - 4 (nx + ny) >= 0


def _aligned(x: np.ndarray, y: np.ndarray, beyond: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Runs (start in x, start in y, shingles) of equal shingles, in order,
    from the start of x and y on, and whether these are all. After a break the
    nearest equal shingles within ``BAND`` go on, on the same or a neighbouring
    diagonal, else the next ones on the same diagonal, as long as it is not hopeless."""
    runs, i, j, m = [], 0, 0, 0
    while i < len(x) and j < len(y):
        n, part = min(len(x) - i, len(y) - j), 64
        size = 0
        while size < n:
            end = min(n, size + part)
            unequal = x[i + size:i + end] != y[j + size:j + end]
            if unequal.any():
                size += int(unequal.argmax())
                break
            size, part = end, 4 * part
        if size:
            runs.append((i, j, size))
            i, j, m = i + size, j + size, m + size
        if _hopeless(m, i, j, min(len(x) - i, len(y) - j), beyond):
            return runs, False
        p, q = np.nonzero(x[i:i + BAND, None] == y[None, j:j + BAND])
        if len(p):
            k = int(np.argmin((np.maximum(p, q) << 32) | abs(p - q)))
            i, j = i + int(p[k]), j + int(q[k])
        else:
            n = min(len(x) - i, len(y) - j)
            equal = np.flatnonzero(x[i:i + n] == y[j:j + n])
            if not len(equal):
                break
            i, j = i + int(equal[0]), j + int(equal[0])
    return runs, True


def _widest(x: np.ndarray, y: np.ndarray, cx: int, cy: int, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float] | None:
    """The widest stretch around a seed that is similar over both sides
    together: (start in y, shingles, start in x, similarity). ``a`` and ``b``
    are the runs to the left and to the right, counted from the seed, which is in both."""
    if len(a) * len(b) > 256:
        return _widest_of_many(x, y, cx, cy, a, b)
    m, ends = 0, []
    for i, j, n in b.tolist():
        m += n
        ends.append((9 * m - 4 * (i + j + 2 * n), i + n, j + n, m))
    ends.reverse()
    best, most, own = None, 0, -1
    for i, j, n in a.tolist():
        own += n
        start = 9 * own - 4 * (i + j + 2 * n - 2)
        for end, ei, ej, m in ends:  # the last one that is similar
            if end + start < 0:
                continue
            nx, ny, common = ei + i + n - 1, ej + j + n - 1, m + own
            wx, wy = max(nx, SHINGLES), max(ny, SHINGLES)  # shorter ones are widened by unequal shingles, as far as they stay similar
            if ny > most and wx <= len(x) and wy <= len(y) and 9 * common >= 4 * (wx + wy):
                best, most = (min(cy - (j + n) + 1, len(y) - wy), wy, min(cx - (i + n) + 1, len(x) - wx), common / (wx + wy - common)), ny
            break
    return best


def _widest_of_many(x: np.ndarray, y: np.ndarray, cx: int, cy: int, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float] | None:
    """:func:`_widest`, with arrays."""
    m = np.cumsum(b[:, 2])
    ends = 9 * m - 4 * (b[:, 0] + b[:, 1] + 2 * b[:, 2])
    own = np.cumsum(a[:, 2]) - 1
    starts = 9 * own - 4 * (a[:, 0] + a[:, 1] + 2 * a[:, 2] - 2)
    best = np.maximum.accumulate(ends[::-1])  # of the ends from the last one on
    at = len(ends) - 1 - np.searchsorted(best, -starts)
    ok = np.flatnonzero(at >= 0)
    if not len(ok):
        return None
    nx, ny = ((b[at[ok], k] + b[at[ok], 2]) + (a[ok, k] + a[ok, 2] - 1) for k in (0, 1))
    common = m[at[ok]] + own[ok]
    wx, wy = np.maximum(nx, SHINGLES), np.maximum(ny, SHINGLES)  # shorter ones are widened by unequal shingles, as far as they stay similar
    wide = np.flatnonzero((wx <= len(x)) & (wy <= len(y)) & (9 * common >= 4 * (wx + wy)))
    if not len(wide):
        return None
    k = wide[np.argmax(ny[wide])]
    sy, sx = cy - int(a[ok[k], 1] + a[ok[k], 2]) + 1, cx - int(a[ok[k], 0] + a[ok[k], 2]) + 1
    sy, sx = min(sy, len(y) - int(wy[k])), min(sx, len(x) - int(wx[k]))
    return sy, int(wy[k]), sx, int(common[k]) / int(wx[k] + wy[k] - common[k])


def _sides(x: np.ndarray, y: np.ndarray, cx: int, cy: int, whole: bool = False) -> tuple[np.ndarray, bool, np.ndarray, bool]:
    """Runs to the left and to the right of a seed, and whether these are all (``whole``: they are)."""
    more = 8 * (len(x) + len(y)) if whole else 0  # never hopeless
    right, all_right = _aligned(x[cx:], y[cy:], min(cx, cy) + more)
    left, all_left = _aligned(x[cx::-1], y[cy::-1], sum(n for *_, n in right) + more)
    return np.array(left, np.int64), all_left, np.array(right, np.int64), all_right


def _stretch(x: np.ndarray, y: np.ndarray, cx: int, cy: int) -> tuple[int, int, int, float] | None:
    """See :func:`_widest`; None if the seed is no equal shingle."""
    if not (0 <= cx < len(x) and 0 <= cy < len(y)) or x[cx] != y[cy]:
        return None
    a, _, b, _ = _sides(x, y, cx, cy)
    return _widest(x, y, cx, cy, a, b)


class _Paths:
    """Alignments of two texts that are known, so that seeds on one of them share it."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.paths: list[tuple[np.ndarray, bool, bool]] = []  # runs in order, and whether all to the left and right are there
        self.on: dict[int, list[tuple[int, int, int, int]]] = {}  # diagonal: first and last place in y of a run, its path and number

    def stretch(self, cx: int, cy: int) -> tuple[int, int, int, float] | None:
        x, y, known = self.x, self.y, False
        for first, last, p, k in self.on.get(cx - cy, ()):
            if first <= cy <= last:
                runs, all_left, all_right = self.paths[p]
                a, b = runs[k::-1].copy(), runs[k:].copy()
                a[:, 0], a[:, 1] = cx - (a[:, 0] + a[:, 2] - 1), cy - (a[:, 1] + a[:, 2] - 1)
                a[0] = 0, 0, cy - first + 1
                b[:, 0] -= cx
                b[:, 1] -= cy
                b[0] = 0, 0, last - cy + 1
                if all_right or self._enough(b, len(x) - cx, len(y) - cy, min(cx, cy)):
                    if all_left or self._enough(a, cx + 1, cy + 1, int(b[:, 2].sum())):
                        return _widest(x, y, cx, cy, a, b)
                known = True
        a, all_left, b, all_right = _sides(x, y, cx, cy, known)  # a second seed on one way: more may come, and the whole way is kept
        runs = np.concatenate((a[:0:-1], b))
        runs[:len(a) - 1, 0], runs[:len(a) - 1, 1] = cx - (a[:0:-1, 0] + a[:0:-1, 2] - 1), cy - (a[:0:-1, 1] + a[:0:-1, 2] - 1)
        runs[len(a) - 1:, 0] += cx
        runs[len(a) - 1:, 1] += cy
        back = int(a[0, 2]) - 1  # the seed's own run lies on both sides
        runs[len(a) - 1] -= back, back, -back
        for k, (i, j, n) in enumerate(runs.tolist()):
            self.on.setdefault(i - j, []).append((j, j + n - 1, len(self.paths), k))
        self.paths.append((runs, all_left, all_right))
        return _widest(x, y, cx, cy, a, b)

    @staticmethod
    def _enough(side: np.ndarray, nx: int, ny: int, beyond: int) -> bool:
        """True if the side would have ended here for this seed too."""
        i, j = (int(side[-1, k] + side[-1, 2]) for k in (0, 1))
        return _hopeless(int(side[:, 2].sum()), i, j, min(nx - i, ny - j), beyond)


def passages_of(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, kind: np.ndarray):
    """Verified passages of y that repeat in x, as (start in y, shingles,
    start in x, similarity), and the places in y of seeds of equal shingles
    (kind 0) that are not settled: no passage covers all runs of ``SHINGLES``
    around them within their window. Seeds are windows of x and of y."""
    found: list[tuple[int, int, int, float]] = []
    tried: dict[int, int] = {}  # diagonal: last place in y of the equal shingles tried there; seeds come in order
    paths = _Paths(x, y)
    cx, cy = px >> 16, py >> 16
    inside = (cx < len(x)) & (cy < len(y))
    cx, cy = cx[inside], cy[inside]
    equal = x[cx] == y[cy]
    for cx, cy in sorted(set(zip(cx[equal].tolist(), cy[equal].tolist()))):
        if tried.get(cx - cy, -1) >= cy:
            continue
        if any(s <= cy < s + n and sx <= cx < sx + n and abs(s - sx - cy + cx) < BAND for s, n, sx, _ in found):
            continue
        first, last = max(0, cy - SHINGLES + 1), min(len(y), cy + SHINGLES) - 1
        if any(s <= first and last < s + n for s, n, _, _ in found):  # all passages of SHINGLES around it are found, and longer ones have other seeds
            continue
        rest = x[cx:cx + len(y) - cy] != y[cy:cy + len(x) - cx]
        tried[cx - cy] = cy + int(rest.argmax()) - 1 if rest.any() else len(y)  # an alignment goes through all of an equal run
        passage = paths.stretch(cx, cy)
        if passage:
            found.append(passage)
    c, low, high = _window(py[kind == 0])
    low, high = np.maximum(low, c - SHINGLES + 1), np.minimum(high, c + SHINGLES - 1)
    settled = np.zeros(len(c), bool)
    for s, n, _, _ in found:
        settled |= (s <= low) & (high < s + n)
    return found, sorted(set(c[~settled].tolist()))


def _shingles_of(texts) -> list[np.ndarray]:
    return [sh[a:b] for *_, sh, at in _texts(texts) for a, b in zip(at[:-1], at[1:])]


def _verify(batches):
    """Passages (n_words > 0), and open seeds as rows of n_words 0."""
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = pa.chunked_array([part.column("xt"), part.column("yt")]).combine_chunks().dictionary_encode()  # a text of many pairs, once
            once = _shingles_of(texts.dictionary)
            both = [once[k] for k in texts.indices.to_pylist()]
            xs, ys = both[:part.num_rows], both[part.num_rows:]
            seeds = part.column("seeds")
            flat, edge = seeds.flatten(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(seeds).to_numpy())))
            px, py, kind = (flat.field(f).to_numpy() for f in ("px", "py", "kind"))
            for x, y, lead, doc, i, j in zip(xs, ys, part.column("leader").to_pylist(), part.column("doc_id").to_pylist(), edge, edge[1:]):
                found, rest = passages_of(x, y, px[i:j], py[i:j], kind[i:j])
                rows += [(doc, s, n + WORDS - 1, lead, sx, sim) for s, n, sx, sim in found]
                rows += [(doc, c, 0, lead, 0, 0.0) for c in rest]
        yield _batch(rows)


NAMES = ["doc_id", "start_word", "n_words", "source_id", "source_word", "similarity"]
SCHEMA = "doc_id long, start_word long, n_words long, source_id long, source_word long, similarity double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64()]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


def _surroundings(batches):
    """For each place of a text's ``members`` the shingles of its window, at
    most ``REACH`` on either side, and the place of the minimum among them.
    ``content`` names both; the shingles are given once for each in a batch."""
    for batch in batches:
        texts = _shingles_of(batch.column("text"))
        members = batch.column("members")
        flat = members.flatten()
        text = pa.compute.list_parent_indices(members).to_numpy()
        key, place = (flat.field(f).to_numpy() for f in ("key", "place"))
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size) - size
        whole = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        c, first, last = _window(place)
        first, last = np.maximum(first, c - REACH), np.minimum(last, c + REACH)
        ok = np.flatnonzero((last - first + 1 >= SHINGLES) & (last < size[text]))
        c, first, last, text, key = c[ok], first[ok], last[ok], text[ok], key[ok]
        content = K.mix(_runs(whole)(base[text] + first, base[text] + last + 1) * K.BASE + key.view(np.uint64) + ((last - first) << 16 | (c - first)).astype(np.uint64))
        once = np.zeros(len(ok), bool)
        once[np.unique(content, return_index=True)[1]] = True
        low = whole.astype("<u4")
        length = np.where(once, last - first + 1, 0)
        at = np.concatenate(([0], np.cumsum(length)))
        data = low[np.repeat((base[text] + first) - at[:-1], length) + np.arange(at[-1])]
        around = pa.Array.from_buffers(pa.large_binary(), len(ok), [pa.py_buffer(np.packbits(once, bitorder="little")), pa.py_buffer(4 * at), pa.py_buffer(data)])
        yield pa.record_batch([pa.array(key), batch.column("doc_id").take(pa.array(text)), pa.array(c), pa.array((c - first).astype(np.int32)),
                               flat.field("open").take(pa.array(ok)), pa.array(content.view(np.int64)), around.cast(pa.binary())],
                              names=["key", "doc_id", "place", "centre", "open", "content", "around"])


#: What :func:`_surroundings` gives.
AROUND = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("centre", pa.int32()), ("open", pa.bool_()), ("content", pa.int64()), ("around", pa.binary())])


def _packed_surroundings(buckets: int):
    """A function that gives surroundings packed by buckets of their keys, many in a row."""
    def pack(held):
        rows = pa.Table.from_batches(held, AROUND).combine_chunks()
        bucket = (rows.column("key").to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.int64) % buckets
        rows = rows.take(pa.array(np.argsort(bucket, kind="stable"))).combine_chunks().to_batches()[0]
        edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
        some = np.flatnonzero(np.diff(edge))
        packed = [rows.slice(i, j - i).serialize().to_pybytes() for i, j in zip(edge[some].tolist(), edge[some + 1].tolist())]
        return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "rows"])

    def packed(batches):
        held, size = [], 0
        for rows in _surroundings(batches):
            if rows.num_rows:
                held.append(rows)
                size += rows.nbytes
            if size >= SPOOLED // 2:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return packed


#: Surroundings, or (``leader`` is not null) places of a document whose surroundings repeat those of place ``x`` of a leader.
NEAR = "key long, doc_id long, place long, centre int, open boolean, content long, around binary, leader long, x long"


def _near(batches):
    """Partners within all groups of up to ``BLOCK`` contents; surroundings of larger ones are passed on."""
    def passed(rows):
        none = pa.nulls(rows.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*rows.columns, none, none], [*AROUND.names, "leader", "x"])

    for bucket in _by_bucket(batches):
        parts = (pa.ipc.read_record_batch(pa.py_buffer(row), AROUND) for row in bucket.rows())
        if sum(bucket.sizes) > SPOOLED:
            yield from map(passed, parts)
            continue
        rows = pa.Table.from_batches(parts, AROUND).combine_chunks()
        key, docs, places, opened, content = (rows.column(c).to_numpy() for c in ("key", "doc_id", "place", "open", "content"))
        order = np.lexsort((places, docs, content, key))
        key, docs, places, opened, content = (c[order] for c in (key, docs, places, opened, content))
        # of each content its first document and place, the last open one, and a row that has its shingles
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
        least = np.iinfo(np.int64).min
        latest = np.maximum.reduceat(np.where(opened, docs, least), new)
        asks = np.logical_or.reduceat(opened, new)
        has = rows.column("around").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order]
        full = np.maximum.reduceat(np.where(has, np.arange(len(order)), -1), new)
        group = np.flatnonzero(np.append(True, key[new][1:] != key[new][:-1]))
        n = np.diff(np.append(group, len(new)))
        two = np.minimum.reduceat(docs[new], group) < np.maximum.reduceat(np.where(asks, latest, least), group)
        large = two & (n > BLOCK)
        if large.any():
            own = np.repeat(np.repeat(large, n), np.diff(np.append(new, len(key))))
            # sorted back: a batch gives the shingles of a content once
            for batch in rows.take(pa.array(order[own])).combine_chunks().to_batches():
                yield passed(batch)
        some = np.repeat(two & ~large, n)
        if not some.any():
            continue
        at = new[some]
        shingles = rows.select(["centre", "around"]).take(pa.array(order[full[some]]))
        table = pa.table({"block": np.repeat(np.arange(len(n)), n)[some], "doc_id": docs[at], "place": places[at], "centre": shingles.column("centre"), "asks": asks[some], "gives": np.ones(len(at), bool),
                          "latest": np.where(asks, latest, docs[new])[some], "content": content[at], "around": shingles.column("around")})
        found = _partners(table.combine_chunks())
        if not found:
            continue
        known, leader, x = (np.array(c, np.int64) for c in zip(*sorted(found)))
        k = np.minimum(np.searchsorted(known, content), len(known) - 1)
        ok = np.flatnonzero(opened & (known[k] == content) & (leader[k] < docs))
        none = [pa.nulls(len(ok), t) for t in AROUND.types]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(docs[ok]), pa.array(places[ok]), *none[3:], pa.array(leader[k[ok]]), pa.array(x[k[ok]])], [*AROUND.names, "leader", "x"])


#: Of a similar passage's shingles, four fifths at least are in common; so some ``SHINGLES`` in a row have as many, none further off its diagonal than its unequal ones.
DENSE = -(-4 * SHINGLES // 5)
DRIFT = 2 * REACH // 9 + 1


def _dense(values: np.ndarray, at: np.ndarray, centres: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Pairs of windows that may hold a similar passage: a necessary test,
    made for all pairs at once, in either direction. Window k has the shingles
    ``values[at[k]:at[k + 1]]``."""
    width = 2 * REACH + 1
    rows = np.unique(np.concatenate((xs, ys)))
    xs, ys = np.searchsorted(rows, xs), np.searchsorted(rows, ys)
    size = at[rows + 1] - at[rows]
    before = np.cumsum(size) - size
    padded = np.zeros((len(rows), width + 2 * DRIFT), np.uint32)  # 0 is no shingle, minima stand in the middle
    inside = np.arange(size.sum())
    start = np.arange(len(rows)) * padded.shape[1] + DRIFT + REACH - centres[rows]
    padded.reshape(-1)[inside + np.repeat(start - before, size)] = values[inside + np.repeat(at[rows] - before, size)] | np.uint32(1)
    first = np.arange(REACH + 1)
    least = np.maximum(REACH, first + SHINGLES - 1)  # last shingles of the shortest passages from there on that hold the minimum
    ok = np.arange(len(xs))
    for xs, ys in ((xs, ys), (ys, xs)):
        fit = np.zeros(len(ok), bool)
        for i in range(0, len(ok), 256):
            x, y = padded[xs[ok[i:i + 256]]], padded[ys[ok[i:i + 256]], DRIFT:DRIFT + width]
            found = np.zeros(y.shape, bool)
            for shift in range(2 * DRIFT + 1):
                found |= x[:, shift:shift + width] == y
            found &= y > 0
            run = np.pad(np.cumsum(found, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
            fit[i:i + 256] = (run[:, SHINGLES:] - run[:, :width - SHINGLES + 1]).max(axis=1) >= DENSE
            # of all shingles of the passage as many are in common
            gain = 5 * run - 4 * np.arange(width + 1, dtype=np.int16)
            best = np.maximum.accumulate(gain[:, ::-1], axis=1)[:, ::-1]
            fit[i:i + 256] &= (best[:, least + 1] - gain[:, first]).max(axis=1) >= 0
        ok = ok[fit]
    out = np.zeros(len(xs), bool)
    out[ok] = True
    return out


def _marks(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window a set of ``MARKS`` bits that its shingles mark, and how
    many shingles marked none of their own. Windows have no more shingles in
    common, repeated ones counted as often, than bits and those of either."""
    sets = np.empty((len(at) - 1, MARKS // 64), np.uint64)
    for i in range(0, len(sets), 1024):
        edge = at[i:i + 1025]
        own = values[edge[0]:edge[-1]]
        bits = np.zeros((len(edge) - 1, MARKS), bool)
        bits.reshape(-1)[np.repeat(np.arange(len(edge) - 1) * MARKS, np.diff(edge)) + own % np.uint32(MARKS)] = True
        sets[i:i + 1024] = np.packbits(bits, axis=1).view(np.uint64)
    return sets, np.diff(at) - np.bitwise_count(sets).sum(axis=1, dtype=np.int64)


def _partners(table: pa.Table) -> list[tuple]:
    """For each open content of a block one that repeats it: (content,
    leader, x). Of all that do, the one whose first document is the smallest
    serves all documents that hold the open content. Takes whole blocks,
    numbered by ``block``."""
    block, docs, places, centres, asks, gives, latest, contents = (
        table.column(c).to_numpy() for c in ("block", "doc_id", "place", "centre", "asks", "gives", "latest", "content"))
    around = table.column("around").combine_chunks().cast(pa.large_binary())
    _, offsets, data = around.buffers()
    at = np.frombuffer(offsets, np.int64)[around.offset:around.offset + len(around) + 1] // 4
    values = np.frombuffer(data, np.uint32, at[-1])[at[0]:]
    at = at - at[0]
    sets, none = _marks(values, at)
    begin, end = np.searchsorted(block, block, side="left"), np.searchsorted(block, block, side="right")
    out = []
    asking = np.flatnonzero(asks)
    work = np.cumsum((end - begin)[asking])
    edges = np.unique(np.append(np.searchsorted(work, np.arange(0, work[-1] if len(work) else 0, PAIRS)), len(asking)))
    for some in (asking[i:j] for i, j in zip(edges[:-1], edges[1:])):
        times = (end - begin)[some]
        ys = np.repeat(some, times)
        xs = np.arange(times.sum()) + np.repeat(begin[some] - (np.cumsum(times) - times), times)
        fit = gives[xs] & (docs[xs] < latest[ys])
        ys, xs = ys[fit], xs[fit]
        fit = np.zeros(len(ys), bool)
        for i in range(0, len(ys), 4096):
            x, y = xs[i:i + 4096], ys[i:i + 4096]
            common = np.bitwise_count(sets[x] & sets[y]).sum(axis=1, dtype=np.int64)
            fit[i:i + 4096] = common + np.minimum(none[x], none[y]) >= LEAST_COMMON
        ys, xs = ys[fit], xs[fit]
        fit = _dense(values, at, centres, xs, ys)
        ys, xs = ys[fit], xs[fit]
        order = np.lexsort((docs[xs], ys))
        done = -1
        for y, x in zip(ys[order].tolist(), xs[order].tolist()):
            if y != done and _stretch(values[at[x]:at[x + 1]], values[at[y]:at[y + 1]], int(centres[x]), int(centres[y])):
                out.append((int(contents[y]), int(docs[x]), int(places[x])))
                done = y
    return out


def _in_blocks(batches):
    """Partners within each block; rows come sorted by block."""
    names = ["key", "a", "b"]
    rest = None

    def given(table):
        rows = _partners(table.combine_chunks()) if table.num_rows else []
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["content", "leader", "x"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        block = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names])
        number = np.cumsum(np.append(True, (block[:, 1:] != block[:, :-1]).any(axis=0)))
        cut = int(np.searchsorted(number, number[-1]))
        yield given(table.slice(0, cut).append_column("block", pa.array(number[:cut])))
        rest = table.slice(cut)
    if rest is not None:
        yield given(rest.append_column("block", pa.array(np.zeros(rest.num_rows, np.int64))))


def _all_runs(batches):
    """Every run of ``SHINGLES`` shingles that holds an open seed: its hash,
    text and start, and whether it asks for its repeats: no known passage covers it."""
    for batch in batches:
        keys, docs, starts, asks = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "seeds", "known"))
        for sh, doc, seeds, known in zip(_shingles_of(batch.column("text")), *columns):
            if len(sh) < SHINGLES:
                continue
            n = len(sh) - SHINGLES + 1
            wanted, covered = np.zeros(len(sh) + 1, np.int64), np.zeros(len(sh) + 1, np.int64)
            for c in seeds:
                wanted[min(max(0, c - SHINGLES + 1), len(sh))] += 1  # beyond the end: of another text of that doc_id
                wanted[min(c + 1, len(sh))] -= 1
            for k in known or ():
                a, b = k["start_word"], k["start_word"] + k["n_words"] - LEAST_WORDS + 1
                if a < b:
                    covered[min(a, len(sh))] += 1
                    covered[min(b, len(sh))] -= 1
            a = np.flatnonzero(np.cumsum(wanted)[:n] > 0)
            keys.append(_runs(sh)(a, a + SHINGLES))
            docs.append(np.full(len(a), doc, np.int64))
            starts.append(a)
            asks.append(np.cumsum(covered)[a] == 0)
        cat = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((keys, np.uint64), (docs, np.int64), (starts, np.int64), (asks, bool))]
        yield pa.record_batch([pa.array(cat[0].view(np.int64)), pa.array(cat[1], pa.int64()), pa.array(cat[2], pa.int64()), pa.array(cat[3], pa.bool_())],
                              names=["key", "doc_id", "start", "asks"])


_SEEDS = "array<struct<px:long,py:long,kind:int>>"


def _buckets(scratch: Scratch) -> int:
    return max(BUCKETS, 4 * int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))


def _in_large_groups(around: DataFrame, scratch: Scratch) -> DataFrame:
    """Partners of open places, groups being dealt into blocks."""
    # windows of one content are compared once: its first document gives, all its open places ask
    contents = scratch.save(around.groupBy("key", "content").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("latest"), F.max("centre").alias("centre"), F.max("around").alias("around"))
        .select("key", "content", "centre", "around", "first.*", "latest"))
    # of all surroundings, only where the open ones are is asked for again
    open_places = scratch.save(around.where("open").select("doc_id", F.col("place").alias("y"), "content"))
    sizes = contents.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("latest").alias("most")).where("least < most")
    sizes = few(scratch.save(sizes.select("key", "n")), KEYS)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "place"), blocks).cast("int")
    # a: the block of the open contents that are compared, b: that of the ones they are compared with
    dealt = contents.join(sizes, "key").withColumn("own", own).withColumn("all", F.sequence(F.lit(0), blocks - 1))
    opened = F.col("latest").isNotNull()
    asking = F.when(opened, F.transform("all", lambda b: F.struct(F.col("own").alias("a"), b.alias("b"), F.lit(True).alias("asks"), (b == F.col("own")).alias("gives"))))
    giving = F.transform(F.filter("all", lambda a: ~opened | (a != F.col("own"))),
                         lambda a: F.struct(a.alias("a"), F.col("own").alias("b"), F.lit(False).alias("asks"), F.lit(True).alias("gives")))
    dealt = dealt.withColumn("to", F.explode(F.concat(F.coalesce(asking, F.array().cast("array<struct<a:int,b:int,asks:boolean,gives:boolean>>")), giving))) \
        .select("key", "doc_id", "place", "centre", "around", "content", F.coalesce("latest", "doc_id").alias("latest"), "to.*")
    block = ["key", "a", "b"]
    partners = dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_in_blocks, "content long, leader long, x long")
    return scratch.save(partners.join(open_places, "content").where("leader < doc_id").select("leader", "doc_id", "x", "y"))


def _beyond_leaders(base: DataFrame, shared: DataFrame, paired: DataFrame, verified: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs that no leader is in, and their texts. Minima that no verified
    passage covers are open, unless the leader was the only other one; their
    groups meet again under two functions, and are compared in blocks."""
    known = verified.where("n_words > 0").groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "n_words")).alias("known"))

    def uncovered(place):
        at = F.shiftright(place, 16)
        return ~F.coalesce(F.exists("known", lambda k: (k["start_word"] <= at) & (at < k["start_word"] + k["n_words"] - (WORDS - 1))), F.lit(False))

    # gathered by text before they meet what is known of it: one row for each text
    left = paired.where("kind > 0 and size > 2").groupBy("doc_id").agg(F.collect_list(F.struct("key", "py")).alias("windows")).join(known, "doc_id", "left")
    open_keys = left.select(F.explode(F.filter("windows", lambda w: uncovered(w["py"]))["key"]).alias("key"))
    keys = _keys(scratch.save(open_keys.distinct()))
    members = shared.where("kind > 0").join(keys, "key").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "key", "place")).alias("windows")) \
        .join(known, "doc_id", "left") \
        .select("doc_id", F.transform("windows", lambda w: F.struct(w["kind"].alias("kind"), w["key"].alias("key"), w["place"].alias("place"), uncovered(w["place"]).alias("open"))).alias("members"))
    joint = scratch.save(members.mapInArrow(_joint, "key long, doc_id long, place long, open boolean"))
    groups = joint.groupBy("key").agg(F.min("doc_id").alias("least"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("most")).where("least < most")
    met = scratch.save(joint.join(few(scratch.save(groups.select("key")), KEYS), "key")
                       .groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "open")).alias("members")))
    # a doc_id on several rows gives the surroundings of each; places beyond a text's end are left out
    around = met.join(base.join(few(met.select("doc_id")), "doc_id", "left_semi"), "doc_id").mapInArrow(_packed_surroundings(_buckets(scratch)), "bucket int, rows binary")
    near = scratch.save(around.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_near, NEAR))
    scratch.drop(joint, met)
    partners = near.where("leader is not null").select("leader", "doc_id", "x", F.col("place").alias("y"))
    around = near.where("leader is null").drop("leader", "x")
    if not around.isEmpty():
        partners = partners.unionByName(_in_large_groups(around, scratch))
    seed = F.struct(F.shiftleft("x", 16).alias("px"), F.shiftleft("y", 16).alias("py"), F.lit(1).alias("kind"))
    pairs = scratch.save(partners.groupBy("leader", "doc_id").agg(F.collect_set(seed).alias("seeds")))
    scratch.drop(near)
    ids = few(scratch.save(pairs.select(F.explode(F.array("leader", "doc_id")).alias("doc_id")).distinct()))
    return pairs, scratch.save(base.join(ids, "doc_id", "left_semi"))


def _keys(keys: DataFrame) -> DataFrame:
    """``keys`` as the smaller side of a join with windows: beyond ``HASHED``
    a shuffled join builds its table from them and does not sort the windows."""
    return keys.hint("shuffle_hash") if keys.limit(HASHED + 1).count() > HASHED else few(keys, KEYS)


def _copies(base: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents whose whole text a document of smaller id has too: ``copy``
    and ``first``, the smallest id with that text. Documents that have several
    texts are neither."""
    texts = scratch.save(base.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))
    repeated = texts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest")
    held = scratch.save(texts.join(few(scratch.save(repeated), KEYS), "digest"))
    # of each document with a text of several ones, whether it has other texts as well
    one = F.xxhash64("digest")
    single = texts.join(few(scratch.save(held.select("doc_id").distinct())), "doc_id", "left_semi") \
        .groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a = b").select("doc_id")
    held = held.join(few(scratch.save(single)), "doc_id", "left_semi").distinct()
    firsts = held.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return scratch.save(held.join(firsts, "digest").where("first < doc_id").select(F.col("doc_id").alias("copy"), "first"))


def repeated_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages of more than 50 words of ``docs(doc_id long, text)`` that
    repeat in a document of smaller id: ``doc_id, start_word, n_words,
    source_id, source_word, similarity`` (shingles in common, in order, of
    those of both passages; 1 is an exact repeat). Words are runs of anything but ASCII white space, compared with
    A-Z in lower case. The first document that holds a passage has no row for
    it.

    Null texts, null ids and texts of up to 50 words hold no passages. Rows
    that share a doc_id are not compared with each other. Repeats within one
    document are none. An empty table gives no rows.

    A text that several documents have is searched once, as that of the first
    one: it is one passage of each other one, which also has those passages
    of the first one that leaders are in."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    copies = _copies(rows, scratch)
    base = rows.join(few(copies.select(F.col("copy").alias("doc_id"))), "doc_id", "left_anti")
    by_leaders, found = _distinct_passages(base, scratch)
    firsts = few(scratch.save(copies.select(F.col("first").alias("doc_id")).distinct()))
    whole = rows.join(firsts, "doc_id", "left_semi").mapInArrow(_words, "first long, n_words long").where(f"n_words >= {LEAST_WORDS}").distinct()
    zero = F.lit(0).cast("long")
    whole = copies.join(whole, "first").select(F.col("copy").alias("doc_id"), zero.alias("start_word"), "n_words", F.col("first").alias("source_id"), zero.alias("source_word"), F.lit(1.0).alias("similarity"))
    again = by_leaders.join(copies.withColumnRenamed("first", "doc_id"), "doc_id").select(F.col("copy").alias("doc_id"), *NAMES[1:])
    return found.unionByName(whole).unionByName(again)


def _distinct_passages(base: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """:func:`repeated_passages` of texts that are compared with each other:
    those that leaders are in, and all."""
    # most windows are in one text: they travel packed, and only the others become rows
    windows = base.mapInArrow(_packed_windows(_buckets(scratch)), "bucket int, windows binary").repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.save(windows.mapInArrow(_shared, SHARED))
    shared = met.where("not again")
    paired = met.where("px is not null").select("leader", "doc_id", "px", F.col("place").alias("py"), "key", "size", "kind")

    def reach(place, bits: int):
        return F.shiftright(place, bits).bitwiseAND(F.lit(FAR))

    room = F.least(reach(F.col("px"), 8), reach(F.col("py"), 8)) + F.least(reach(F.col("px"), 0), reach(F.col("py"), 0)) + 1 >= SHINGLES
    cramped = paired.where("kind = 0").where(~room).select("doc_id", F.shiftright("py", 16).alias("start_word"))
    pair = ["leader", "doc_id"]
    seeds = paired.where(room).select(*pair, "px", "py", "kind").repartition(*pair).sortWithinPartitions(*pair)
    pairs = scratch.save(seeds.mapInArrow(_pairs, f"leader long, doc_id long, seeds {_SEEDS}"))

    named = pairs.select(F.explode(F.array("leader", "doc_id")).alias("doc_id"))
    suspects = few(scratch.save(named.distinct()))
    texts = scratch.save(base.join(suspects, "doc_id", "left_semi"))

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("xt")).hint("merge"), "leader") \
            .join(texts.select("doc_id", F.col("text").alias("yt")).hint("merge"), "doc_id")
        out = scratch.save(both.mapInArrow(_verify, SCHEMA))
        scratch.drop(pairs, texts)
        return out

    verified = verify(pairs, texts)
    more = verify(*_beyond_leaders(base, shared, paired, verified, scratch)).where("n_words > 0")

    # every text of a group with an open place gives its runs around all its places of that key, the leader and settled texts too
    open_at = verified.where("n_words = 0").select("doc_id", F.col("start_word").alias("y")).unionByName(cramped.withColumnRenamed("start_word", "y")).distinct()
    exact_at = paired.where("kind = 0").withColumn("y", F.shiftright("py", 16))
    open_keys = few(scratch.save(exact_at.join(open_at, ["doc_id", "y"], "left_semi").select("key").distinct()))
    open_seeds = scratch.save(shared.where("kind = 0").join(open_keys, "key").groupBy("doc_id").agg(F.collect_set(F.shiftright("place", 16)).alias("seeds")))
    passages = verified.where("n_words > 0").unionByName(more)
    known = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "n_words")).alias("known"))
    runs = base.join(few(open_seeds.select("doc_id")), "doc_id", "left_semi").join(open_seeds.join(known, "doc_id", "left"), "doc_id").select("text", "doc_id", "seeds", "known") \
        .mapInArrow(_all_runs, "key long, doc_id long, start long, asks boolean")
    runs = scratch.save(runs)
    scratch.drop(met)
    firsts = runs.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.when(F.col("asks"), F.col("doc_id"))).alias("last")) \
        .where("first.doc_id < last")
    exact = runs.where("asks").join(firsts, "key").where("doc_id <> first.doc_id") \
        .select("doc_id", F.col("start").alias("start_word"), F.lit(LEAST_WORDS).cast("long").alias("n_words"),
                F.col("first.doc_id").alias("source_id"), F.col("first.start").alias("source_word"), F.lit(1.0).alias("similarity"))
    # runs that continue each other become one passage
    chain = Window.partitionBy("doc_id", "source_id", F.col("start_word") - F.col("source_word")).orderBy("start_word")
    new = F.coalesce((F.col("start_word") - F.lag("start_word").over(chain) > 1).cast("int"), F.lit(1))
    exact = exact.distinct().withColumn("new", new) \
        .withColumn("part", F.sum("new").over(chain)) \
        .groupBy("doc_id", "source_id", (F.col("start_word") - F.col("source_word")).alias("shift"), "part") \
        .agg(F.min("start_word").alias("start_word"), (F.max("start_word") - F.min("start_word") + LEAST_WORDS).alias("n_words"), F.min("source_word").alias("source_word")) \
        .select("doc_id", "start_word", "n_words", "source_id", "source_word", F.lit(1.0).alias("similarity"))
    return verified.where("n_words > 0").distinct(), scratch.save(passages.unionByName(exact).distinct())


def _words(batches):
    """Words of each text."""
    for batch in batches:
        raw, off = K.buffers(batch.column("text"))
        _, _, at = K.word_spans(raw, off, K.SPACE)
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(at).astype(np.int64))], names=["first", "n_words"])


def _cut(batches):
    """Rows whose texts lack the given stretches of words (and the white space after each)."""
    for batch in batches:
        rows = batch.column("row")
        names = [f.name for f in rows.type]
        texts, cuts = rows.field("text").to_pylist(), batch.column("cuts").to_pylist()
        for n, (text, own) in enumerate(zip(texts, cuts)):
            if not own or text is None:
                continue
            raw, off = K.buffers(pa.array([text]))
            starts, ends, _ = K.word_spans(raw, off, K.SPACE)
            keep = np.ones(len(raw), bool)
            for c in own:
                a, b = c["start_word"], min(c["start_word"] + c["n_words"], len(starts))
                if a < b:
                    keep[starts[a]:(starts[b] if b < len(starts) else ends[b - 1])] = False
            texts[n] = raw[keep].tobytes().decode("utf-8", "surrogatepass")
        columns = [pa.array(texts, rows.type.field(c).type) if c == "text" else rows.field(c) for c in names]
        yield pa.record_batch([pa.StructArray.from_arrays(columns, names)], names=["row"])


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with every repeated passage cut out of all documents but the
    first that holds it; other columns and documents stay as they are. Rows
    that share a doc_id are cut alike only where their texts are the same."""
    own = Scratch(scratch.spark, "repeats")
    found = scratch.save(repeated_passages(docs, own).select("doc_id", "start_word", "n_words").distinct())
    own.clear()
    cuts = found.groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("cuts"))
    if found.limit(CUTS + 1).count() <= CUTS:  # two numbers each
        cuts = F.broadcast(cuts)
    rows = docs.select(F.struct("*").alias("row"))  # columns of any name stay apart from those here
    joined = rows.join(cuts, F.col("row.doc_id") == F.col("cut_id"), "left").select("row", "cuts")
    return joined.mapInArrow(_cut, T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(read_table(spark, sf_dir, "documents"), Scratch(spark, "passages"))
