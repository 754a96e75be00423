"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (a line that is not empty) has a wide vector of its own, and
a text's fingerprint is their sum: lanes modulo 2**64 that tell equality, and
``LANES`` lanes modulo 2**16 that tell likeness too. A sum has no order, so
texts of the same paragraphs in any order, or with other blank lines, have
equal fingerprints; and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text.

The narrow lanes of a paragraph are signs (-1 or 1) hashed from its pieces,
which end where eight bytes hash to a multiple of ``PIECE``, so an edit
changes only pieces around it. The squared difference of two fingerprints,
averaged over the lanes, estimates how many pieces are in one text and not in
the other; against the squared lanes of both it gives their likeness.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import Scratch, read_table, ship_code

#: Narrow lanes: the likeness of unlike texts is 0 with a deviation of about LANES ** -0.5.
LANES = 512
#: Bytes of a piece, about, and the bytes that decide where one ends.
PIECE = 16
WINDOW = 8
#: Vectors expanded at a time.
BLOCK = 4096
LINE_ENDS = np.zeros(256, bool)
LINE_ENDS[[0x0A, 0x0D]] = True
_WIDE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_STEPS = K.mix(np.arange(1, LANES // 64 + 1, dtype=np.uint64))


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: the text and hash of every paragraph, and of every piece."""
    found = []
    raw, off = K.buffers(texts)
    for i, _, r, o in K.chunks(raw, off):
        starts, ends, at = K.word_spans(r, o, LINE_ENDS)
        paragraphs = K.word_hashes(r, starts, ends)
        text = i + np.repeat(np.arange(len(o) - 1), np.diff(at))
        up, down = K.powers(len(r) + 1)
        run = np.zeros(len(r) + 1, np.uint64)
        np.cumsum((r.astype(np.uint64) + np.uint64(1)) * up[:len(r)], out=run[1:])
        edge = WINDOW + np.flatnonzero(K.mix((run[WINDOW:] - run[:-WINDOW]) * down[:max(0, len(run) - WINDOW)]) % np.uint64(PIECE) == 0)
        own = np.searchsorted(starts, edge) - 1  # the paragraph that ends after such eight bytes of its own
        inside = own >= 0
        inside[inside] = (edge[inside] - WINDOW >= starts[own[inside]]) & (edge[inside] < ends[own[inside]])
        edge = edge[inside]
        begins, stops = np.sort(np.concatenate((starts, edge))), np.sort(np.concatenate((ends, edge)))
        pieces = K.word_hashes(r, begins, stops)
        found.append((text, paragraphs, text[np.searchsorted(starts, begins, side="right") - 1] if len(text) else text, pieces))
    empty = [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.uint64)]
    return tuple(np.concatenate([e, *(f[k] for f in found)]) for k, e in enumerate(empty))


def vector_sums(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Narrow lanes of ``n`` texts: the weighted sum of the signs of their pieces. ``text`` ascends."""
    out = np.zeros((n, LANES), np.uint16)
    for a in range(0, len(text), BLOCK):
        t, w = text[a:a + BLOCK], weights[a:a + BLOCK].astype(np.int16)
        bits = np.unpackbits(K.mix(hashes[a:a + BLOCK, None] ^ _STEPS).astype("<u8").view(np.uint8), axis=1).view(np.int8)
        cuts = np.append(np.flatnonzero(np.diff(t, prepend=-1)), len(t)).tolist()
        plain = bool((w == 1).all())
        for i, j in zip(cuts, cuts[1:]):
            ones = bits[i:j].sum(0, dtype=np.int16) if plain else w[i:j] @ bits[i:j].astype(np.int16)
            out[t[i]] += (2 * ones - w[i:j].sum(dtype=np.int16)).view(np.uint16)
    return out


def wide_sums(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Wide lanes of ``n`` texts: the weighted sum of the vectors of their paragraphs. ``text`` ascends."""
    vectors = K.mix(hashes[:, None] ^ _WIDE) * weights.astype(np.int64).view(np.uint64)[:, None]
    run = np.concatenate((np.zeros((1, len(_WIDE)), np.uint64), np.cumsum(vectors, 0, dtype=np.uint64)))
    at = np.searchsorted(text, np.arange(n + 1))
    return run[at[1:]] - run[at[:-1]]


class Prints:
    """Fingerprints of a batch of texts."""

    def __init__(self, wide: np.ndarray, lanes: np.ndarray):
        self.wide, self.lanes = wide, lanes

    @staticmethod
    def of(known: tuple, n: int) -> Prints:
        """From what :func:`parts` gives of ``n`` texts."""
        text, paragraphs, owner, pieces = known
        return Prints(wide_sums(text, paragraphs, np.ones(len(text)), n), vector_sums(owner, pieces, np.ones(len(owner)), n))

    def edited(self, before: tuple, after: tuple) -> Prints:
        """Fingerprints after an edit: vectors of parts that only the texts
        before hold are subtracted, those of new parts are added."""
        n = len(self.lanes)
        wide = wide_sums(*_changes(before[0], before[1], after[0], after[1]), n)
        lanes = vector_sums(*_changes(before[2], before[3], after[2], after[3]), n)
        return Prints(self.wide + wide, self.lanes + lanes)

    def strings(self) -> list[str]:
        rows = zip(self.wide.astype("<u8"), self.lanes.astype("<u2"))
        return [base64.b64encode(w.tobytes() + x.tobytes()).decode() for w, x in rows]

    @staticmethod
    def read(strings: list[str]) -> Prints:
        rows = [base64.b64decode(s) for s in strings]
        size = 8 * len(_WIDE)
        return Prints(np.array([np.frombuffer(r[:size], "<u8") for r in rows], np.uint64).reshape(len(rows), len(_WIDE)),
                      np.array([np.frombuffer(r[size:], "<u2") for r in rows], np.uint16).reshape(len(rows), LANES))


def _changes(text0, hash0, text1, hash1):
    """Texts, hashes and weights (added less removed) of parts whose number changed."""
    text, value = np.concatenate((text0, text1)), np.concatenate((hash0, hash1))
    sign = np.concatenate((np.full(len(text0), -1), np.ones(len(text1), np.int64))).astype(np.int64)
    order = np.lexsort((value, text))
    text, value, sign = text[order], value[order], sign[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    weight = np.add.reduceat(sign, at) if len(at) else sign
    keep = weight != 0
    return text[at][keep], value[at][keep], weight[keep]


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """About the share of pieces that two texts have in common, twice over
    the sum of both numbers: 1 for equal fingerprints, 0 to 1 for others."""
    def square(lanes):
        signed = lanes.view(np.int16).astype(np.float64)
        return np.einsum("ij,ij->i", signed, signed)

    both = square(a.lanes) + square(b.lanes)
    apart = square(a.lanes - b.lanes)
    return np.clip(1 - np.divide(apart, both, out=np.zeros(len(both)), where=both > 0), 0, 1)


def _names(kind: str) -> str:
    return f"doc_id {kind}, n_chars long, fingerprint string"


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars`` (code points) and ``fingerprint`` (base64) of every row of ``docs(doc_id, text)``.

    A null or empty text has no paragraphs: all lanes are 0. Texts with the
    same paragraphs have the same fingerprint, in whatever order. Repeated
    rows have a row each; other columns are ignored; an empty table gives no
    rows. Memory is bounded by a batch, or by the longest text.
    """
    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("")
            prints = Prints.of(parts(texts), len(texts))
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts.to_pylist()], pa.int64()), pa.array(prints.strings())],
                                  names=["doc_id", "n_chars", "fingerprint"])

    ship_code(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _names(docs.schema["doc_id"].dataType.simpleString()))


def merged(prints: DataFrame, by: list[str], column: str = "fingerprint") -> DataFrame:
    """The fingerprint of all texts of each group of ``by`` together, as if
    they were one text: ``by`` and ``fingerprint``. Sums are made in each task
    first, so a hot group is a few rows when it is shuffled."""
    def run(batches):
        sums: dict[tuple, Prints] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) or [()] * batch.num_rows
            for key, one in zip(keys, batch.column(column).to_pylist()):
                if one is None:
                    continue
                p, had = Prints.read([one]), sums.get(key)
                sums[key] = Prints(had.wide + p.wide, had.lanes + p.lanes) if had else p
            if len(sums) > BLOCK:
                yield given(sums)
                sums = {}
        yield given(sums)

    def given(sums):
        columns = [pa.array([k[i] for k in sums], kinds[i]) for i in range(len(by))]
        return pa.record_batch([*columns, pa.array([s for p in sums.values() for s in p.strings()], pa.string())], names=[*by, "fingerprint"])

    from pyspark.sql.pandas.types import to_arrow_type

    ship_code(prints.sparkSession)
    kinds = [to_arrow_type(prints.schema[c].dataType) for c in by]
    schema = ", ".join([*(f"`{c}` {prints.schema[c].dataType.simpleString()}" for c in by), "fingerprint string"])
    partial = prints.select(*by, column).mapInArrow(run, schema)
    # a key's rows meet in one task; there are at most a few from each task before
    return (partial.repartition(*by) if by else partial.coalesce(1)).selectExpr(*(f"`{c}`" for c in by), f"fingerprint AS `{column}`").mapInArrow(run, schema)


# ---------------------------------------------------------------- edits

_ROW = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_ORDER = ["doc_id", "hash", "salt"]
#: What a row is on its way: its text travels compressed.
_PACKED = ["doc_id", "hash", "salt", "size", "packed"]
_CODEC = ("zstd", 1)


def _pack(batches):
    """``doc_id, text, hash, salt`` with the text compressed."""
    codec = pa.Codec(*_CODEC)
    for batch in batches:
        doc, texts, hashes, salts = batch.columns
        raw = [t.encode() for t in texts.to_pylist()]
        yield pa.record_batch([doc, hashes, salts, pa.array([len(t) for t in raw], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=_PACKED)


def _unpacked(rows: pa.Table) -> list[str]:
    codec = pa.Codec(*_CODEC)
    return [codec.decompress(p, n, asbytes=True).decode() for p, n in zip(rows["packed"].to_pylist(), rows["size"].to_pylist())]


def _replaced(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points of the one that follows, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _edits(batches):
    """Rows of a range of documents, in order: each with its edited text's
    digest and likenesses. The range's last row, whose next one lies in
    another range, is given with its text instead; so is the first one, as
    the next row of the range before (``loose``: 1 the first, 2 the last)."""
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if first:
            yield _given(rows.slice(0, 1), 1)
            first = False
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows > 1:
            yield _given(rows, 0)
    if held is not None:
        yield _given(held, 2)


def _given(rows: pa.Table, loose: int) -> pa.RecordBatch:
    """All but the last of ``rows`` edited by the row after (loose 0), or the one row as it is."""
    names = [*_ROW, "loose", *_PACKED[1:]]
    n = rows.num_rows - 1 if not loose else 1
    kept = [rows[c].combine_chunks().slice(0, n) for c in _PACKED]
    mark = pa.array(np.full(n, loose, np.int32))
    if loose:
        return pa.record_batch([kept[0], *(pa.nulls(n, k) for k in (pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())), mark, *kept[1:]], names=names)
    texts = _unpacked(rows)
    changed = [_replaced(a, b) for a, b in zip(texts, texts[1:])]
    known = parts(pa.array(texts, pa.large_string()))
    prints = Prints.of(known, len(texts))
    own, following = Prints(prints.wide[:-1], prints.lanes[:-1]), Prints(prints.wide[1:], prints.lanes[1:])
    before = [x[known[k] < n] for k, x in zip((0, 0, 2, 2), known)]
    edited = own.edited(before, parts(pa.array(changed, pa.large_string())))
    columns = [pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
               pa.array(own.strings()), pa.array(edited.strings()), pa.array(likeness(own, edited)), pa.array(likeness(own, following))]
    return pa.record_batch([kept[0], *columns, mark, *kept[1:4], pa.nulls(n, pa.binary())], names=names)


def _joined(batches):
    """Rows of last documents of ranges, from all loose rows in order; the very last one is followed by the very first."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.concat_tables(tables)
    loose = rows["loose"].to_pylist()
    for k in (k for k, kind in enumerate(loose) if kind == 2):
        after = next(j % len(loose) for j in range(k + 1, k + 1 + len(loose)) if loose[j % len(loose)] == 1)
        yield _given(pa.concat_tables([rows.slice(k, 1), rows.slice(after, 1)]), 0)


def edited_fingerprints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` and its edited text: the last half
    of its code points replaced by as many first ones (or all) of the next
    row in descending order of doc_id, the first row's after the last:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The edited fingerprint is the first one less
    the parts that went, plus those that came.

    A null text is empty; null ids come last. Rows that share a doc_id follow
    each other by the hash of their texts, so results do not depend on how
    the table is stored. A single row is followed by itself. Other columns
    are ignored; an empty table gives no rows.

    Texts are dealt to ranges of the order in one shuffle. Only the first and
    last row of each range go to one task, to be linked: two for each shuffle
    partition at any size of the table.
    """
    text = F.coalesce("text", F.lit(""))
    # equal rows are told apart by a number, so that no group of them is one range
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc(), F.col("salt").asc()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = "hash long, salt long, size long, packed binary"
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, loose int, {numbers}"
    packed = rows.select("doc_id", "text", "hash", "salt").mapInArrow(_pack, f"doc_id {kind}, {numbers}")
    found = scratch.save(packed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_edits, schema))
    ends = found.where("loose > 0").coalesce(1).sortWithinPartitions(*order, F.col("loose").asc())
    return found.where("loose = 0").select(_ROW).unionByName(ends.mapInArrow(_joined, schema).select(_ROW))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return edited_fingerprints(read_table(spark, sf_dir, "documents"), Scratch(spark, "fingerprints"))
