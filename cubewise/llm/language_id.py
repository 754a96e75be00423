"""Language identification with hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1 of its own,
hashed from its code point. A trigram binds three of them: the product of the
first, rolled twice, the second, rolled once, and the third. A text is the
bundle (sum) of its trigrams, a language prototype the bundle of its training
texts; texts are compared with prototypes by cosine, after the mean of the
prototypes, what all languages have in common, is taken off both.

A text's bundle is its trigram counts times the vectors of the trigrams that
its batch holds, in blocks of trigrams: memory does not grow with the number
of letters that texts are written in.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import read_table, ship_code

#: Components of a vector.
DIM = 1024
UNKNOWN = "und"
#: Texts that are bundled at a time, letters of them, and trigrams.
BATCH = 200
LETTERS = 1_000_000
BLOCK = 4096
#: Bits of a code point; a trigram is three of them, 0 for anything but a letter.
BITS = 21
_SEED = K.mix(np.arange(1, DIM // 64 + 1, dtype=np.uint64))


@lru_cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The vector of each code point: the bits of a hash of it, as +1 and -1."""
    words = K.mix(K.mix(codes.astype(np.uint64) + np.uint64(7))[:, None] ^ _SEED)
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).view(np.int8) * 2 - 1


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams."""
    parts = [keys >> 2 * BITS, keys >> BITS & (1 << BITS) - 1, keys & (1 << BITS) - 1]
    codes, at = np.unique(np.concatenate(parts), return_inverse=True)
    v = letter_vectors(codes)
    a, b, c = at.reshape(3, -1)
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (as numbers) around every letter, and the text each is from."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate(([0], np.where(_letters()[code], code, 0), [0])).astype(np.int64)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    at = np.flatnonzero(code[1:-1])
    keys = (code[at] << 2 * BITS) | (code[at + 1] << BITS) | code[at + 2]
    return keys, np.searchsorted(ends, at, side="right")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, and the place of each key among them. Few letters
    make a small table, many are sorted."""
    mask = (1 << BITS) - 1
    seen = np.zeros(0x110000, bool)
    for shift in (2 * BITS, BITS, 0):
        seen[keys >> shift & mask] = True
    codes = np.flatnonzero(seen)
    if len(codes) > 128:
        return np.unique(keys, return_inverse=True)
    own = np.zeros(0x110000, np.int64)
    own[codes] = np.arange(len(codes))
    n = len(codes)
    small = (own[keys >> 2 * BITS] * n + own[keys >> BITS & mask]) * n + own[keys & mask]
    used = np.zeros(n**3, bool)
    used[small] = True
    found = np.flatnonzero(used)
    place = np.zeros(n**3, np.int64)
    place[found] = np.arange(len(found))
    return (codes[found // n**2] << 2 * BITS) | (codes[found // n % n] << BITS) | codes[found % n], place[small]


def bundles(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """(n, DIM) sums of the trigram vectors of each of n texts or groups."""
    out = np.zeros((n, DIM), np.float32)
    if not len(keys):
        return out
    distinct, column = _distinct(keys)
    if len(distinct) <= BLOCK:
        counts = np.bincount(of * len(distinct) + column, minlength=n * len(distinct)).reshape(n, -1)
        return counts.astype(np.float32) @ trigram_vectors(distinct)
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for a in range(0, len(distinct), BLOCK):
        b = min(a + BLOCK, len(distinct))
        i, j = np.searchsorted(column, (a, b))
        counts = np.bincount(of[i:j] * (b - a) + column[i:j] - a, minlength=n * (b - a)).reshape(n, -1)
        out += counts.astype(np.float32) @ trigram_vectors(distinct[a:b])
    return out


def _parts(texts: pa.Array):
    """Runs of up to ``BATCH`` texts of about ``LETTERS`` bytes: first row and texts."""
    for i, j, _, _ in K.chunks(*K.buffers(texts), LETTERS):
        for k in range(i, j, BATCH):
            yield k, texts.slice(k, min(BATCH, j - k)).to_pylist()


def _learn(batches):
    """A row for each language of the partition: its bundle."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, len(langs), BATCH):
            own = langs[i:i + BATCH]
            names = sorted(set(own))
            keys, of = trigrams(texts.slice(i, BATCH).to_pylist())
            group = np.array([names.index(x) for x in own])
            for name, row in zip(names, bundles(keys, group[of], len(names))):
                sums[name] = sums.get(name, 0) + row.astype(np.float64)
    yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))],
                          names=["lang", "bundle"])


def prototypes(train: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of every language of ``train(lang, text)``. Partitions send
    one row for each language; the sums are Spark's, and ``DIM`` numbers for
    each language reach the driver."""
    ship_code(train.sparkSession)
    parts = train.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_learn, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = r["x"]
    return {k: out[k] for k in sorted(out) if out[k].any()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` (and the columns but text) of ``docs``.

    ``score`` is the cosine with the nearest prototype, cut to 0 to 1. A text
    that is null or has no letter, and any text if there is no prototype, is
    ``und`` with score 0; of equal cosines the first language by name wins.
    """
    ship_code(docs.sparkSession)
    names = list(profiles)
    matrix = np.array([profiles[n] / np.linalg.norm(profiles[n]) for n in names]).reshape(len(names), DIM)
    mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    centred = matrix - mean
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    mean = mean.astype(np.float32)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            best, score = [], []
            for _, part in _parts(texts):
                keys, of = trigrams(part)
                x = bundles(keys, of, len(part))
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.maximum(size, 1e-12) - mean
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                cos = x @ centred.T
                has = np.bincount(of, minlength=len(part)) > 0
                for d in range(len(part)):
                    k = int(cos[d].argmax()) if names and has[d] else -1
                    best.append(names[k] if k >= 0 else UNKNOWN)
                    score.append(min(1.0, max(0.0, float(cos[d, k]))) if k >= 0 else 0.0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                  names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id,
    text, lang)``. Prototypes are learned from all rows that are not held out
    and have a language; ``lang`` is no input of a prediction. Other columns
    are ignored; an empty table gives no rows."""
    parts = docs.select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    return predict(parts.select("doc_id", "held_out", "text"), prototypes(parts.where("not held_out")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(read_table(spark, sf_dir, "documents"))
