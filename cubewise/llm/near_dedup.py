"""MinHash near-duplicates with min-max hashing.

Under each permutation both the smallest and the largest hash of a document's
shingles are kept, so one evaluation gives two signature values. Bands of
values meet in buckets; links are confirmed on the full shingle sets.

No bucket is turned into all its pairs:

1. Equal word sequences are one class; only class representatives go on.
2. In every bucket the members are compared with one leader, another one in
   each band (stars). Confirmed links give components.
3. Buckets whose members are by then in one component need nothing more. In
   the others, members of *different* components are compared by their
   signatures in blocks of bounded size, and the pairs that may reach the
   threshold are confirmed. This is the exact way for what the stars leave.

A pair is lost only if it shares no band, or if its signature agreement lies
more than ``slack`` below the threshold (see :class:`NearDup`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .components import connected_components
from .scratch import Scratch, few, read_table

#: Expected members of a block; two blocks at most meet in one row.
BLOCK = 512


@dataclass(frozen=True)
class NearDup:
    """``percent``: links have 100 * intersection >= percent * union.

    ``hashes`` permutations give 2 * ``hashes`` values; ``bands`` of ``rows``
    values are taken from them. A pair at 0.85 misses all of 50 bands of 8 with
    probability 1e-7 (75 bands at 0.8: 1e-6). The agreement of 800 values has
    a standard deviation of 0.013 there; ``slack`` is more than five of them.
    """

    percent: int = 85
    words: int = 5
    hashes: int = 400
    bands: int = 50
    rows: int = 8
    slack: float = 0.07


@lru_cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def _sets(texts, words: int):
    """Of each chunk of texts: first and last row, words, shingles."""
    raw, off = K.buffers(texts)
    for i, j, r, o in K.chunks(raw, off, 1 << 20):
        r = K.LOWER[r]
        starts, ends, at = K.word_spans(r, o, K.SPACE)
        hashes = K.word_hashes(r, starts, ends)
        yield i, j, hashes, at, *K.shingles(hashes, at, words)


def signatures(sh: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """(texts, 2k) min and max values; texts without shingles have no row."""
    a, b = _permutations(k)
    full = np.diff(at) > 0
    begin = at[:-1][full]
    out = np.empty((2 * k, len(begin)), np.uint32)
    if len(begin):
        x = (sh >> np.uint64(32)).astype(np.uint32)
        for q in range(k):
            y = x * a[q] + b[q]
            y ^= y >> np.uint32(15)
            np.minimum.reduceat(y, begin, out=out[2 * q])
            np.maximum.reduceat(y, begin, out=out[2 * q + 1])
    return np.ascontiguousarray(out.T)


def _sketch(cfg: NearDup):
    """doc_id, n_shingles, class key (two longs), bands, one byte of each value."""
    def run(batches):
        for batch in batches:
            for i, j, words, wat, sh, at in _sets(batch.column(1), cfg.words):
                full = np.diff(at) > 0
                count = np.zeros(j - i, np.int64)
                count[full] = [len(np.unique(sh[x:y])) for x, y in zip(at[:-1][full], at[1:][full])]
                place = np.arange(len(words)) - np.repeat(wat[:-1], np.diff(wat))
                keys = []
                for seed in (np.uint64(1), np.uint64(1 << 40)):
                    key = np.zeros(j - i, np.int64)
                    if full.any():
                        mixed = K.mix(words + K.mix(place.astype(np.uint64) + seed))
                        key[full] = K.mix(np.add.reduceat(mixed, wat[:-1][full]) + np.diff(wat)[full].astype(np.uint64)).view(np.int64)
                    keys.append(pa.array(key, mask=~full))
                sig = np.zeros((j - i, 2 * cfg.hashes), np.uint32)
                sig[full] = signatures(sh, at, cfg.hashes)
                per = cfg.bands
                bands = np.zeros((j - i, per), np.uint64)
                for c in range(cfg.rows):  # the values of a band come from permutations that lie apart
                    bands = bands * K.BASE + sig[:, c * per:(c + 1) * per]
                bands = pa.FixedSizeListArray.from_arrays(pa.array(K.mix(bands).view(np.int64).ravel()), per).cast(pa.list_(pa.int64()))
                small = (sig >> np.uint32(8)).astype(np.uint8)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(count), *keys, bands, pa.array([x.tobytes() for x in small], pa.binary())],
                                      names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])
    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from one byte of each value (1 in 256 agrees by chance)."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _likely(cfg: NearDup):
    """Keep pairs whose signatures may reach the threshold."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("xs", "ys"))
            n, m = (b.column(c).to_numpy() for c in ("xn", "yn"))
            ok = (_agreement(x, y) >= cfg.percent / 100 - cfg.slack) & (100 * np.minimum(n, m) >= cfg.percent * np.maximum(n, m))
            yield pa.record_batch([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], names=["u", "v"])
    return run


def _columns(members: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, comps, sizes = (np.array([m[c] for m in members], np.int64) for c in ("id", "comp", "n"))
    return ids, comps, sizes, np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(len(members), -1)


def _across(cfg: NearDup):
    """Likely pairs between different components, in one pair of blocks. A
    pair that shares several bands is given in the first of them only."""
    least = cfg.percent / 100 - cfg.slack

    def run(batches):
        for b in batches:
            us, vs = [], []
            for members in b.column(0).to_pylist():
                left = [m for m in members if m["side"] == 0]
                right = [m for m in members if m["side"] == 1] if members[0]["lo"] != members[0]["hi"] else left
                if not left or not right:
                    continue
                ids, comps, sizes, sigs = _columns(right)
                values, band = np.array([m["bands"] for m in right], np.int64), members[0]["band"]
                for x in left:
                    near = np.flatnonzero((comps != x["comp"]) & (100 * np.minimum(sizes, x["n"]) >= cfg.percent * np.maximum(sizes, x["n"])))
                    near = near[(values[near] == np.array(x["bands"], np.int64)).argmax(axis=1) == band] if len(near) else near
                    near = near[_agreement(sigs[near], np.frombuffer(x["sig"], np.uint8)) >= least] if len(near) else near
                    us.append(np.minimum(ids[near], x["id"]))
                    vs.append(np.maximum(ids[near], x["id"]))
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _confirm(cfg: NearDup):
    """Exact test of pairs of texts on their full sets."""
    def run(batches):
        for b in batches:
            us, vs = b.column("u").to_numpy(), b.column("v").to_numpy()
            ok = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = []
                for c in ("ut", "vt"):
                    sets.append([np.unique(sh[x:y]) for *_, sh, off in _sets(part.column(c), cfg.words) for x, y in zip(off[:-1], off[1:])])
                for i, (x, y) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[at + i] = both > 0 and 100 * both >= cfg.percent * (len(x) + len(y) - both)
            yield pa.record_batch([pa.array(us[ok], pa.int64()), pa.array(vs[ok], pa.int64())], names=["u", "v"])
    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, cfg: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs(doc_id long, text string)``: ``doc_id``,
    ``n_shingles`` (set size), ``component_id`` (smallest doc_id reachable
    over links, itself included), ``kept`` (doc_id = component_id).

    Texts are lower-cased in A-Z and split at ASCII white space. A text of
    fewer than ``words`` words is one shingle; a null or empty text has no
    shingles and no links. Rows that share a doc_id are one document as far
    as links go. A row with a null doc_id has no links, a null component and
    is kept. Other columns of ``docs`` are ignored; an empty table gives none.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.save(base.mapInArrow(
        _sketch(cfg), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary"))
    named = sketch.where("doc_id is not null and n_shingles > 0")
    classes = scratch.save(named.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    light = classes.select("id", "n", "sig")

    in_bands = classes.select("id", F.posexplode("bands").alias("band", "value"))
    leaders = in_bands.groupBy("band", "value").agg(
        F.min_by("id", F.xxhash64("id", "band")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = scratch.save(in_bands.join(leaders, ["band", "value"]))
    suspects = few(scratch.save(members.select(F.col("id").alias("doc_id")).distinct()))
    texts = scratch.save(base.where("text is not null").join(suspects, "doc_id", "left_semi"))
    stars = members.where("id <> leader").select(F.least("id", "leader").alias("u"), F.greatest("id", "leader").alias("v")).distinct()
    tested = scratch.save(_likely_pairs(stars, light, cfg))
    links = scratch.save(_confirmed(texts, tested, cfg).unionByName(_same_id(named, classes)))
    comps = scratch.save(connected_components(links, scratch))

    # What the stars leave: buckets whose members are not in one component.
    placed = members.join(comps, "id", "left").select("band", "value", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = placed.groupBy("band", "value").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).where("a <> b")
    rest = placed.join(mixed.select("band", "value", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), ["band", "value"]).join(classes.select("id", "n", "sig", "bands"), "id")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")) \
        .withColumn("side", F.when(F.col("mine") == F.col("lo"), 0).otherwise(1))
    blocks = rest.groupBy("band", "value", "lo", "hi").agg(F.collect_list(F.struct("side", "lo", "hi", "band", "id", "comp", "n", "sig", "bands")).alias("members"))
    cross = blocks.where("size(members) > 1").select("members").mapInArrow(_across(cfg), "u long, v long").distinct()
    more = scratch.save(_confirmed(texts, scratch.save(cross.join(tested, ["u", "v"], "left_anti")), cfg))
    comps = scratch.save(connected_components(links.unionByName(more), scratch))
    scratch.drop(members, texts, tested, links, more)

    of_class = classes.select("k1", "k2", "id").join(comps, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("component_id"))
    found = sketch.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _likely_pairs(pairs: DataFrame, light: DataFrame, cfg: NearDup) -> DataFrame:
    left, right = (light.select(F.col("id").alias(i), F.col("n").alias(f"{p}n"), F.col("sig").alias(f"{p}s")) for i, p in (("u", "x"), ("v", "y")))
    return pairs.join(left, "u").join(right, "v").mapInArrow(_likely(cfg), "u long, v long")


def _confirmed(texts: DataFrame, pairs: DataFrame, cfg: NearDup) -> DataFrame:
    """The pairs whose full texts hold the link. Pairs are the small side, yet
    no side is broadcast: both grow with the corpus."""
    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("ut")).hint("merge"), "u") \
        .join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("vt")).hint("merge"), "v")
    return both.mapInArrow(_confirm(cfg), "u long, v long")


def _same_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id that has several texts."""
    of = named.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id")
    least = of.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("most")).where("u <> most")
    return of.join(least, "doc_id").select("u", F.col("id").alias("v")).where("u <> v")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents at 0.85 (see :func:`near_duplicates`)."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark, "near-dedup"))
