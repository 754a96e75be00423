"""Cross-tokenizer alignment on Arrow tables.

Two tokenizers cut the same bytes. Where a token of each ends at the same
byte, both agree; the bytes between two such places are a *group*, and all its
A tokens are linked with all its B tokens.

A batch of texts is aligned without a loop over texts or tokens: token lists
are flattened with their parent indices, sizes become ends by a cumulative
sum, and the ends of both, marked on the bytes of the batch, tell the places
where both tokenizers end. Running counts of those places number the groups on
either side, and a hash join on the group gives the links. Within a group equal
ids are counted before they are joined, so a text in which the two seldom
agree gives no more rows than it has different id pairs.

How many documents hold an id pair linked is counted with ``Table.group_by``
in each task and merged by Spark. Pairs that make up a ``HOT``-th of all
counted rows, at most ``HOT`` by that definition, are broadcast back to the
documents' pairs; the others are joined by a shuffle in which none is
frequent.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .packing import RANKS, REMEMBERED, TOKENIZER, ByteTokens
from .scratch import Scratch, read_table, ship_code
from .token_counts import MARK, MODEL, PieceCounter, tokenizer_path

#: Pairs with at least a HOT-th of all (document, pair) rows are joined by broadcast.
HOT = 100_000
#: Links of a group beyond which equal ids are counted before they are joined.
WIDE = 64
#: A Spark task has a core of its own.
THREADS = False
#: Bytes of texts that are aligned together, about: tables of all their tokens are some fifty times as large.
CHUNK = 1 << 19
#: Pairs whose counts a task holds before it gives them, and most pairs of a written row.
HELD = 500_000
ROW_PAIRS = 256


class PieceTokens(PieceCounter):
    """Ids as ``encode`` of a sentencepiece model gives them, each distinct pre-token once."""

    def __init__(self, model_file: str):
        super().__init__(model_file)
        self.ids: dict[str, bytes] = {}
        self.lone = self.model.piece_to_id(MARK)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct pre-token, as 32-bit numbers."""
        found = list(map(self.ids.get, words))
        rest = [k for k, ids in enumerate(found) if ids is None]
        if len(self.ids) + len(rest) > REMEMBERED:
            self.ids = {}
        for k, ids in zip(rest, self.model.encode([words[k] for k in rest], num_threads=1)):
            # without characters: a space at the end of a text
            found[k] = self.ids[words[k]] = array("i", ids or [self.lone]).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n+1 offsets of texts into them."""
        raw, off = K.buffers(texts)
        if not self.splits or not len(raw) or (raw == 0).any():  # a NUL is left to the library
            lists = self.model.encode(texts.fill_null("").to_pylist(), num_threads=1)
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            return np.fromiter((i for x in lists for i in x), np.int32, int(at[-1])), at
        space = raw == 0x20
        first = np.zeros(len(raw), bool)
        first[off[:-1][off[:-1] < off[1:]]] = True
        begins = first.copy()
        begins[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begins)
        drop = ~first[starts]  # the library puts a space before a word: all but a text's first one give theirs up
        keep = np.ones(len(raw), bool)
        keep[starts[drop]] = False
        sizes = np.append(starts[1:], len(raw)) - starts - drop
        offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        words = pa.StringArray.from_buffers(len(starts), offsets, pa.py_buffer(raw[keep])).dictionary_encode()
        lists = self._of_words(words.dictionary.to_pylist())
        edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4))).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.frombuffer(b"".join(lists), np.int32))).take(words.indices)
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(tokens).to_numpy())))
        return tokens.flatten().to_numpy(), at[np.searchsorted(starts, off)]


class Vocabulary:
    """A tokenizer and the bytes that each of its ids stands for."""

    def __init__(self, tokenizer, entries: list[bytes]):
        self.tokenizer = tokenizer
        self.entries = pa.array(entries, pa.large_binary())
        self.sizes = pc.binary_length(self.entries)

    def tokens(self, texts: pa.Array) -> pa.Table:
        """``doc`` (parent index), ``id`` and ``size`` of all tokens, in order."""
        ids, at = self.tokenizer.encode(texts)
        lists = pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), pa.array(ids.astype(np.int32)))
        flat = lists.flatten()
        return pa.table({"doc": pc.list_parent_indices(lists).cast(pa.int32()), "id": flat, "size": self.sizes.take(flat)})

    def joined(self, ids: pa.ChunkedArray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        return K.buffers(self.entries.take(ids).combine_chunks().view(pa.large_string()))[0]


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    ones for themselves, the others for code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def vocabularies(json_name: str, ranks_name: str, model_name: str) -> tuple[Vocabulary, Vocabulary]:
    """A, of a byte-level vocabulary, and B, of a sentencepiece model."""
    a = ByteTokens(tokenizer_path(json_name), tokenizer_path(ranks_name))
    a.library.encode_special_tokens = True  # their strings in a text are plain text
    letters = _byte_alphabet()
    entries = [bytes(letters[c] for c in a.library.id_to_token(i)) if all(c in letters for c in a.library.id_to_token(i)) else a.library.id_to_token(i).encode()
               for i in range(a.library.get_vocab_size())]
    b = PieceTokens(tokenizer_path(model_name))
    m = b.model
    pieces = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
    return Vocabulary(a, entries), Vocabulary(b, pieces)


class Aligned:
    """The groups of a batch of texts.

    ``a`` and ``b`` are tables of tokens in order: ``doc`` (number in the
    batch), ``id``, ``group`` (number in the batch). ``group_doc`` is the
    document of each group.
    """

    def __init__(self, texts: pa.Array, va: Vocabulary, vb: Vocabulary):
        self.n = len(texts)
        texts = texts.fill_null("").cast(pa.large_string())
        empty = pa.scalar("", pa.large_string())
        spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, empty), empty, pa.scalar(" ", pa.large_string())), texts, empty)
        raw, off = K.buffers(spaced)
        a, b = va.tokens(spaced), vb.tokens(texts)
        good = (off[1:] > off[:-1]) & (_per_doc(a, self.n) == np.diff(off)) & (_per_doc(b, self.n) == np.diff(off))
        a, b = _of(a, good), _of(b, good)
        for _ in range(2):  # texts of the right size, but other bytes, go too; those before them move no place
            held = spaced.filter(pa.array(good))
            raw, off = K.buffers(held)
            other = np.zeros(len(raw), bool)
            for v, t in ((va, a), (vb, b)):
                other |= v.joined(t["id"]) != raw
            if not other.any():
                break
            good[np.flatnonzero(good)[np.searchsorted(off, np.flatnonzero(other), side="right") - 1]] = False
            a, b = _of(a, good), _of(b, good)
        # the bytes of the good texts stand one after the other: a token's end there is its document and its end in it at once
        ends = [pc.cumulative_sum(t["size"].cast(pa.int64())).to_numpy() for t in (a, b)]
        marked = np.zeros((2, len(raw) + 1), bool)
        for side, end in zip(marked, ends):
            side[end] = True
        self.a, self.group_doc = _grouped(a, marked[1][ends[0]])
        self.b, _ = _grouped(b, marked[0][ends[1]])

    def per_doc(self, docs) -> np.ndarray:
        return np.bincount(np.asarray(docs), minlength=self.n)

    def links(self) -> pa.Table:
        """``doc, a, b, links``: the different id pairs of each document and how often they are linked."""
        group_a, group_b = (np.asarray(t["group"]) for t in (self.a, self.b))
        n = len(self.group_doc)
        wide = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n) > WIDE
        sides = []
        for t, group, name in ((self.a, group_a, "a"), (self.b, group_b, "b")):
            ids = t.select(["group", "id"])
            side = ids.append_column("n", pa.array(np.ones(len(group), np.int64)))
            if wide.any():
                many = ids.filter(pa.array(wide[group])).group_by(["group", "id"], use_threads=THREADS).aggregate([([], "count_all")])
                side = pa.concat_tables([side.filter(pa.array(~wide[group])), many.rename_columns(["group", "id", "n"])])
            sides.append(side.rename_columns(["group", name, f"n_{name}"]))
        pairs = sides[0].join(sides[1], "group", join_type="inner", use_threads=THREADS)
        pairs = pa.table({"doc": pa.array(self.group_doc).take(pairs["group"]), "a": pairs["a"], "b": pairs["b"], "links": pc.multiply(pairs["n_a"], pairs["n_b"])})
        return pairs.group_by(["doc", "a", "b"], use_threads=THREADS).aggregate([("links", "sum")]).rename_columns(["doc", "a", "b", "links"])

    def digests(self) -> list[str]:
        """sha256 of each document's groups, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        ga, gb = (np.asarray(t["group"]) for t in (self.a, self.b))
        n = len(self.group_doc)
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        # places in the joined order: all A tokens of a group, then its B tokens
        place = np.concatenate((np.arange(len(ga)) + (np.cumsum(nb) - nb)[ga], np.arange(len(gb)) + np.cumsum(na)[gb]))
        after = np.concatenate((np.where(np.diff(ga, append=-1) == 0, 0, 1), np.where(np.diff(gb, append=-1) == 0, 0, 2)))
        doc_ends = np.append(np.diff(self.group_doc) != 0, True) if n else np.zeros(0, bool)
        after[len(ga):][(after[len(ga):] == 2) & doc_ends[gb]] = 3
        order = np.empty(len(place), np.int64)
        order[place] = np.arange(len(place))
        marks = pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(after[order]))
        ids = pa.chunked_array([*self.a["id"].chunks, *self.b["id"].chunks], pa.int32()).take(pa.array(order)).cast(pa.large_string())
        text, off = K.buffers(pc.binary_join_element_wise(ids, marks, pa.scalar("", pa.large_string())))
        tokens = self.per_doc(self.a["doc"]) + self.per_doc(self.b["doc"])
        edge = off[np.concatenate(([0], np.cumsum(tokens)))].tolist()
        data = memoryview(text)
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(edge, edge[1:])]

    def lists(self) -> pa.Array:
        """Each document's groups as a list of (A ids, B ids)."""
        n = len(self.group_doc)
        sides = []
        for t in (self.a, self.b):
            at = np.concatenate(([0], np.cumsum(np.bincount(np.asarray(t["group"]), minlength=n))))
            sides.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), t["id"].combine_chunks()))
        groups = pa.StructArray.from_arrays(sides, ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.per_doc(self.group_doc)))).astype(np.int32)), groups)


def _per_doc(tokens: pa.Table, n: int) -> np.ndarray:
    """Bytes of each document's tokens."""
    return np.bincount(tokens["doc"].to_numpy(), tokens["size"].to_numpy(), n).astype(np.int64)


def _of(tokens: pa.Table, good: np.ndarray) -> pa.Table:
    return tokens if good.all() else tokens.filter(pa.array(good).take(tokens["doc"]))


def _grouped(tokens: pa.Table, common: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Tokens with their group: how many ``common`` ends lie before. Also the document of each group."""
    return tokens.select(["doc", "id"]).append_column("group", pa.array(np.cumsum(common) - common)), tokens["doc"].to_numpy()[common]


def token_groups(docs: DataFrame, json_name: str = TOKENIZER, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``groups``, the (A ids, B ids) of each group in order, of
    every row of ``docs(doc_id, text)``. Texts that are null, empty, or not
    given back byte for byte by both tokenizers have no groups. Repeated rows
    have a row each; other columns are ignored; an empty table gives no rows."""
    def run(batches):
        for batch in batches:
            for i, j, _, _ in K.chunks(*K.buffers(batch.column(1)), CHUNK):
                part = batch.slice(i, j - i)
                yield pa.record_batch([part.column(0), Aligned(part.column(1), *vocabularies(json_name, RANKS, model)).lists()], names=["doc_id", "groups"])

    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


_DOC = ["n_a", "n_b", "n_groups", "n_links"]


def _counted(json_name: str, model: str):
    """Rows of three kinds: of documents, of their pairs (with the document's
    ``row``) and of counts (without), the latter two with lists of pairs."""
    names = ["row", "doc_id", *_DOC, "groups_sha256", "a", "b", "links"]
    plain = [*[pa.int64()] * 4, pa.string()]
    listed = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def given(pairs: pa.Table, size: np.ndarray, rows: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        """``pairs``, ``size[k]`` of them of ``rows[k]``, in lists of a bounded length."""
        pieces = -(-size // ROW_PAIRS)
        own = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(own)) - (np.cumsum(pieces) - pieces)[own]
        at = pa.array(np.append((np.cumsum(size) - size)[own] + ROW_PAIRS * nth, pairs.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pairs[c].combine_chunks().cast(k.value_type)) for c, k in zip(("a", "b", "links"), listed)]
        return pa.record_batch([rows.take(pa.array(own)), *(pa.nulls(len(own), k) for k in (kind, *plain)), *lists], names=names)

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["a", "b"], use_threads=THREADS).aggregate([("links", "sum")]).rename_columns(["a", "b", "links"])

    def counts(held: pa.Table, kind: pa.DataType) -> pa.RecordBatch:
        return given(held, np.array([held.num_rows]), pa.nulls(1, pa.int64()), kind)

    def run(batches):
        held, n_held, kind = [], 0, None
        for batch in batches:
            kind = batch.column(1).type
            for i, j, _, _ in K.chunks(*K.buffers(batch.column(2)), CHUNK):
                part = batch.slice(i, j - i)
                found = Aligned(part.column(2), *vocabularies(json_name, RANKS, model))
                pairs = found.links()
                pairs = pairs.take(pc.sort_indices(pairs["doc"]))
                links = np.bincount(pairs["doc"].to_numpy(), pairs["links"].to_numpy(), found.n)
                numbers = (found.per_doc(found.a["doc"]), found.per_doc(found.b["doc"]), found.per_doc(found.group_doc), links)
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c.astype(np.int64)) for c in numbers), pa.array(found.digests(), pa.string()),
                                       *(pa.nulls(found.n, k) for k in listed)], names=names)
                yield given(pairs, found.per_doc(pairs["doc"]), part.column(0), kind)
                own = pairs.group_by(["a", "b"], use_threads=THREADS).aggregate([([], "count_all")]).rename_columns(["a", "b", "links"])
                held, n_held = [*held, own], n_held + own.num_rows
                if n_held > HELD:
                    held = [merged(held)]
                    n_held = held[0].num_rows
                    if n_held > HELD // 2:
                        yield counts(held[0], kind)
                        held, n_held = [], 0
        if held:
            yield counts(merged(held), kind)
        pa.default_memory_pool().release_unused()  # the worker stays, and what it holds counts beside Spark's own memory

    return run


def aligned_counts(docs: DataFrame, scratch: Scratch, json_name: str = TOKENIZER, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_a, n_b`` (tokens),
    ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in as many
    documents as any pair of that A id, over the corpus), ``count_sum`` (over
    links, documents that hold the pair), ``groups_sha256``.

    Each row is a document of its own for the counts, also where doc_ids or
    texts repeat. Texts that are null, empty, or not given back byte for byte
    have no tokens: zeros and an empty digest. Other columns are ignored; an
    empty table gives no rows. A text is aligned whole, in the memory of its
    own size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = scratch.save(rows.mapInArrow(_counted(json_name, model), f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                         "groups_sha256 string, a array<int>, b array<int>, links array<long>"))
    pair = ["a", "b"]
    counts = found.where("row is null").selectExpr("inline(arrays_zip(a, b, links))").groupBy(*pair).agg(F.sum("links").alias("count"))
    # an A id has at most as many pairs as the B vocabulary has ids
    counts = scratch.save(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))))
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot, cold = counts.where(F.col("count") * HOT >= total), counts.where(F.col("count") * HOT < total)
    pairs = found.where("row is not null and n_a is null").selectExpr("row", "inline(arrays_zip(a, b, links))")

    def sums(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))

    known = sums(pairs.join(F.broadcast(hot), pair))
    rest = sums(pairs.join(F.broadcast(hot.select(pair)), pair, "left_anti").join(cold, pair))
    both = known.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.where("n_a is not null").join(both, "row", "left").select(
        "doc_id", *_DOC, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents' tokens in both vocabularies."""
    return aligned_counts(read_table(spark, sf_dir, "documents"), Scratch(spark, "alignment"))
