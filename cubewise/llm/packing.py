"""Best-fit packing by bin completion, and the tokens that are packed.

Lengths are whole numbers up to the capacity, so a table of how many pieces
have each length says all that packing needs: it has at most ``capacity``
rows at any corpus size. Bin completion runs on that table. Around the
largest length left it enumerates the undominated fillings, applies one to as
many bins as the counts allow, and goes on; solutions are bounded by their
waste, and best-fit decreasing of what is left gives the incumbents.

The plan is a list of patterns (a filling, times a number of bins). Pieces
are numbered within their length, spread over buckets so that no length is
numbered in one task, and each number's place in the plan is looked up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import Scratch, read_table, ship_code
from .token_counts import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END = 2
CAPACITY = 1024
#: Fillings tried around one largest length, and search steps beyond the first descent.
FILLINGS = 24
STEPS = 400
REMEMBERED = 150_000

# ---------------------------------------------------------------- bin completion


@dataclass(frozen=True)
class Pattern:
    """``bins`` sequences that each hold ``lengths`` (largest first)."""

    lengths: tuple[int, ...]
    bins: int


def _undominated(counts: np.ndarray, largest: int, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Fillings of the room beside ``largest``, least waste first.

    Depth-first over lengths from large to small. A filling is dominated if
    another holds the same or larger pieces in the same room: one that leaves
    room for a piece still at hand, or that could swap a piece for a larger
    one that fits, is left out.
    """
    have = np.flatnonzero(counts[:capacity + 1])
    have = have[have > 0]
    found: list[tuple[int, tuple[int, ...]]] = []
    room = capacity - largest
    tries = 0

    def left(length: int, used: tuple[int, ...]) -> int:
        return int(counts[length]) - used.count(length) - (length == largest)

    def fits(space: int, used: tuple[int, ...]) -> int:
        """Largest length at hand within ``space``, 0 if none."""
        k = int(np.searchsorted(have, space, side="right")) - 1
        while k >= 0 and left(int(have[k]), used) <= 0:
            k -= 1
        return int(have[k]) if k >= 0 else 0

    def grow(space: int, ceiling: int, used: tuple[int, ...]) -> bool:
        nonlocal tries
        tries += 1
        best = fits(min(space, ceiling), used)
        if not best:
            if not fits(space, used):
                found.append((space, used))
            return space == 0 and len(found) >= most
        length, options = best, 0
        while length and options < 4 and tries < 60 * most:
            if grow(space - length, length, (*used, length)):
                return True
            options += 1
            length = fits(length - 1, used)
        return False

    grow(room, room, ())
    found.sort(key=lambda f: (f[0], len(f[1])))
    kept = []
    for waste, filling in found:
        swap = any(left(bigger, filling) > 0 and bigger != x for x in set(filling) for bigger in (fits(x + waste, filling),) if bigger > x)
        if not swap:
            kept.append(filling)
    return (kept or [f for _, f in found[:1]] or [()])[:most]


def _times(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    values, need = np.unique(lengths, return_counts=True)
    return int((counts[values] // need).min())


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of equal pieces together: the largest first, then again and
    again the largest piece that fits what is left of the bin."""
    counts, plan = counts.copy(), []
    while True:
        have = np.flatnonzero(counts)
        if not len(have):
            return plan
        filling, room, taken = [int(have[-1])], capacity - int(have[-1]), counts.copy()
        taken[have[-1]] -= 1
        while room:
            k = np.flatnonzero(taken[:room + 1])
            if not len(k):
                break
            n = min(int(taken[k[-1]]), room // int(k[-1]))
            filling += [int(k[-1])] * n
            taken[k[-1]] -= n
            room -= n * int(k[-1])
        bins = max(1, _times(counts, tuple(filling)))
        values, need = np.unique(filling, return_counts=True)
        counts[values] -= need * bins
        plan.append(Pattern(tuple(filling), bins))


def _bins(plan: list[Pattern]) -> int:
    return sum(p.bins for p in plan)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): pieces over half the capacity
    need a bin each, and what others need beyond the room beside them."""
    n = np.arange(len(counts))
    best = -(-int((counts * n).sum()) // capacity)
    pieces, tokens = np.cumsum(counts), np.cumsum(counts * n)
    half = capacity // 2
    big = int(pieces[-1] - pieces[half])
    for a in range(1, half + 1):
        beside = int(tokens[capacity - a] - tokens[half])  # over half, with room for pieces of length a
        bins = int(pieces[capacity - a] - pieces[half])
        small = int(tokens[half] - tokens[a - 1])
        best = max(best, big + max(0, -(-(small - (bins * capacity - beside)) // capacity)))
    return best


def pack(counts, capacity: int = CAPACITY, steps: int = STEPS) -> list[Pattern]:
    """Patterns that use every piece once, in as few bins as the search finds.

    ``counts[n]`` pieces have length n (1 to capacity). The first descent
    takes the best filling each time, for as many bins as the counts allow;
    from its end the search goes back and follows every kept filling, depth
    first, for as many bins and for one, within ``steps`` steps. Then, from
    the top of the first descent, other fillings of one bin are completed by
    best-fit decreasing, within as many steps again. Only what wastes too
    little to rule out fewer bins than the incumbent is followed. A plan at
    the lower bound ends the search.
    """
    counts = np.asarray(counts, np.int64).copy()
    total = int((counts * np.arange(len(counts))).sum())
    bound = least_bins(counts, capacity)
    best = best_fit_decreasing(counts, capacity)

    def moves(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(counts)[-1])
        out = []
        for filling in _undominated(counts, largest, capacity, most):
            lengths = (largest, *filling)
            n = _times(counts, lengths)
            out += [(lengths, n), (lengths, 1)] if n > 1 else [(lengths, 1)]
        return out

    def take(counts: np.ndarray, lengths: tuple[int, ...], n: int) -> np.ndarray:
        values, need = np.unique(lengths, return_counts=True)
        counts = counts.copy()
        counts[values] -= need * n
        return counts

    def hopeless(waste: int) -> bool:
        return waste > (_bins(best) - 1) * capacity - total

    def offer(plan: list[Pattern]) -> None:
        nonlocal best
        if _bins(plan) < _bins(best):
            best = plan

    path: list[tuple[np.ndarray, list[Pattern], int]] = []
    at, done, waste = counts, [], 0
    stack: list[list] = []
    while at.any() and not hopeless(waste) and _bins(best) > bound:
        path.append((at, done, waste))
        lengths, n = moves(at, 8)[0]
        stack.append([at, done, waste, None, (lengths, n)])
        at, done, waste = take(at, lengths, n), [*done, Pattern(lengths, n)], waste + n * (capacity - sum(lengths))
    if not at.any():
        offer(done)

    budget = steps
    while stack and budget > 0 and _bins(best) > bound:
        frame = stack[-1]
        at, done, waste, left, tried = frame
        if left is None:
            frame[3] = left = iter([m for m in moves(at, FILLINGS) if m != tried])
        move = next(left, None)
        if move is None or hopeless(waste):
            stack.pop()
            continue
        budget -= 1
        lengths, n = move
        after, then, wasted = take(at, lengths, n), [*done, Pattern(lengths, n)], waste + n * (capacity - sum(lengths))
        if hopeless(wasted):
            continue
        offer([*then, *best_fit_decreasing(after, capacity)])
        if after.any():
            stack.append([after, then, wasted, None, None])

    budget = steps
    for at, done, waste in path:
        if budget <= 0 or _bins(best) <= bound or hopeless(waste):
            break
        for lengths in dict.fromkeys(m for m, _ in moves(at, FILLINGS)):
            budget -= 1
            if budget <= 0 or _bins(best) <= bound:
                break
            offer([*done, Pattern(lengths, 1), *best_fit_decreasing(take(at, lengths, 1), capacity)])
    return best


# ---------------------------------------------------------------- tokens


class ByteTokens:
    """Ids as the ``tokenizers`` file gives them, each distinct pre-token once.

    Pre-tokens are found with numpy from character classes. Texts with
    characters from U+3000 on, unassigned ones, or the file's special strings
    go to the library as they are.
    """

    def __init__(self, json_file: str, ranks_file: str):
        import base64
        import unicodedata

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        kinds = np.zeros(0x3001, np.uint8)  # 1 letter, 2 number, 3 white space, 4 other, 0 to the library
        for c in range(0x3000):
            kind = unicodedata.category(chr(c))
            kinds[c] = 1 if kind[0] == "L" else 2 if kind[0] == "N" else 0 if kind in ("Cn", "Cs") else 4
        for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]:
            kinds[c] = 3
        self.kinds = kinds
        self.known: dict[str, bytes] = {}

    def _begins(self, code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, as the file's pattern cuts them: a
        contraction, or letters, numbers or other characters with at most one
        space before them, or white space up to the last one before a word."""
        n = len(code)
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        white = kind == 3
        last = np.zeros(n, bool)  # of a text
        last[:-1] = first[1:]
        last[-1:] = True
        ends_white = np.zeros(n, bool)  # the last white space before a word
        ends_white[:-1] = white[:-1] & ~white[1:]
        ends_white &= ~last
        begins = change | ends_white
        joins = np.zeros(n, bool)  # a word after a space belongs to it
        joins[1:] = ends_white[:-1] & (code[:-1] == 0x20)
        begins &= ~joins
        for p in np.flatnonzero((code == 0x27) & begins):
            tail = "".join(map(chr, code[p + 1:p + 3]))
            size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if size and not first[p + 1:p + size].any() and p + size <= n:
                if begins[p]:
                    begins[p + 1:p + size] = False
                    if p + size < n and not (white[p + size] and not begins[p + size]):
                        begins[p + size] = True
        return begins

    def ids_of(self, word: str) -> bytes:
        """Ids of one pre-token, as unsigned 32-bit numbers."""
        return np.array(self.core._encode_single_piece(word.encode()), np.uint32).tobytes()

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n+1 offsets of texts into them; a null text is empty."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        plain = texts.fill_null("").to_pylist()
        joined = "".join(plain)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))))
        kind = self.kinds[np.minimum(code, 0x3000)]
        odd = np.zeros(len(plain), bool)
        odd[np.searchsorted(off, np.flatnonzero(kind == 0), side="right") - 1] = True
        for mark in self.special:
            if mark in joined:
                odd |= np.fromiter((mark in t for t in plain), bool, len(plain))
        first = np.zeros(len(code), bool)
        first[off[:-1][off[:-1] < off[1:]]] = True
        begins = self._begins(code, kind, first) if len(code) else first
        starts = np.flatnonzero(begins)
        at = np.searchsorted(starts, off)
        width = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        edge = np.concatenate(([0], np.cumsum(width)))
        data = joined.encode("utf-8", "surrogatepass")
        offsets = np.append(edge[starts], len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = self.known
        pieces = []
        for w in distinct:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.ids_of(w)
            pieces.append(ids)
        if len(known) > REMEMBERED:
            known.clear()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        table = np.frombuffer(b"".join(pieces), np.uint32)
        table_at = np.concatenate(([0], np.cumsum(sizes)))
        index = words.indices.to_numpy()
        count = sizes[index]
        run = np.concatenate(([0], np.cumsum(count)))
        ids = table[np.repeat(table_at[index] - run[:-1], count) + np.arange(run[-1])]
        ids_at = run[at]
        if odd.any():
            parts = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if o else ids[x:y]
                     for t, o, x, y in zip(plain, odd, ids_at[:-1], ids_at[1:])]
            ids_at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            ids = np.concatenate(parts)
        return ids, ids_at


@lru_cache(maxsize=1)
def _tokens(json_name: str, ranks_name: str) -> ByteTokens:
    return ByteTokens(tokenizer_path(json_name), tokenizer_path(ranks_name))


def _pieces(capacity: int):
    """Cut every document into pieces: only the first one may be shorter."""
    def run(batches):
        for batch in batches:
            tokens = _tokens(TOKENIZER, RANKS)
            raw, off = K.buffers(batch.column(1))
            for i, j, _, _ in K.chunks(raw, off, 1 << 21):
                ids, at = tokens.encode(batch.column(1).slice(i, j - i))
                rows: list[tuple] = []
                for d in range(j - i):
                    doc = np.append(ids[at[d]:at[d + 1]], np.uint32(END)).astype("<u4")
                    head = len(doc) % capacity or capacity
                    for n, (x, y) in enumerate(zip((0, *range(head, len(doc), capacity)), range(head, len(doc) + 1, capacity))):
                        rows.append((i + d, n, x, y - x, zlib.crc32(doc[x:y].tobytes())))
                doc, n, start, length, crc = map(list, zip(*rows))
                yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(n, pa.int32()), pa.array(start, pa.int64()),
                                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``:
    ids of the whole text and the end id, cut where longer than ``capacity``."""
    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- places


def _slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length and pattern: first and last number of its pieces, the
    first sequence, pieces of that length in one sequence, their first place."""
    out, used, sequence = [], {}, 0
    for p in plan:
        place = 0
        for length in sorted(set(p.lengths), reverse=True):
            each = p.lengths.count(length)
            begin = used.get(length, 0)
            used[length] = begin + each * p.bins
            out.append((length, begin, begin + each * p.bins - 1, sequence, each, place))
            place += each * length
        sequence += p.bins
    return out


def place_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces that
    :meth:`Scratch.save` returned.

    Only the counts by length (at most ``capacity`` rows) reach the driver,
    and only the plan's slots (a few for each length) go back. Pieces are
    numbered within (bucket, length); buckets grow with the table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()
    table = np.zeros(capacity + 1, np.int64)
    for r in counts:
        table[r["length"]] = r["count"]
    slots = _slots(pack(table, capacity))
    buckets = max(16, int(table.sum() // 100_000))
    key = F.struct("doc_id", "piece", "start", "ids_crc32")
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").count()
    before = sizes.withColumn("before", F.sum("count").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(key)) - 1
    numbered = keyed.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("number", F.col("rank") + F.col("before"))
    plan = spark.createDataFrame(slots, "length long, begin long, last long, sequence long, each long, place long")
    # one array of slots for each length: at most ``capacity`` rows at any size
    by_length = plan.groupBy("length").agg(F.collect_list(F.struct("begin", "last", "sequence", "each", "place")).alias("slots"))
    found = numbered.join(F.broadcast(by_length), "length") \
        .withColumn("slot", F.filter("slots", lambda s: (s["begin"] <= F.col("number")) & (F.col("number") <= s["last"]))[0]) \
        .withColumn("nth", F.col("number") - F.col("slot.begin"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("slot.sequence") + F.floor(F.col("nth") / F.col("slot.each"))).cast("long").alias("sequence_id"),
                        (F.col("slot.place") + F.col("nth") % F.col("slot.each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` and their places: ``doc_id, piece,
    start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone. Repeated rows are packed each.
    Other columns are ignored; an empty table gives no rows. Any length of
    text is cut, never dropped.
    """
    return place_pieces(scratch.save(token_pieces(docs, capacity)), scratch, capacity)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "packing"))
