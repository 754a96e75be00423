"""Fill-in-middle texts by displacement scatter.

A text is cut into prefix, middle and suffix and written in another order
with a mark before each part. Texts of a batch are one byte buffer. The bytes
of a part move by the same distance, so the cuts of all texts are scanned
into a difference array: the change of distance at each cut. Its cumulative
sum is every byte's displacement; a scatter writes the outputs, and a gather
by the inverse displacements, taken from the marks found in an output,
restores the texts.

Which form a text takes and where it is cut follows from its doc_id alone, so
a task that runs again writes the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import read_table, ship_code

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3  # bytes of a mark
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of texts that are formatted, and of those the ones with the suffix first.
FORMATTED = 90
SUFFIX_FIRST = 20
#: Bytes displaced at a time: memory does not grow with the length of a text.
BLOCK = 1 << 20


def displacements(size: int, places: np.ndarray, shifts: np.ndarray):
    """``(a, b, index)`` for runs of bytes a to b (without b) that cover
    ``size`` bytes: ``index`` is where each byte lies on the other side. From
    ``places[k]`` on (ascending) bytes are displaced by ``shifts[k]``; of
    equal places the last one counts."""
    steps = np.diff(shifts, prepend=0)
    before = 0
    for a in range(0, size, BLOCK):
        b = min(a + BLOCK, size)
        i, j = np.searchsorted(places, (a, b))
        change = np.zeros(b - a, np.int64)
        np.add.at(change, places[i:j] - a, steps[i:j])
        change[0] += before
        moved = np.cumsum(change)
        before = int(moved[-1])
        yield a, b, moved + np.arange(a, b)


def _byte_places(raw: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Byte at which code point number ``wanted`` of the buffer begins (its end, for one beyond the last)."""
    out = np.full(len(wanted), len(raw), np.int64)
    order, seen, k = np.argsort(wanted, kind="stable"), 0, 0
    for a in range(0, len(raw), BLOCK):
        begins = np.flatnonzero((raw[a:a + BLOCK] & 0xC0) != 0x80)
        j = int(np.searchsorted(wanted[order], seen + len(begins)))
        out[order[k:j]] = a + begins[wanted[order[k:j]] - seen]
        seen, k = seen + len(begins), j
    return out


def _found(raw: np.ndarray, off: np.ndarray, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold a mark, and where, first ones first."""
    what = mark.encode()
    if len(raw) < len(what):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = raw[:len(raw) - len(what) + 1] == what[0]
    for k in range(1, len(what)):
        hit = hit & (raw[k:len(raw) - len(what) + 1 + k] == what[k])
    place = np.flatnonzero(hit)
    text = np.searchsorted(off, place, side="right") - 1
    whole = place + len(what) <= off[text + 1]  # not over the edge of two texts
    return text[whole], place[whole]


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def scatter(texts: pa.Array, forms: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> pa.Array:
    """Outputs of ``texts``: ``forms`` are 0 (plain), 1 (psm) or 2 (spm);
    ``prefix`` and ``middle`` are code points (0 where plain)."""
    raw, off = K.buffers(texts)
    begin, end = off[:-1], off[1:]
    chars = np.add.reduceat(np.append((raw & 0xC0) != 0x80, False).astype(np.int64), off)[:-1] if len(raw) else np.zeros(len(begin), np.int64)
    chars[begin == end] = 0
    first = np.cumsum(chars) - chars
    a, b = _byte_places(raw, first + prefix), _byte_places(raw, first + prefix + middle)
    a, b = np.minimum(a, end), np.minimum(b, end)
    marked = forms > 0
    out_off = off + 3 * MARK * np.concatenate(([0], np.cumsum(marked)))
    out = out_off[:-1]
    head = np.where(forms == 1, a - begin, end - b)  # of the part that comes first
    second = out + MARK + head + MARK
    last = out + 3 * MARK + (a - begin) + (end - b)
    shift = np.stack([np.where(forms == 0, out, np.where(forms == 1, out + MARK, second)) - begin,
                      np.where(forms == 0, out + (a - begin), last) - a,
                      np.where(forms == 0, out + (b - begin), np.where(forms == 1, second, out + MARK)) - b], 1)
    data = np.empty(int(out_off[-1]), np.uint8)
    for x, y, index in displacements(len(raw), np.stack([begin, a, b], 1).ravel(), shift.ravel()):
        data[index] = raw[x:y]
    for mark, place in ((PREFIX, np.where(forms == 1, out, second - MARK)), (SUFFIX, np.where(forms == 1, second - MARK, out)), (MIDDLE, last - MARK)):
        for k, c in enumerate(mark.encode()):
            data[place[marked] + k] = c
    return _strings(data, out_off)


def gather(outputs: pa.Array, forms: np.ndarray) -> pa.Array:
    """The texts that :func:`scatter` was given, from its outputs and forms alone."""
    raw, off = K.buffers(outputs)
    marked = np.flatnonzero(forms > 0)
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        text, at = _found(raw, off, mark)
        own = forms[text] > 0
        if not np.array_equal(text[own], marked):
            raise ValueError(f"a formatted text must hold {mark} once")
        place[mark] = np.copy(off[:-1])
        place[mark][marked] = at[own]
    begin, end = off[:-1], off[1:]
    psm = forms == 1
    part = {PREFIX: (place[PREFIX] + MARK, np.where(psm, place[SUFFIX], place[MIDDLE])),
            SUFFIX: (place[SUFFIX] + MARK, np.where(psm, place[MIDDLE], place[PREFIX])),
            MIDDLE: (place[MIDDLE] + MARK, end)}
    plain = forms == 0
    text_off = off - 3 * MARK * np.concatenate(([0], np.cumsum(~plain)))
    at, places, shifts = text_off[:-1].copy(), [], []
    for mark in (PREFIX, MIDDLE, SUFFIX):
        a, b = part[mark]
        a, b = np.where(plain, begin, a), np.where(plain, end if mark == PREFIX else begin, b)
        a = np.where(plain & (mark != PREFIX), end, a)
        places.append(at.copy())
        shifts.append(a - at)
        at += np.where(plain & (mark != PREFIX), 0, b - a)
    data = np.empty(int(text_off[-1]), np.uint8)
    for x, y, index in displacements(len(data), np.stack(places, 1).ravel(), np.stack(shifts, 1).ravel()):
        data[x:y] = raw[index]
    return _strings(data, text_off)


_FORMS = pa.array([PLAIN, PSM, SPM])


def _form_numbers(column: pa.Array) -> np.ndarray:
    forms = pc.index_in(column, value_set=_FORMS)
    if forms.null_count:
        raise ValueError(f"a form must be one of {PLAIN}, {PSM}, {SPM}")
    return forms.to_numpy().astype(np.int64)


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def cuts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars`` of ``docs``, as JVM expressions."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text).cast("long")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    one, two = _number(digest, 0) % (n + 1), _number(digest, 1) % (n + 1)
    plain = (n == 0) | (_number(digest, 2) % 100 >= FORMATTED)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, PLAIN).when(_number(digest, 3) % 100 < SUFFIX_FIRST, SPM).otherwise(PSM)
    cut = docs.select("doc_id", text.alias("text"), n.alias("n"), form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    formatted = F.col("form") != PLAIN
    return cut.select("doc_id", "text", "n", "form", F.when(formatted, F.col("a")).alias("prefix_chars"), F.when(formatted, F.col("b") - F.col("a")).alias("middle_chars"))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``n`` (code
    points), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain), ``output`` (the formatted text).

    A null text is empty. Empty texts and texts that hold a mark are plain, so
    every output can be restored. A null doc_id is cut as an empty one.
    Repeated rows are formatted each, alike. Other columns are ignored; an
    empty table gives no rows. Texts of any length are formatted whole.
    """
    def run(batches):
        for batch in batches:
            forms = _form_numbers(batch.column("form"))
            prefix, middle = (batch.column(c).fill_null(0).to_numpy() for c in ("prefix_chars", "middle_chars"))
            for i, j, _, _ in K.chunks(*K.buffers(batch.column("text"))):
                part = batch.slice(i, j - i)
                output = scatter(part.column("text"), forms[i:j], prefix[i:j], middle[i:j])
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")), output],
                                      names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cuts(docs).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(formatted: DataFrame) -> DataFrame:
    """``formatted(output, form)`` with the column ``restored``: the text of
    each output, from its marks and form alone. A null output or form, or one
    without its marks, is an error. A column ``restored`` is replaced."""
    def run(batches):
        for batch in batches:
            forms = _form_numbers(batch.column("form"))
            if batch.column("output").null_count:
                raise ValueError("an output must not be null")
            for i, j, _, _ in K.chunks(*K.buffers(batch.column("output"))):
                part = batch.slice(i, j - i)
                yield pa.record_batch([*part.columns, gather(part.column("output"), forms[i:j])], names=[*batch.schema.names, "restored"])

    ship_code(formatted.sparkSession)
    kept = formatted.drop("restored")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return kept.mapInArrow(run, kinds + "restored string")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents formatted and restored."""
    texts = restore(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return texts.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM cut
), forms AS (
  SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM forms
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
