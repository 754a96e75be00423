"""Token counts with a whole-token shortcut (sentencepiece models).

No piece of the vocabulary holds a space mark behind another character, so
no merge crosses from a word to the space after it: a text's tokens are those
of its pre-tokens, each a run of spaces with the characters up to the next
one. That is checked when the model is loaded. Also then, every piece that
begins with a space mark is encoded alone: those that come back as that one
token are *whole*. Counting needs no encoding for whole pre-tokens; the
others are merged by the library, each distinct one once per batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as K
from .scratch import read_table, ship_code

MARK = "▁"
#: Counts of merged pre-tokens that a worker remembers between batches.
REMEMBERED = 150_000
MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts tokens as ``encode`` of the model gives them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        #: True if pre-tokens are independent: the mark stands only in front, and spaces are neither dropped nor merged.
        self.splits = not any(MARK in p.lstrip(MARK) for p in plain) and self.model.encode("a  b ", out_type=str)[:1] == [MARK + "a"] \
            and "".join(self.model.encode("a  b ", out_type=str)) == f"{MARK}a{MARK}{MARK}b{MARK}"
        heads = [p[1:] for p in plain if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
        self.whole = {p for p, ids in zip(heads, self.model.encode(heads, num_threads=1)) if len(ids) == 1}
        self.known = dict.fromkeys(self.whole, 1)

    def of_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token, given without its first space mark."""
        counts = list(map(self.known.get, words))
        rest = [i for i, n in enumerate(counts) if n is None]
        if rest:
            if len(self.known) + len(rest) > REMEMBERED:
                self.known = dict.fromkeys(self.whole, 1)
            merged = [words[i] for i in rest]
            for i, w, ids in zip(rest, merged, self.model.encode(merged, num_threads=1)):
                counts[i] = self.known[w] = len(ids)
        return np.array(counts, np.int64)

    def count(self, texts) -> np.ndarray:
        """Tokens of every text; a null text is empty."""
        raw, off = K.buffers(texts)
        if not self.splits:
            return np.array([len(self.model.encode(t or "")) for t in texts.to_pylist()], np.int64)
        out = np.zeros(len(off) - 1, np.int64)
        for i, j, r, o in K.chunks(raw, off, 1 << 24):
            out[i:j] = self._chunk(r, o)
        # a mark character inside a text, or a NUL, is left to the library
        odd = np.flatnonzero(_holds(raw, off, MARK.encode()) | _holds(raw, off, b"\0"))
        for i in odd:
            out[i] = len(self.model.encode(bytes(raw[off[i]:off[i + 1]]).decode()))
        return out

    def _chunk(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not len(raw):
            return np.zeros(len(off) - 1, np.int64)
        space = raw == 0x20
        first = np.zeros(len(raw), bool)
        first[off[:-1][off[:-1] < off[1:]]] = True
        begins = first.copy()
        begins[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        at = np.searchsorted(starts, off)
        # the text's first pre-token gets its mark from the library, the others give up one space
        drop = ~first[starts]
        keep = np.ones(len(raw), bool)
        keep[starts[drop]] = False
        values = raw[keep]
        sizes = ends - starts - drop
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())).dictionary_encode()
        n = self.of_words(words.dictionary.to_pylist())
        tokens = n[words.indices.to_numpy()]
        tokens[sizes == 0] = 1  # one space at the end of a text
        run = np.concatenate(([0], np.cumsum(tokens)))
        return run[at[1:]] - run[at[:-1]]


def _holds(raw: np.ndarray, off: np.ndarray, what: bytes) -> np.ndarray:
    """Which texts hold these bytes."""
    hit = raw[:len(raw) - len(what) + 1] == what[0]
    for k in range(1, len(what)):
        hit = hit & (raw[k:len(raw) - len(what) + 1 + k] == what[k])
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(hit), side="right") - 1] = True
    return out


@lru_cache(maxsize=2)
def _counter(model: str) -> PieceCounter:
    return PieceCounter(tokenizer_path(model))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``n_bytes``
    (UTF-8), ``n_tokens`` (as the model's library gives them, without begin
    and end), ``over_limit`` (n_tokens > limit).

    A null or empty text has no bytes and no tokens. Strings like ``</s>``
    inside a text are ordinary text. Repeated rows are counted each; other
    columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            n = _counter(model).count(texts)
            sizes = np.diff(K.buffers(texts)[1])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(read_table(spark, sf_dir, "documents"))
