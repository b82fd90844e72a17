"""SentencePiece (BPE kind) encoding and decoding by a prefix table.

The last token of every prefix's encoding is unique, and a token ends a prefix
exactly when it is compatible with the last token of what precedes it. So one
pass over an automaton's matches fills the table, and the ids are read off it
backwards: time is linear in the text, with no merge queue.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palisade.llm import textvec as tv
from palisade.llm.common import fresh

MARK = "▁"  # how a space is written in pieces
#: Encodings of words, and pairs of pieces, kept by a task; each memory is emptied when it is
#: full. Words of more characters than LONGEST aren't kept, which bounds the bytes.
WORDS_KEPT, PAIRS_KEPT, LONGEST = 400_000, 400_000, 40
#: Ids decoded at a time, which bounds the memory for long texts.
BLOCK = 1 << 16


def default_model() -> str:
    """Path of the public 32k model, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """A model's vocabulary. ``reachable`` are the pieces an encoding can hold."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # id of byte b
    special: list[int]
    reachable: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        byte_ids = [-1] * 256
        special = []
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                special.append(i)
        if -1 in byte_ids:
            raise ValueError("the model has no byte fallback")
        if model.encode("a  b") != model.encode(" a  b")[1:] and model.decode(model.encode("  a")) != "  a":
            raise ValueError("the model normalises white space")
        out = cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], byte_ids, special)
        skip = set(byte_ids) | set(special)
        ids = {p: i for i, p in enumerate(out.pieces) if i not in skip}
        for p in ids:
            if MARK in p.lstrip(MARK):
                raise ValueError("a piece joins the end of one word to the next")
            if any(c not in ids for c in p):
                raise ValueError("a piece has a character that is no piece")
        table = PrefixTable(out, ids)
        out.reachable = [i for p, i in ids.items() if table.merge(p) == [i]]
        return out


class PrefixTable:
    """Encodes stretches of known characters; one per worker process."""

    def __init__(self, vocab: Pieces, ids: dict[str, int] | None = None) -> None:
        self.pieces, self.scores = vocab.pieces, vocab.scores
        if ids is None:
            skip = set(vocab.byte_ids) | set(vocab.special)
            ids = {p: i for i, p in enumerate(vocab.pieces) if i not in skip}
        self.ids = ids
        self.byte_ids = vocab.byte_ids
        self.pairs: dict[int, bool] = {}
        self.automaton = None
        if vocab.reachable:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i in vocab.reachable:
                self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
            self.automaton.make_automaton()
        self.known = re.compile(f"([^{re.escape(''.join(c for c in ids if len(c) == 1))}])")
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, list[int]] = {}

    def merge(self, s: str) -> list[int]:
        """Ids by merging the best-scored adjacent pair, leftmost first: the definition."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                token = self.ids.get(parts[i] + parts[i + 1])
                if token is not None and (best is None or self.scores[token] > best):
                    best, at = self.scores[token], i
            if best is None:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a, b next to each other stay a, b; remembered in ``pairs``."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def encode_known(self, s: str) -> list[int]:
        n = len(s)
        last = [-1] * (n + 1)
        from_ = [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, size) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 20 | token)
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    continue
            last[end] = token
            from_[end] = start
        out, end = [], n
        while end:
            out.append(last[end])
            end = from_[end]
        out.reverse()
        return out

    def encode_any(self, s: str) -> list[int]:
        """Known stretches by the table, any other character by its bytes."""
        if not self.known.search(s):
            return self.encode_known(s)
        out: list[int] = []
        for i, part in enumerate(self.known.split(s)):
            if i % 2:
                out += [self.byte_ids[b] for b in part.encode()]
            elif part:
                out += self.encode_known(part)
        return out

    def word(self, w: str) -> bytes:
        """int32 ids of a word that follows one space."""
        head, newline, rest = w.partition("\n")
        if newline:
            tail = b"".join(array("i", [self.byte_ids[10], *self.encode_line(x)]).tobytes() for x in rest.split("\n"))
            return (self.words.get(head) or self.word(head)) + tail
        found = array("i", self.encode_any(MARK + w)).tobytes()
        if len(w) <= LONGEST:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[w] = found
        return found

    def encode_line(self, x: str) -> list[int]:
        """A line's start up to the first space, kept like a word."""
        found = self.lines.get(x)
        if found is None:
            found = self.encode_any(x)
            if len(x) <= LONGEST:
                if len(self.lines) >= WORDS_KEPT:
                    self.lines.clear()
                self.lines[x] = found
        return found

    def encode_chunk(self, c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per row) of many texts: their units, a word after a space or the start of
        a line, are told apart by hash, and each different one is encoded once."""
        buf, offsets = c.buf, c.offsets
        odd = self._odd_rows(c)
        row_of = np.repeat(np.arange(c.rows), c.lengths)
        plain = ~odd & (c.lengths > 0)
        breaks = np.flatnonzero(((buf == 32) | (buf == 10)) & plain[row_of])
        # A unit that ends a row in a break is empty and starts where the next row does: it comes first.
        start = np.concatenate([breaks + 1, offsets[:-1][plain]])
        row = np.concatenate([row_of[breaks], np.flatnonzero(plain)])
        line = np.concatenate([buf[breaks] == 10, np.zeros(int(plain.sum()), bool)])
        order = np.argsort(start, kind="stable")
        start, row, line = start[order], row[order], line[order]
        end = np.sort(np.concatenate([breaks, offsets[1:][plain]]))
        h = tv.span_hashes(buf, start, end)
        h[line] = tv.mix(h[line] + np.uint64(1))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        newline = array("i", [self.byte_ids[10]]).tobytes()
        units = []
        for a, b, starts_line in zip(start[first].tolist(), end[first].tolist(), line[first].tolist()):
            unit = buf[a:b].tobytes().decode()
            units.append(newline + array("i", self.encode_line(unit)).tobytes() if starts_line else self.words.get(unit) or self.word(unit))
        size = np.array([len(u) // 4 for u in units], np.int64)
        pool = np.frombuffer(b"".join(units), np.int32)
        sizes = size[which] if len(which) else np.zeros(0, np.int64)
        at = np.arange(int(sizes.sum())) + np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(sizes) - sizes), sizes)
        ids, per_row = pool[at], np.bincount(row, sizes, c.rows).astype(np.int64)
        if odd.any():
            each = [np.frombuffer(self.encode(buf[offsets[r] : offsets[r + 1]].tobytes().decode()), np.int32) for r in np.flatnonzero(odd)]
            per_row[odd] = [len(x) for x in each]
            whole = np.empty(int(per_row.sum()), np.int32)
            mask = np.repeat(odd, per_row)
            whole[~mask], whole[mask] = ids, np.concatenate(each)
            ids = whole
        return ids, per_row

    def _odd_rows(self, c: tv.Chunk) -> np.ndarray:
        """Rows with spaces side by side or at an end, or with the mark itself."""
        buf, odd = c.buf, np.zeros(c.rows, bool)
        space = buf == 32
        row_of = np.searchsorted(c.offsets, np.flatnonzero(space), "right") - 1
        at = np.flatnonzero(space)
        twice = np.zeros(len(at), bool)
        twice[1:] = at[1:] == at[:-1] + 1
        odd[row_of[twice | (at == c.offsets[row_of]) | (at == c.offsets[row_of + 1] - 1)]] = True
        marks = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
        odd[np.searchsorted(c.offsets, marks, "right") - 1] = True
        return odd

    def encode(self, text: str) -> bytes:
        """int32 ids of a whole text."""
        if not text:
            return b""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            get, word = self.words.get, self.word
            return b"".join([get(w) or word(w) for w in text.split(" ")])
        marked = MARK + text.replace(" ", MARK)
        units = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        get, word = self.words.get, self.word
        return b"".join([(get(u[1:]) or word(u[1:])) if u[1:2] != MARK and len(u) > 1 else array("i", self.encode_any(u)).tobytes() for u in units])


class Decoder:
    """Ids to text by gathering piece bytes, many texts at once."""

    def __init__(self, vocab: Pieces) -> None:
        byte_of = {i: bytes([b]) for b, i in enumerate(vocab.byte_ids)}
        special = set(vocab.special)
        parts = [byte_of[i] if i in byte_of else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(vocab.pieces)]
        parts[0] = " ⁇ ".encode() if 0 in special else parts[0]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.pool = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and row offsets of the texts; each loses the one space its encoding began with."""
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        out = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(ids), BLOCK):
            part = ids[a : a + BLOCK]
            size = self.size[part]
            stops = np.cumsum(size)
            at = np.arange(int(stops[-1])) + np.repeat(self.start[part] - (stops - size), size)
            out[ends[a] : ends[a + len(part)]] = self.pool[at]
        byte_offsets = ends[offsets]
        some = np.flatnonzero(np.diff(byte_offsets) > 0)
        drop = byte_offsets[:-1][some]
        drop = drop[out[drop] == 32]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        return out[keep], byte_offsets - np.searchsorted(drop, byte_offsets, "left")


_tables: dict[int, tuple[PrefixTable, Decoder]] = {}


def _worker(vocab: Pieces, key: int) -> tuple[PrefixTable, Decoder]:
    if key not in _tables:
        _tables.clear()
        _tables[key] = PrefixTable(vocab), Decoder(vocab)
    return _tables[key]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``tokens`` (ids), ``n_tokens`` and ``decoded`` (the ids' text).

    The ids are those of the sentencepiece library for models of kind BPE with
    byte fallback and identity normalisation (others raise ValueError); the
    vocabulary is read on the driver from ``model`` and broadcast (its size is
    the model's, not the data's). Texts are encoded whole. ``decoded`` equals
    ``text`` but for U+2581, which the format cannot tell from a space.

    A null text has null tokens, count and decoded text; an empty text has no
    tokens. Repeated rows are encoded alike; an empty table gives no rows;
    columns of other names pass through, and ones named like a new column stay
    while the new one gets a leading underscore.
    """
    spark = docs.sparkSession
    vocab = Pieces.load(model or default_model())
    key = hash((tuple(vocab.pieces), tuple(vocab.scores)))
    shared = spark.sparkContext.broadcast(vocab)
    names = docs.columns
    text = next((i for i, c in enumerate(names) if c.lower() == "text"), None)
    added = [fresh(docs, n) for n in ("tokens", "n_tokens", "decoded")]
    result = T.StructType([*docs.schema.fields, T.StructField(added[0], T.ArrayType(T.IntegerType())), T.StructField(added[1], T.IntegerType()), T.StructField(added[2], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, decoder = _worker(shared.value, key)
        try:
            for batch in batches:
                column = batch.column(text) if text is not None else pa.nulls(batch.num_rows, pa.string())
                for c in tv.chunks(column):
                    own = column.slice(c.first, c.rows)
                    ids, sizes = table.encode_chunk(c)
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                    data, at = decoder.decode(ids, offsets)
                    none = own.is_null()
                    texts = pa.Array.from_buffers(pa.string(), c.rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                    new = [pa.compute.if_else(none, None, x) for x in (lists, pa.array(sizes.astype(np.int32)), texts)]
                    yield pa.RecordBatch.from_arrays([*(x.slice(c.first, c.rows) for x in batch.columns), *new], names=[*names, *added])
        finally:  # workers are reused: what a task remembers goes with it
            table.words.clear()
            table.lines.clear()
            table.pairs.clear()
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, result)
