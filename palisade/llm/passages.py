"""Substring deduplication: repeated paragraphs of text across documents.

Passages that repeat are often set inside longer paragraphs, so a paragraph
here is a stretch of WORDS words that starts at an anchor: a word whose
following 3-gram has the least hash among ``reach`` neighbours. Anchors depend on
the local words alone, so a shared passage has the same ones wherever it stands;
every ``reach`` places have one, so a passage of WORDS + ``reach`` - 1 words or
more has a paragraph in common wherever it stands.
The text's own paragraphs count too: of each line, its first and its last WORDS
words, or all of it where it has fewer. What repeats is reported as stretches,
as long as they go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palisade.llm import textvec as tv
from palisade.llm.buckets import split_by_rare_tokens
from palisade.llm.common import fresh, materialise, pick, release, schema
from palisade.llm.components import connected_components

#: Words of a paragraph, and of the shingles it is compared by.
WORDS, SHINGLE = 20, 3
#: Words of a stretch that is reported: about 50 tokens of a subword tokenizer. Shorter repeats
#: are lines (licences, headings), which line dedup counts.
MIN_WORDS = 40
#: Exact Jaccard similarity of shingles from which two paragraphs are the same passage.
THRESHOLD = 0.6
RECALL, AT = 0.95, THRESHOLD
#: Sets of bands that are shuffled one after the other, so that only one's files stand at a time.
PARTS = 2
#: Bytes of a bucket's packed rows that are held before equal ones are put together.
HELD_BYTES = 64 << 20
#: Contents of one packed row, and packed rows of a batch: small enough for the heap's regions.
PACK_ROWS, PACKS = 4096, 32
#: Contents of a bucket each of whose others is compared with; what is still open then is
#: split by rare shingles if it is more than that.
HOT = 256
SEED = 4242


def tune_bands(similarity: float = AT, recall: float = RECALL, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` minima by which paragraphs of this
    Jaccard ``similarity`` collide with probability ``recall`` at least."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i:i+n] for each i, in log2(n) steps."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _anchors(h: np.ndarray, row: np.ndarray, sizes: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """Indices of the words at which paragraphs start: minima of ``h`` (3-gram hash
    at each word) over ``reach`` places within a row; a short row starts at its first."""
    n = len(h)
    if n < reach:
        picks = np.zeros(0, np.int64)
    else:
        low = _sliding_min(h, reach)
        low = np.where(row[: n - reach + 1] == row[reach - 1 :], low, np.uint64(0))
        # An anchor is the minimum of a window it is in: the greatest of those windows' minima.
        around = np.concatenate([np.zeros(reach - 1, np.uint64), low, np.zeros(reach - 1, np.uint64)])
        picks = np.flatnonzero(~_sliding_min(~around, reach) == h)
    short = first[:-1][(sizes > 0) & (sizes < reach)]
    return np.sort(np.concatenate([picks, short]))


def _line_ends(c: tv.Chunk, w: tv.Words, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle, shingles) of the first and the last ``width`` shingles of each
    line, of all of them where it has fewer; lines of under SHINGLE words have none."""
    if not len(w.row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.cumsum(c.buf == 10)[w.start]
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])]))
    n = np.diff(np.append(new, len(line))) - SHINGLE + 1
    new, n = new[n > 0], n[n > 0]
    at = first[w.row[new]] + new - w.first[w.row[new]]
    return np.concatenate([at, at + np.maximum(n - width, 0)]), np.tile(np.minimum(n, width), 2)


class Paragraphs:
    """The paragraphs of a chunk that find every stretch of ``min_words``: byte and word spans,
    row, shingles (sorted) and a content hash."""

    def __init__(self, c: tv.Chunk, min_words: int = MIN_WORDS) -> None:
        least, reach = min(min_words, WORDS), max(1, min_words - WORDS + 1)
        w = tv.words(c)
        h, first = tv.shingles(w, SHINGLE)
        sizes = np.diff(first)
        row = np.repeat(np.arange(c.rows), sizes)
        at = _anchors(h, row, sizes, first, reach)
        # Not past the end of the row: the last paragraph of a row is its last WORDS words.
        width = WORDS - SHINGLE + 1
        last = first[row[at] + 1] - width if len(at) else at
        at = np.maximum(np.minimum(at, last), first[row[at]] if len(at) else at)
        size = np.minimum(width, first[row[at] + 1] - at) if len(at) else at
        line_at, line_size = _line_ends(c, w, first, width)
        both = np.sort(np.concatenate([at, line_at]) * (width + 1) + np.concatenate([size, line_size]))
        at, size = np.divmod(both[np.diff(both, prepend=-1) != 0], width + 1)
        self.row = row[at]
        words = np.minimum(size + SHINGLE - 1, w.counts()[self.row])
        keep = np.flatnonzero(words >= least)
        at, size, words, self.row = at[keep], size[keep], words[keep], self.row[keep]
        lanes = at[:, None] + np.minimum(np.arange(width)[None, :], size[:, None] - 1)
        self.sets = np.sort(h[lanes], axis=1) if len(at) else np.zeros((0, width), np.uint64)
        self.word, self.words = at - first[self.row], words
        start = w.first[self.row] + self.word
        self.start = w.start[start] - c.offsets[self.row]
        self.end = w.end[start + words - 1] - c.offsets[self.row]
        again = np.zeros_like(self.sets, bool)
        again[:, 1:] = self.sets[:, 1:] == self.sets[:, :-1]
        self.content = tv.mix(np.where(again, np.uint64(0), tv.mix(self.sets)).sum(axis=1, dtype=np.uint64))


_PACKED = schema(("bucket", T.LongType()), ("rows", T.BinaryType()))
_MET = schema(*((n, T.LongType()) for n in ("key", "content", "times", "lo", "hi")), ("several", T.BooleanType()))
_PLACES = schema(("doc_id", T.LongType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("w", T.IntegerType()), ("w_end", T.IntegerType()), ("c", T.LongType()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*pick(docs, doc_id="doc_id", text="text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def _pack(columns: np.ndarray) -> bytes:
    """Columns (key, content, lo, hi, times) of int64 as bytes: hi and times only where a row stands
    for several, and lo by place of byte, which compresses."""
    key, content, lo, hi, times = columns
    more = np.flatnonzero(times > 1)
    small = np.ascontiguousarray(lo).view(np.uint8).reshape(-1, 8).T
    return b"".join(x.tobytes() for x in (np.int64(len(key)), key, content, small, more, hi[more], times[more]))


def _unpack(rows: bytes) -> np.ndarray:
    n = int(np.frombuffer(rows, np.int64, 1)[0])
    out = np.ones((5, n), np.int64)
    out[:2] = np.frombuffer(rows, np.int64, 2 * n, 8).reshape(2, n)
    out[2:4] = np.ascontiguousarray(np.frombuffer(rows, np.uint8, 8 * n, 8 + 16 * n).reshape(8, n).T).view(np.int64)[:, 0]
    more, hi, times = np.frombuffer(rows, np.int64, offset=8 + 24 * n).reshape(3, -1)
    out[3, more], out[4, more] = hi, times
    return out


def _equal_as_one(columns: np.ndarray) -> np.ndarray:
    """Rows of equal key and content as one: least lo, greatest hi, sum of times; sorted by both."""
    columns = columns[:, np.lexsort((columns[1], columns[0]))]
    key, content, lo, hi, times = columns
    if not len(key):
        return columns
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
    return np.stack([key[new], content[new], np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new), np.add.reduceat(times, new)])


def contents(docs: DataFrame, bands: int, rows: int, own: range, parts: int, min_words: int = MIN_WORDS) -> DataFrame:
    """(bucket, rows): per batch of documents, its distinct paragraphs by their hashes of the bands
    ``own``: (key, content, least and greatest doc_id, times), packed. A band's keys are in
    ``parts`` buckets, bucket // parts being the band. Equal ones collapse before any shuffle,
    and what is shuffled is a row a bucket."""
    a, b = tv.universal(bands * rows, SEED)
    salt = tv.seeds(bands, SEED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = []
            for c in tv.chunks(batch.column(1)):
                p = Paragraphs(c, min_words)
                sets = np.ascontiguousarray(p.sets.T)
                v, key = np.empty_like(sets), np.empty((len(own), len(p.row)), np.uint64)
                for at, band in enumerate(own):
                    k = np.full(len(p.row), salt[band])
                    for i in range(band * rows, (band + 1) * rows):
                        np.multiply(sets, a[i], out=v)
                        v += b[i]
                        k = tv.mix(k + v.min(0))
                    key[at] = k
                found.append((p.content, ids[c.first + p.row], key))
            if not found:
                continue
            content, owner, key = (np.concatenate([x[i] for x in found], axis=-1) for i in range(3))
            if not len(content):
                continue
            del found, p, sets, v  # a batch's paragraphs are what takes most memory
            order = np.argsort(content, kind="stable")
            content, owner = content[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
            times = np.diff(np.append(new, len(content)))
            lo, hi = np.minimum.reduceat(owner, new), np.maximum.reduceat(owner, new)
            content, key = content[new].view(np.int64), key[:, order[new]]
            for at, band in enumerate(own):
                part = (key[at] % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                edges = np.append(np.flatnonzero(np.diff(part[by], prepend=-1) != 0), len(by))
                spans = [(i, min(i + PACK_ROWS, y)) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()) for i in range(x, y, PACK_ROWS)]
                for some in range(0, len(spans), PACKS):
                    places = [by[x:y] for x, y in spans[some : some + PACKS]]
                    packed = [_pack([x[i] for x in (key[at].view(np.int64), content, lo, hi, times)]) for i in places]
                    yield pa.RecordBatch.from_arrays([pa.array([band * parts + int(part[i[0]]) for i in places]), pa.array(packed, pa.binary())], names=_PACKED.names)

    return _texts(docs).mapInArrow(run, _PACKED)


def _met(parts: int):
    """Over ``contents`` sorted by bucket: the contents whose key is met in two documents at least,
    as (key, content, times, lo, hi, several). ``several`` says that a key has other contents
    too; a content that has no other beside it is in two documents by itself, with every
    key it has, and given for band 0 alone.

    One bucket is held at a time, its equal rows put together as it grows.
    """

    def flush(bucket: int, held: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(held, axis=1)
        columns = columns[:, np.argsort(columns[0])]
        key, _, lo, hi, _ = columns
        change = key[1:] != key[:-1]
        alone = np.concatenate([[True], change]) & np.concatenate([change, [True]])
        columns = _equal_as_one(columns[:, ~alone | (lo < hi)])  # a key of one row and one document meets none
        key, content, lo, hi, times = columns
        new = np.flatnonzero(np.diff(key) != 0) + 1
        first = np.concatenate([[0], new]) if len(key) else new
        size = np.diff(np.append(first, len(key)))
        met, several = (np.repeat(x, size) for x in (np.minimum.reduceat(lo, first) < np.maximum.reduceat(hi, first), size > 1)) if len(key) else (np.zeros(0, bool),) * 2
        at = np.flatnonzero(met & (several | (bucket < parts)))
        return pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (key, content, times, lo, hi)), pa.array(several[at])], names=_MET.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, size, most = None, 0, HELD_BYTES
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != now:
                    yield flush(now, held)
                    held, size, most = [], 0, HELD_BYTES
                now = bucket
                held.append(_unpack(rows.as_buffer()))
                size += held[-1].nbytes
                if size > most:
                    held = [_equal_as_one(np.concatenate(held, axis=1))]
                    size = held[0].nbytes
                    most = max(HELD_BYTES, 2 * size)
        if held:
            yield flush(now, held)

    return run


def places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, w, w_end, c): every paragraph; start and end are byte offsets in
    the text's UTF-8, w and w_end count its words. Equal ones that overlap (a word over
    and over) are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                p = Paragraphs(c, min_words)
                w_end = p.word + p.words
                new = np.ones(len(p.row), bool)
                new[1:] = (p.content[1:] != p.content[:-1]) | (p.row[1:] != p.row[:-1]) | (p.word[1:] > w_end[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(new)) - 1 if len(first) else first
                ids = batch.column(0).slice(c.first, c.rows).take(pa.array(p.row[first]))
                spans = [pa.array(x.astype(np.int32)) for x in (p.start[first], p.end[last], p.word[first], w_end[last])]
                yield pa.RecordBatch.from_arrays([ids, *spans, pa.array(p.content[first].view(np.int64))], names=_PLACES.names)

    return _texts(docs).mapInArrow(run, _PLACES)


_SIDE = [(f"{side}{kind}", T.BinaryType()) for side in ("left", "right") for kind in ("", "_at")]
_AROUND = schema(("passage", T.LongType()), ("content", T.LongType()), ("removed", T.BooleanType()), ("is_first", T.BooleanType()), ("doc_id", T.LongType()), *((n, T.IntegerType()) for n in ("start", "end", "w", "w_end")), *_SIDE)


def surroundings(docs: DataFrame, found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``found`` (passage, content, removed, is_first, doc_id, start, end, w, w_end) with, per side, the hashes of the
    words next to it, nearest first, and the offsets it would reach to with each of them: of more
    words than lie before a passage's first anchor, or behind its last whole paragraph. Four
    bytes each, the greatest first."""
    growth = max(1, min_words - WORDS + 1) + SHINGLE
    lists = found.groupBy(F.col("doc_id").alias("w_id")).agg(F.collect_list(F.struct("passage", "content", "removed", "is_first", "start", "end", "w", "w_end")).alias("spans"))
    texts = _texts(docs)
    rows = texts.join(lists, texts.doc_id == lists.w_id).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                w = tv.words(c)
                own = batch.column(2).slice(c.first, c.rows)
                row = np.repeat(np.arange(c.rows), own.value_lengths().to_numpy(zero_copy_only=False))
                passage, content, removed, is_first, start, end, word, word_end = (x.to_numpy(zero_copy_only=False) for x in own.flatten().flatten())
                # A row that repeats a doc_id with another text may not have the span.
                a, b = np.searchsorted(w.start, c.offsets[row] + start), np.searchsorted(w.end, c.offsets[row] + end)
                last = len(w.start) - 1
                here = np.flatnonzero((w.first[row] <= a) & (b < w.first[row + 1]) & (w.start[np.minimum(a, last)] == c.offsets[row] + start) & (w.end[np.minimum(b, last)] == c.offsets[row] + end))
                passage, content, removed, is_first, start, end, word, word_end, row, a, b = (x[here] for x in (passage, content, removed, is_first, start, end, word, word_end, row, a, b))
                ids = batch.column(0).slice(c.first, c.rows).take(pa.array(row))
                columns = [pa.array(passage), pa.array(content), pa.array(removed.astype(bool)), pa.array(is_first.astype(bool)), ids, *(pa.array(x) for x in (start, end, word, word_end))]
                steps = np.arange(1, growth + 1)
                for at, edge in ((a[:, None] - steps, w.start), (b[:, None] + steps, w.end)):
                    there = (at >= w.first[row][:, None]) & (at < w.first[row + 1][:, None])
                    words, owner = at[there], np.nonzero(there)[0]
                    ends = pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(there.sum(1))]).astype(np.int32))
                    for values in (w.hash[words] >> np.uint64(32), edge[words] - c.offsets[row[owner]]):
                        columns.append(pa.Array.from_buffers(pa.binary(), len(there), [None, ends, pa.py_buffer(values.astype(">u4"))]))
                yield pa.RecordBatch.from_arrays(columns, names=_AROUND.names)

    return rows.mapInArrow(run, _AROUND)


def _occurrences(found: DataFrame) -> DataFrame:
    """``found`` (passage, content, doc_id, start, end, w, w_end) with ``removed``; passages of one document go.

    Paragraphs of a passage that overlap in a document are one occurrence of it,
    so that none is removed for being like its neighbour.
    """
    w = Window.partitionBy("passage", "doc_id").orderBy("start", "end")
    new = F.coalesce(F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    begins = F.max(F.when(F.col("new"), F.col("start"))).over(w)
    # Rows that repeat a document are one; the exchange is the window's.
    islands = found.repartition("passage", "doc_id").distinct().withColumn("new", new).withColumn("begins", begins).withColumn("least", F.min("start").over(w))
    firsts = found.groupBy("passage").agg(F.max("doc_id").alias("hi"), F.min("doc_id").alias("lo")).where("lo < hi")
    return islands.join(firsts.hint("merge"), "passage").select("passage", "content", F.expr("NOT (doc_id = lo AND begins = least)").alias("removed"), "doc_id", "start", "end", "w", "w_end")


_SIDES = schema(("passage", T.LongType()), ("content", T.LongType()), ("removed", T.BooleanType()), ("doc_id", T.LongType()), *((n, T.IntegerType()) for n in ("start", "end", "w", "w_end")), ("open", T.BooleanType()), ("lead", T.BooleanType()))


def _running_max(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each place, the maximum of ``x`` (0 or more) before it in its group, -1 at its first; ``new``: a group begins."""
    group = np.cumsum(new).astype(np.int64) << 32
    out = np.empty(len(x), np.int64)
    out[:1] = -1
    out[1:] = (np.maximum.accumulate(group + x) - group)[:-1]
    out[new] = -1
    return out


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with their documents whole, of batches sorted by ``doc_id``; only the last document is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc_id").to_numpy()
        new = int(np.searchsorted(doc, doc[-1]))  # the last document stays open
        if held and doc[0] != held[-1].column("doc_id")[-1].as_py():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if new:
            yield pa.Table.from_batches([*held, batch.slice(0, new)]).combine_chunks()
            held = []
        held.append(batch.slice(new))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _apart(*keys: np.ndarray) -> np.ndarray:
    """Whether any of the ``keys`` differs from the one before it; there is one at least."""
    return np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_occurrences``, documents together, with ``open`` and ``lead``.

    One is open if no other of its document, removed or not as it is, reaches over
    one of its sides. One leads if it is the first of its content in its document.
    """

    def flush(t: pa.Table) -> pa.RecordBatch:
        content, doc, removed, start, end = (t.column(n).to_numpy().astype(np.int64) for n in ("content", "doc_id", "removed", "start", "end"))
        open_, lead = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        by = np.lexsort((end, start, removed, doc))
        open_[by] = _running_max(end[by], _apart(doc[by], removed[by])) < start[by]
        by = np.lexsort((-start, -end, removed, doc))
        most = 1 << 31
        before = most - _running_max(most - start[by], _apart(doc[by], removed[by]))  # the least start before, above all at first
        open_[by] |= before > end[by]
        by = np.lexsort((end, start, content, doc))
        lead[by] = _apart(doc[by], content[by])
        return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in t.columns), pa.array(open_), pa.array(lead)], names=_SIDES.names)

    for t in _whole_documents(batches):
        yield flush(t)


def _edges(found: DataFrame) -> DataFrame:
    """Of ``found`` with ``open`` and ``lead``, the paragraphs that may grow and their first equals,
    or whose first equal may grow; with ``is_first``.

    One may grow if it is open: what lies over its sides is reported already where one is not.
    """
    firsts = found.groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.expr("min_by(open, doc_id) FILTER (WHERE lead)").alias("first_open"), F.max("open").alias("any_open"))
    is_first = F.expr("lead AND doc_id = first_doc")
    met = found.join(firsts.hint("merge"), "content").withColumn("is_first", is_first).where("open OR first_open OR any_open AND is_first")
    return met.drop("open", "lead", "first_doc", "first_open", "any_open")


@F.arrow_udf(T.IntegerType())
def _shared(one: pa.Array, other: pa.Array) -> pa.Array:
    """How many words of four bytes the two have in common from their start on."""
    sizes = [np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]) // 4 for x in (one, other)]
    width = max([1, *(int(s.max()) for s in sizes if len(s))])
    same = np.zeros((2, len(one), width + 1), np.uint32)
    there = [np.arange(width + 1) < s[:, None] for s in sizes]
    for side, x, at in zip(same, (one, other), there):
        side[at] = np.frombuffer(b"".join(x.to_pylist()), np.uint32)
    return pa.array(np.argmin((same[0] == same[1]) & there[0] & there[1], axis=1).astype(np.int32))


def _grown(found: DataFrame) -> DataFrame:
    """(passage, doc_id, start, end, w, w_end, removed) of ``found`` with its surroundings.

    A removed paragraph grows over the words it has in common with the first
    document that has the very same paragraph; one that stays grows as far as
    any of its equals does. So all that a removed one gains stands in an earlier
    document.
    """
    firsts = found.where("is_first").groupBy("content").agg(F.min(F.struct("doc_id", "left", "right")).alias("first"))
    first = F.col("doc_id") == F.col("first.doc_id")
    length = lambda side: F.when(first, 0).otherwise(_shared(side, f"first.{side}"))
    met = materialise(found.join(firsts.hint("merge"), "content").select("passage", "content", "doc_id", "start", "end", "w", "w_end", "left_at", "right_at", length("left").alias("l"), length("right").alias("r"), "removed", "is_first"), "met")
    most = met.groupBy("content").agg(F.max("l").alias("most_l"), F.max("r").alias("most_r"))
    grows = "is_first AND NOT removed"
    sized = met.join(most.hint("merge"), "content").withColumns({"l": F.expr(f"if({grows}, most_l, l)"), "r": F.expr(f"if({grows}, most_r, r)")})
    reach = lambda n, at, own: F.expr(f"if({n} > 0, cast(conv(hex(substring({at}, 4 * {n} - 3, 4)), 16, 10) AS int), {own})")
    return sized.select("passage", "doc_id", reach("l", "left_at", "start").alias("start"), reach("r", "right_at", "end").alias("end"), F.expr("w - l").alias("w"), F.expr("w_end + r").alias("w_end"), "removed")


_STRETCHES = schema(("doc_id", T.LongType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("words", T.IntegerType()), ("removed", T.BooleanType()), ("passages", T.ArrayType(T.LongType(), False)))


def _stretches(spans: DataFrame, min_words: int) -> DataFrame:
    """The spans of a document that touch, as long as all or none are removed, as one;
    those of ``min_words`` or more, with the passages they are of."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        passage, doc, start, end, w, w_end, removed = (t.column(n).to_numpy().astype(np.int64) for n in ("passage", "doc_id", "start", "end", "w", "w_end", "removed"))
        by = np.lexsort((w_end, w, removed, doc))
        passage, doc, start, end, w, w_end, removed = (x[by] for x in (passage, doc, start, end, w, w_end, removed))
        own = _apart(doc, removed)
        first = np.flatnonzero(own | (w > _running_max(w_end, own)))
        island = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
        low, high = w[first], np.maximum.reduceat(w_end, first)
        long = high - low >= min_words
        by = np.lexsort((passage, island))
        passage, island = passage[by], island[by]
        kept = _apart(passage, island) & long[island]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(island[kept], minlength=len(first))[long])).astype(np.int32)), pa.array(passage[kept]))
        values = (np.minimum.reduceat(start, first), np.maximum.reduceat(end, first), high - low)
        return pa.RecordBatch.from_arrays([pa.array(doc[first][long]), *(pa.array(x[long].astype(np.int32)) for x in values), pa.array(removed[first][long].astype(bool)), lists], names=_STRETCHES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_documents(batches):
            yield flush(t)

    return spans.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _STRETCHES)


_SETS = schema(("content", T.LongType()), ("shingles", T.BinaryType()))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(content, shingles) of the wanted (doc_id, content): texts of those documents are read once more."""
    lists = wanted.groupBy(F.col("doc_id").alias("w_id")).agg(F.collect_list("content").alias("contents"))
    slim = docs.select(*pick(docs, doc_id="doc_id", text="text")).where("text IS NOT NULL")
    rows = slim.join(lists, slim.doc_id == lists.w_id).select("text", "contents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1)
            for c in tv.chunks(batch.column(0)):
                p = Paragraphs(c, min_words)
                own = contents.slice(c.first, c.rows)
                asked = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                asked_row = np.repeat(np.arange(c.rows), own.value_lengths().to_numpy(zero_copy_only=False))
                at = np.flatnonzero(np.isin(tv.mix(p.content + p.row.astype(np.uint64)), tv.mix(asked + asked_row.astype(np.uint64))))
                # Half of each hash, in the same order, is enough to compare two sets.
                sets = (p.sets[at] >> np.uint64(32)).astype(np.uint32)
                width = 4 * sets.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(p.content[at].view(np.int64)), pa.Array.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(sets)]).cast(pa.binary())], names=_SETS.names)

    return rows.mapInArrow(run, _SETS).dropDuplicates(["content"])


def _jaccard(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of each set of ``one`` with that of ``other`` beside it (sorted shingles, repeats allowed)."""
    out = np.empty(len(one))
    for a in range(0, len(one), 1 << 12):  # bounds the memory
        x, y = (np.ascontiguousarray(s[a : a + (1 << 12)].T) for s in (one, other))
        new_x, new_y = np.ones(x.shape, bool), np.ones(y.shape, bool)
        np.not_equal(x[1:], x[:-1], out=new_x[1:])
        np.not_equal(y[1:], y[:-1], out=new_y[1:])
        if x.shape[1] < 64:
            common = ((x[:, None] == y).any(1) & new_x).sum(0)
        else:
            common, same = np.zeros(x.shape[1], np.int64), np.empty(x.shape, bool)
            for k in range(len(x)):
                np.equal(y, x[k], out=same)
                common += same.any(0) & new_x[k]
        out[a : a + (1 << 12)] = common / (new_x.sum(0) + new_y.sum(0) - common)
    return out


def _bucket_links(bucket: np.ndarray, owner: np.ndarray, sets: np.ndarray, threshold: float, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, open) of many buckets at once, ``bucket`` ascending: links as places, and places left open.

    Every pair of a bucket is compared unless links found before already join
    it, or both are open: contents that weren't compared with all others when
    ``hot`` had been, and more than ``hot`` were left. In each round every
    bucket compares one content with all that aren't joined yet.

    ``owner`` is the one document a content is of, -1 where it is of several. Two
    contents of one document alone aren't linked: they are alike for overlapping,
    and a chain of such would lead out of what repeats.
    """
    us, vs, still = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    status = np.zeros(len(bucket), np.int8)  # not joined yet, joined but not compared, compared
    idx, done = np.arange(len(bucket)), 0
    while True:
        first = np.flatnonzero(np.diff(bucket[idx], prepend=-1) != 0) if len(idx) else np.zeros(0, np.int64)
        if not len(first):
            break
        size = np.diff(np.append(first, len(idx)))
        free = np.add.reduceat((status[idx] == 0).astype(np.int64), first)
        left = (free > hot) & (done >= hot)
        still.append(idx[np.repeat(left, size)])
        on = (free > 0) & (size > 1) & ~left
        idx, size = idx[np.repeat(on, size)], size[on]
        if not len(idx):
            break
        first = np.cumsum(size) - size
        pick = np.minimum.reduceat(np.where(status[idx] == 1, 0, len(idx)) + np.arange(len(idx)), first) % len(idx)
        x = idx[pick]
        status[x] = 2
        rest = np.flatnonzero(status[idx] == 0)
        hub, rest = np.repeat(x, size)[rest], idx[rest]
        near = (owner[rest] != owner[hub]) | (owner[hub] < 0)
        near[near] = _jaccard(sets[rest[near]], sets[hub[near]]) >= threshold
        us.append(rest[near])
        vs.append(hub[near])
        status[rest[near]] = 1
        idx, done = idx[status[idx] != 2], done + 1
    return np.concatenate(us), np.concatenate(vs), np.concatenate(still)


def _links(threshold: float, hot: int):
    """Over rows sorted by key, then times descending: (key, u, v) for the links of every
    bucket, v null for what stays open. A bucket may span batches; only the last is held."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key, ids, owner = (t.column(n).to_numpy() for n in ("key", "content", "owner"))
        sets = np.frombuffer(b"".join(t.column("shingles").to_pylist()), np.uint32).reshape(len(ids), -1)
        bucket = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        u, v, still = _bucket_links(bucket, owner, sets, threshold, hot)
        keys, us = (pa.array(x[np.concatenate([u, still])]) for x in (key, ids))
        vs = pa.array(np.concatenate([ids[v], np.zeros(len(still), np.int64)]), mask=np.arange(len(u) + len(still)) >= len(u))
        return pa.RecordBatch.from_arrays([keys, us, vs], names=["key", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            new = int(np.searchsorted(key, key[-1]))  # the last bucket stays open
            if held and key[0] != held[-1].column(0)[-1].as_py():
                yield flush(held)
                held = []
            if new:
                yield flush([*held, batch.slice(0, new)])
                held = []
            held.append(batch.slice(new))
        if held:
            yield flush(held)

    return run


@F.arrow_udf(T.ArrayType(T.LongType()))
def _distinct(shingles: pa.Array) -> pa.Array:
    """The distinct shingles of each set (sorted, in bytes)."""
    if not len(shingles):
        return pa.array([], pa.list_(pa.int64()))
    sets = np.frombuffer(b"".join(shingles.to_pylist()), np.uint32).reshape(len(shingles), -1)
    new = np.ones(sets.shape, bool)
    new[:, 1:] = sets[:, 1:] != sets[:, :-1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)), pa.array(sets[new].astype(np.int64)))


def _split(buckets: DataFrame, threshold: float) -> DataFrame:
    """``buckets`` (key, content, times, owner, shingles) as smaller ones, by rare shingles.

    Sets with a Jaccard similarity of t have a share t of either's shingles in
    common, so no pair is lost.
    """
    buckets = materialise(buckets, "open")
    members = buckets.select("key", F.col("content").alias("id"), _distinct("shingles").alias("tokens"))
    keep = F.size("tokens") - F.ceil(F.size("tokens") * threshold - 1e-9).cast("int") + 1
    subs = split_by_rare_tokens(members, keep).select(F.col("key").alias("k"), F.col("id").alias("c"), "sub")
    return buckets.join(subs.hint("merge"), (F.col("key") == F.col("k")) & (F.col("content") == F.col("c"))).select(F.col("sub").alias("key"), "content", "times", "owner", "shingles")


def _left_open(unlike: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``unlike`` (key, content, ...) that ``links`` left open."""
    still = links.where("v IS NULL").select("key", F.col("u").alias("content"))
    return unlike.join(still.hint("merge"), ["key", "content"], "left_semi")


def _linked(buckets: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(key, u, v) of ``_links`` over every bucket, each whole in one partition."""
    return buckets.repartition("key").sortWithinPartitions("key", F.desc("times"), "content").mapInArrow(_links(threshold, hot), "key bigint, u bigint, v bigint")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, words, removed, passages): the repeated stretches of each document.

    Paragraphs that share a band and whose shingle sets have an exact Jaccard
    similarity of ``threshold`` or more are one passage, and so are the
    components of such pairs, but for pairs of one document alone; it repeats if
    it is in two documents at least.
    Each occurrence grows over the words next to it that it has in common with
    the first one of the same paragraph. All occurrences but the first (least
    doc_id, then start) are removed. What touches in a document, removed or not
    as it is, is one stretch; stretches of ``min_words`` or more are reported,
    with their byte offsets in the text's UTF-8. Stretches of different documents
    that are alike have members of ``passages`` in common.

    Bands are tuned for a recall of 0.95 at that similarity; equal paragraphs
    always collide, so any unchanged passage of ``min_words`` is found
    wherever it stands (lines of fewer than WORDS words only whole). Buckets are not capped: equal contents collapse
    first, a content already joined to another needs no further comparison, and
    what is open after many is split by rare shingles.

    The tables written between steps repeat their keys and sets, so their files are a small
    part of what they take in memory; as Spark goes by the files, joins with them are
    merge joins by a hint.

    Null and empty texts, and rows without doc_id, have no passages; a word over
    and over is a passage like any other; repeats inside one document, and rows
    that repeat a doc_id, count as one document; an empty table gives no rows;
    other columns are not looked at.
    """
    bands, rows = tune_bands(threshold)
    # A passage that half the corpus has is one row a batch.
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = []
    for part in range(PARTS):
        packed = contents(docs, bands, rows, range(bands)[part::PARTS], buckets, min_words)
        ready.append(materialise(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met(buckets), _MET), "paragraphs"))
    met = reduce(DataFrame.union, ready)

    known = materialise(met.groupBy("content").agg(F.min(F.when(F.col("several"), F.col("lo"))).alias("doc_id")), "contents")
    wanted = known.where("doc_id IS NOT NULL")
    sets = materialise(_shingle_sets(docs, wanted, min_words), "sets")
    owner = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("owner")
    links = []
    for each in ready:
        unlike = each.where("several").select("key", "content", "times", owner)
        with_sets = lambda some: some.join(sets.hint("merge"), "content").select("key", "content", "times", "owner", "shingles")
        links.append(materialise(_linked(with_sets(unlike), threshold, HOT), "links"))
        if not links[-1].where("v IS NULL").isEmpty():
            # A rare shingle's bucket is compared to its end.
            links.append(materialise(_linked(_split(with_sets(_left_open(unlike, links[-1])), threshold), threshold, 1 << 62), "links"))
    release(sets)
    parts = connected_components(reduce(DataFrame.union, links).where("v IS NOT NULL").select("u", "v"))
    for x in links:
        release(x)

    # The places of the contents that met another document, from a second reading.
    repeated = known.select("content").join(parts.hint("merge"), F.col("content") == F.col("node"), "left").select("content", F.coalesce("component", "content").alias("passage"))
    found = materialise(places(docs, min_words).join(repeated, F.col("c") == F.col("content")).select("passage", "content", "doc_id", "start", "end", "w", "w_end"), "found")
    for x in (*ready, known):
        release(x)
    read, found = found, materialise(_occurrences(found).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_sides, _SIDES), "found")
    release(read)
    grown = _grown(materialise(surroundings(docs, _edges(found), min_words), "places"))
    return _stretches(found.select("passage", "doc_id", "start", "end", "w", "w_end", "removed").union(grown), min_words)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            data, kept, at = text.encode(), [], 0
            for cut in sorted(cuts, key=lambda x: (x["start"], x["end"])):
                kept.append(data[at : max(at, cut["start"])])
                at = max(at, cut["end"])
            text = b"".join([*kept, data[at:]]).decode("utf-8", "replace")
        out.append(text)
    return pa.array(out, pa.string())


def remove_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed stretches of ``repeated_passages`` cut out of ``text``.

    The first document of a passage keeps it. Columns stay as they are, whatever
    their names, but ``n_chars``, where there is one, follows the new text. Null
    texts, and rows without doc_id, stay whole; so do rows that repeat a doc_id
    with another text, as offsets would not say which is meant (rows that repeat
    it with the same text are cut alike). An empty table stays empty.
    """
    text = next((c for c in docs.columns if c.lower() == "text"), None)
    if text is None:
        return docs
    slim = _texts(docs).select("doc_id", F.xxhash64("text").alias("h"))
    unsure = slim.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("doc_id")
    gone = repeated_passages(docs, threshold, min_words).where("removed").join(unsure, "doc_id", "left_anti")
    owner, cuts = fresh(docs, "cut_id"), fresh(docs, "cuts")
    lists = gone.groupBy(F.col("doc_id").alias(owner)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    out = docs.join(materialise(lists, "cuts"), pick(docs, doc_id="doc_id")[0] == F.col(owner), "left")
    # Only rows with something to cut go through Python.
    new = F.when(F.col(cuts).isNull(), F.col(f"`{text}`")).otherwise(_without(F.when(F.col(cuts).isNotNull(), F.col(f"`{text}`")), F.col(cuts)))
    out = out.withColumn(text, new).drop(owner, cuts)
    chars = next((c for c in docs.columns if c.lower() == "n_chars"), None)
    return out.withColumn(chars, F.length(f"`{text}`").cast(docs.schema[chars].dataType)) if chars else out
