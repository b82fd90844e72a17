"""Document fingerprints: digests of improbable features in chained Bloom filters.

Each window of WINDOW bytes has an entropy; the rarer its entropy in the corpus,
the better its rank. A window that is the best of many neighbourhoods is a
feature; features fill Bloom filters of FILTER_BITS bits, FEATURES_PER_FILTER to
each, and digests compare by overlap of bits beyond chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm import textvec as tv
from palisade.llm.common import materialise, pick, schema

WINDOW = 64
NEIGHBOURHOOD = 64
#: Neighbourhoods a window must be the best of to be a feature.
POPULARITY = 8
FILTER_BITS, HASHES, FEATURES_PER_FILTER = 2048, 5, 160
#: Features a filter needs to be compared on its own; smaller ones say little, so texts
#: that have no larger one are compared by all their windows.
LEAST_FEATURES = 2
#: Share of the most two texts could have in common at which similarity begins.
CUT = 0.3
#: Entropy classes, of 0 to log2(WINDOW) bits; of the lowest tenth none is a feature.
CLASSES = 1024
LOWEST = CLASSES // 10

_SCALE = 1 << 20
_G = np.array([0, *(round(_SCALE * c * np.log2(c)) for c in range(1, WINDOW + 1))], np.int64)
_CEILING = WINDOW * 6 * _SCALE


def entropy_classes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per byte, the entropy class of the window that starts there, -1 where it
    would pass the row's end.

    A window's sum of c*log2(c) over its byte counts c follows from its
    predecessor's: only the byte that leaves and the one that comes change a
    count, and both counts are sums of 63 byte comparisons. Integers throughout.
    """
    n = len(buf)
    out = np.full(n, -1, np.int32)
    if n < WINDOW:
        return out
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, WINDOW):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    leaving = ahead[: n - WINDOW].astype(np.int64)
    coming = behind[WINDOW:].astype(np.int64)
    # behind counts 63 bytes back, so without the byte that leaves; ahead counts it.
    change = _G[leaving - 1] - _G[leaving] + _G[coming] - _G[coming - 1]
    first = _G[np.bincount(buf[:WINDOW], minlength=256)].sum()
    total = np.concatenate([[0], np.cumsum(change)]) + first
    out[: n - WINDOW + 1] = np.minimum((_CEILING - total) * CLASSES // _CEILING, CLASSES - 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out[np.arange(n) + WINDOW > ends] = -1
    return out


def class_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each class by rarity, from 1 for the rarest that occurs; 0 for classes
    that are never features: the lowest tenth, and those that don't occur."""
    ranks = np.zeros(CLASSES, np.int64)
    usable = np.flatnonzero((counts > 0) & (np.arange(CLASSES) >= LOWEST))
    ranks[usable[np.lexsort((usable, counts[usable]))]] = np.arange(1, len(usable) + 1)
    return ranks


def _slide(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def select(buf: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the features: windows that are the best-ranked (leftmost of equals) of
    at least POPULARITY neighbourhoods, or of all of them in rows that have fewer."""
    n = len(buf)
    classes = entropy_classes(buf, offsets)
    rank = np.where(classes >= 0, ranks[classes], 0)
    usable = rank > 0
    if not usable.any():
        return np.zeros(0, np.int64)
    never = np.int64(1) << 62
    key = np.where(usable, rank * (1 << 40) + np.arange(n), never)
    # Neighbourhoods lie within the windows of one row; a row with fewer windows has one, of all.
    windows = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    popular = np.zeros(n, np.int64)
    if n >= NEIGHBOURHOOD:
        best = _slide(key, NEIGHBOURHOOD)
        inside = classes[: n - NEIGHBOURHOOD + 1] >= 0
        inside &= classes[NEIGHBOURHOOD - 1 :] >= 0
        row = np.repeat(np.arange(len(windows)), np.diff(offsets))
        inside &= row[: n - NEIGHBOURHOOD + 1] == row[NEIGHBOURHOOD - 1 :]
        best = best[inside & (best < never)]
        popular = np.bincount(best & ((1 << 40) - 1), minlength=n)
    chosen = popular >= POPULARITY
    for r in np.flatnonzero((windows > 0) & (windows < NEIGHBOURHOOD + POPULARITY - 1)):
        span = key[offsets[r] : offsets[r] + windows[r]]
        at = int(np.argmin(span))
        if span[at] < never:
            chosen[offsets[r] + at] = True
    return np.flatnonzero(chosen)


def digests(c: tv.Chunk, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(filters, features per filter, row of each filter, hash of each feature): filters are
    rows of bits, packed; features are in order of row, FEATURES_PER_FILTER to a filter."""
    at = select(c.buf, c.offsets, ranks)
    row = np.searchsorted(c.offsets, at, "right") - 1
    first = np.searchsorted(row, np.arange(c.rows + 1), "left")
    nth = np.arange(len(at)) - first[row]
    per_row = -(-np.diff(first) // FEATURES_PER_FILTER)
    start = np.concatenate([[0], np.cumsum(per_row)])
    which = start[row] + nth // FEATURES_PER_FILTER
    bits = np.zeros((int(start[-1]), FILTER_BITS), bool)
    h = tv.span_hashes(c.buf, at, at + WINDOW) if len(at) else np.zeros(0, np.uint64)
    if len(at):
        for i in range(HASHES):
            bits[which, (h >> np.uint64(11 * i)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return np.packbits(bits, axis=1), np.bincount(which, minlength=int(start[-1])), np.repeat(np.arange(c.rows), per_row), h


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def overlap_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised bit overlap, 0 to 1, of each filter of ``a`` with that of ``b`` beside it (packed).

    Common bits beyond those two filters of their fill share by chance, over
    the most they could share; at or under the cut-off, 0. The cut-off is 0.3 of
    that range, or three standard deviations over chance where that is more.
    """
    common, nx, ny = (_ONES[f].sum(-1).astype(np.float64) for f in (a & b, a, b))
    most = np.minimum(nx, ny)
    chance = nx * ny / FILTER_BITS
    deviation = np.sqrt(chance * (1 - nx / FILTER_BITS) * (1 - ny / FILTER_BITS))
    cut = chance + np.maximum(CUT * (most - chance), 3 * deviation)
    return np.where(most > cut, np.clip((common - cut) / np.maximum(most - cut, 1e-6), 0, 1), 0.0)


def compare(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Similarity of two digests: the mean, over the comparable filters of the one
    with fewer filters, of each one's best score in the other; 0 without any."""
    if len(b) < len(a):
        a, na, b, nb = b, nb, a, na
    mine, other = na >= LEAST_FEATURES, nb >= LEAST_FEATURES
    if not mine.any() or not other.any():
        return 0.0
    return float(overlap_scores(a[mine][:, None], b[other][None]).max(1).mean())


def windows(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of each row, in order."""
    n = np.maximum(c.lengths - WINDOW + 1, 0)
    row = np.repeat(np.arange(c.rows), n)
    at = np.arange(len(row)) + np.repeat(c.offsets[:-1] - (np.cumsum(n) - n), n)
    return tv.span_hashes(c.buf, at, at + WINDOW), row


class Index:
    """The distinct hashes of each reference item, looked up by hash."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, items: int) -> None:
        hashes, item = _distinct(hashes, item)
        self.counts = np.bincount(item, minlength=items)
        self.hashes, self.first = np.unique(hashes, return_index=True)
        self.first, self.item = np.append(self.first, len(item)), item.astype(np.int32)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def pairs(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, common hashes) of every row and item that have one in common, in order."""
        maybe = np.flatnonzero(self.bitmap[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        k = np.searchsorted(self.hashes, h[maybe])
        hit = self.hashes[np.minimum(k, len(self.hashes) - 1)] == h[maybe] if len(self.hashes) else np.zeros(0, bool)
        hash_no, hit_row = _distinct(k[hit], row[maybe[hit]])
        n = self.first[hash_no + 1] - self.first[hash_no]
        item = self.item[np.arange(n.sum()) + np.repeat(self.first[hash_no] - (np.cumsum(n) - n), n)].astype(np.int64)
        pair, common = np.unique(np.repeat(hit_row, n) * max(1, len(self.counts)) + item, return_counts=True)
        return pair // max(1, len(self.counts)), pair % max(1, len(self.counts)), common

    def matches(self, c: tv.Chunk, small_rows: np.ndarray, small_items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an index of windows, (row, item, similarity over 0) of pairs of which one is
        small: the share, beyond CUT, that their common windows are of those of the one
        that has fewer."""
        h, row = windows(c)
        r, i, common = self.pairs(h, row)
        wanted = small_rows[r] | small_items[i]
        r, i, common = r[wanted], i[wanted], common[wanted]
        some = np.isin(row, r)
        own = np.bincount(_distinct(h[some], row[some])[1], minlength=c.rows)
        score = (common / np.maximum(np.minimum(own[r], self.counts[i]), 1) - CUT) / (1 - CUT)
        return r[score > 0], i[score > 0], score[score > 0]


def _distinct(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of value and group, by value."""
    order = np.lexsort((group, value))
    value, group = value[order], group[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
    return value[new], group[new]


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of the whole corpus fall in each entropy class."""
    kind = schema(("class", T.IntegerType()), ("n", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for c in tv.chunks(batch.column(0), 1 << 18):
                k = entropy_classes(c.buf, c.offsets)
                total += np.bincount(k[k >= 0], minlength=CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=kind.names)

    out = np.zeros(CLASSES, np.int64)
    for r in docs.select(*pick(docs, text="text")).mapInArrow(run, kind).groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r.n
    return out


_PART = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())]))
_DIGEST = schema(("doc_id", T.LongType()), ("n_features", T.IntegerType()), ("n_filters", T.IntegerType()), ("digest", T.BinaryType()), ("item_id", T.LongType()), ("similarity", T.DoubleType()), ("matches", _PART))
_SCORED = T.StructType([*_DIGEST.fields, T.StructField("content", T.LongType())])

#: Reference items, and bytes of their texts, whose digests, features and windows (12 bytes
#: a window) are sent to every task at a time; a larger set is gone through in parts.
REFERENCE_ROWS, REFERENCE_BYTES = 50_000, 1 << 24


@dataclass
class Reference:
    """Reference items by id: filters of LEAST_FEATURES features or more, and indexes of features and windows."""

    ids: np.ndarray
    first: np.ndarray  # per item, its first filter; one more entry at the end
    filters: np.ndarray
    features: Index
    windows: Index

    @property
    def small(self) -> np.ndarray:
        return np.diff(self.first) == 0

    @classmethod
    def of(cls, rows: list[tuple[int, str]], ranks: np.ndarray) -> Reference:
        rows = sorted(rows)
        each = list(tv.chunks(pa.array([t for _, t in rows], pa.string())))
        filters, feature, window, owners, items = [np.zeros((0, FILTER_BITS // 8), np.uint8)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for c in each:
            packed, count, row, h = digests(c, ranks)
            usable = count >= LEAST_FEATURES
            filters.append(packed[usable])
            owners.append(row[usable] + c.first)
            feature.append(h)
            items[0].append(np.repeat(row, count) + c.first)
            spots, spot_row = windows(c)
            window.append(spots)
            items[1].append(spot_row + c.first)
        owner = np.concatenate(owners)
        first = np.searchsorted(owner, np.arange(len(rows) + 1))
        indexes = [Index(np.concatenate(h), np.concatenate(i), len(rows)) for h, i in zip((feature, window), items)]
        return cls(np.array([i for i, _ in rows], np.int64), first, np.concatenate(filters), *indexes)

    def matches(self, c: tv.Chunk, packed: np.ndarray, count: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, similarity over 0) of the documents of a chunk, given its digests:
        pairs with a feature in common as ``compare`` has them, small ones by windows."""
        mine = np.flatnonzero(count >= LEAST_FEATURES)
        my_first = np.searchsorted(row[mine], np.arange(c.rows + 1))
        found = [self.windows.matches(c, np.diff(my_first) == 0, self.small)]
        r, i, _ = self.features.pairs(h, np.repeat(row, count))
        n, m = np.diff(my_first)[r], np.diff(self.first)[i]
        r, i, n, m = (x[(n > 0) & (m > 0)] for x in (r, i, n, m))
        for a in range(0, len(r), 4096):
            found.append(self._compared(packed[mine], my_first, *(x[a : a + 4096] for x in (r, i, n, m))))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _compared(self, packed: np.ndarray, my_first: np.ndarray, r: np.ndarray, i: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # All filters of the one with each of the other, pair after pair: the one with fewer leads.
        lead = n <= m
        outer, inner = np.where(lead, n, m), np.where(lead, m, n)
        size = outer * inner
        pair = np.repeat(np.arange(len(r)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        o, k = at // inner[pair], at % inner[pair]
        own = my_first[r[pair]] + np.where(lead[pair], o, k)
        other = self.first[i[pair]] + np.where(lead[pair], k, o)
        score = np.concatenate([overlap_scores(packed[own[a : a + 8192]], self.filters[other[a : a + 8192]]) for a in range(0, len(own), 8192)])
        best = np.maximum.reduceat(score, np.flatnonzero(k == 0))
        whole = np.add.reduceat(best, np.cumsum(outer) - outer) / outer
        some = whole > 0
        return r[some], i[some], whole[some]


def _parts(known: DataFrame | None) -> Iterator[list[tuple[int, str]]]:
    """The reference rows, as many at a time as REFERENCE_ROWS and REFERENCE_BYTES allow; once without any."""
    if known is None:
        yield []
        return
    rows = known.select(*pick(known, item_id="item_id", text="text")).select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    rows = materialise(rows, "reference")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-2 * n // REFERENCE_ROWS), -(-2 * size // REFERENCE_BYTES)) if n > REFERENCE_ROWS or size > REFERENCE_BYTES else 1
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else rows
        yield [(r.item_id, r.text) for r in own.collect()]


def _scored(docs: DataFrame, ranks: np.ndarray, known: Reference) -> DataFrame:
    """One pass over the documents: digests, and matches with the reference items held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(1), 1 << 18):
                packed, count, row, h = digests(c, ranks)
                n_filters = np.bincount(row, minlength=c.rows)
                n_features = np.bincount(row, count, c.rows).astype(np.int32) if len(row) else np.zeros(c.rows, np.int32)
                at, item, score = known.matches(c, packed, count, row, h)
                score = np.round(score, 6)
                order = np.lexsort((item, -score, at))
                at, item, score = at[order], item[order], score[order]
                n = np.bincount(at, minlength=c.rows)
                first = np.cumsum(n) - n
                none = n == 0
                best = np.minimum(first, max(0, len(at) - 1))
                best_id = pa.array(known.ids[item[best]] if len(at) else np.zeros(c.rows, np.int64), mask=none)
                value = np.where(none, 0.0, score[best]) if len(at) else np.zeros(c.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(known.ids[item] if len(at) else item), pa.array(score)], names=["item_id", "similarity"]))
                offsets = np.concatenate([[0], np.cumsum(n_filters)]) * (FILTER_BITS // 8)
                digest = pa.Array.from_buffers(pa.binary(), c.rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(n_features), pa.array(n_filters.astype(np.int32)), digest, best_id, pa.array(value), lists, pa.array(tv.span_hashes(c.buf, c.offsets[:-1], c.offsets[1:]).view(np.int64))], names=_SCORED.names)

    return docs.select(*pick(docs, doc_id="doc_id", text="text")).mapInArrow(run, _SCORED)


def fingerprints(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_features, n_filters, digest, item_id, similarity, matches) of every row.

    ``digest`` is the row's chain of 256-byte filters. ``known`` (item_id, text)
    is a reference set whose digests every document with a feature in common is
    compared with; ``matches`` are all items of any similarity, the most similar
    (then the least id) first, and ``item_id`` and ``similarity`` those of the
    first one, null and 0 where there is none. A text without a filter of
    LEAST_FEATURES features (about 64 to 230 bytes) says too little by its
    digest: it is compared by the windows it has in common with the other.

    What goes to every task is bounded by REFERENCE_ROWS and REFERENCE_BYTES: a
    larger reference set is gone through in parts, a pass over the documents
    each, and the matches of all parts are put together by row.

    Null and short texts (under 64 bytes) have no features, an empty digest and
    similarity 0; repeated rows are equal; rows without doc_id keep a null one;
    an item that is null, or has no id, matches nothing, and one that repeats an
    id with another text is another item of that id; an empty table gives no
    rows; other columns are not looked at.
    """
    ranks = class_ranks(entropy_counts(docs))
    parts = [_scored(docs, ranks, Reference.of(rows, ranks)) for rows in _parts(known)]
    if len(parts) == 1:
        return parts[0].drop("content")
    # Digests are the same in each pass; the matches of all come together by doc_id and content.
    found = reduce(DataFrame.union, [x.select(F.col("doc_id").alias("d"), F.col("content").alias("k"), "matches").where("size(matches) > 0") for x in parts])
    better = lambda x, y: F.when(x["similarity"] > y["similarity"], -1).when(x["similarity"] < y["similarity"], 1).when(x["item_id"] < y["item_id"], -1).when(x["item_id"] > y["item_id"], 1).otherwise(0)
    whole = materialise(found, "matches").groupBy("d", "k").agg(F.array_sort(F.flatten(F.collect_set("matches")), better).alias("found"))
    base = _scored(docs, ranks, Reference.of([], ranks)).select("doc_id", "n_features", "n_filters", "digest", "content")
    joined = base.join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("k")), "left").withColumn("best", F.get("found", F.lit(0)))
    return joined.select("doc_id", "n_features", "n_filters", "digest", F.col("best.item_id").alias("item_id"), F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"), F.coalesce("found", F.array().cast(_PART)).alias("matches"))
