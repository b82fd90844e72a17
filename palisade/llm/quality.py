"""Quality rules: an isolation forest over rule statistics.

Path lengths over random splits find anomalous documents; the score from which
a document is rejected is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm import textvec as tv
from palisade.llm.common import fresh, least_hashed, materialise, pick, schema

SEED = 97
TREES = 128
#: Rows a tree is grown on; TREES * SAMPLE bounds what the driver holds for training.
SAMPLE = 256
#: Of the labelled good rows, the share that calibration may reject at most.
MAX_GOOD_LOSS = 0.01
SCORE_BINS = 4000

STATISTICS = ("word_length", "symbols", "capitals", "exclamations", "commas_stops", "repeated_words", "repeated_lines", "symbol_words")
_SYMBOL = tv._table(b"|#*%$&~^<>{}[]\\`")
_BANG, _STOP = tv._table(b"!"), tv._table(b".,")
_NOT_SPACE = 1 - tv.SPACE


def statistics(chunk: tv.Chunk) -> np.ndarray:
    """One row of STATISTICS per document. Every rate is shrunk towards its rest
    value by pseudo-counts, so short texts aren't odd for being short."""
    buf, first = chunk.buf, chunk.offsets
    n = chunk.lengths.astype(float)
    w = tv.words(chunk)
    tokens_at, tokens_end = tv.runs(_NOT_SPACE[buf], chunk.offsets)
    token_first = np.searchsorted(tokens_at, first, "left")
    tokens = np.diff(token_first).astype(float)
    count = w.counts().astype(float)

    def bytes_in(table: np.ndarray) -> np.ndarray:
        return tv.per_row_sum(table[buf], first).astype(float)

    def tokens_with(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(table[buf], out=total[1:])
        return tv.per_row_sum(total[tokens_end] > total[tokens_at], token_first).astype(float)

    letters = bytes_in(tv.UPPER) + bytes_in(tv.LOWER)
    chars = n - bytes_in(tv.CONTINUES)
    shown = chars - bytes_in(tv.SPACE)
    word_bytes = tv.per_row_sum(tv.WORD[buf], first) - bytes_in(tv.CONTINUES)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    line_at, line_end = tv.runs((buf != 10).astype(np.uint8), chunk.offsets)
    line_first = np.searchsorted(line_at, first, "left")
    line_row = np.repeat(np.arange(chunk.rows), np.diff(line_first))
    h = tv.span_hashes(buf, line_at, line_end)
    order = np.lexsort((h, line_row))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line_row[order[1:]] == line_row[order[:-1]])
    repeated = tv.per_row_sum(np.where(again, line_end - line_at, 0), line_first)
    out = np.stack(
        [
            (word_bytes + 20 * 5) / (count + 20),
            bytes_in(_SYMBOL) / (shown + 50),
            (bytes_in(tv.UPPER) + 3) / (letters + 100),
            bytes_in(_BANG) / (tokens + 10),
            (bytes_in(_STOP) + 2) / (tokens + 12),
            tv.per_row_sum(same, w.first) / (count + 10),
            repeated / (n + 600),
            tokens_with(_SYMBOL) / (tokens + 10),
        ],
        axis=1,
    )
    return out


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1 at a leaf), split, children, path length."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    depth: int
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length), in (0, 1]."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t][at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] >= self.split[t][at]
                at = np.where(inner, self.child[t][at] + right, at)
            total += self.length[t][at]
        return np.power(2.0, -total / len(self.feature) / self.norm)


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """An isolation forest: each tree on ``sample`` rows of ``x``, split at random."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    width = 2 ** (depth + 1)
    feature, split = np.full((trees, width), -1, np.int64), np.zeros((trees, width))
    child, length = np.zeros((trees, width), np.int64), np.zeros((trees, width))
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), size, replace=False)], 0)], 1
        while todo:
            node, rows, d = todo.pop()
            low, high = rows.min(0), rows.max(0)
            free = np.flatnonzero(high > low)
            if d >= depth or len(rows) <= 1 or not len(free):
                length[t, node] = d + _average_path(len(rows))
                continue
            f = rng.choice(free)
            cut = rng.uniform(low[f], high[f])
            cut = cut if cut > low[f] else high[f]
            right = rows[:, f] >= cut
            feature[t, node], split[t, node], child[t, node] = f, cut, used
            todo += [(used, rows[~right], d + 1), (used + 1, rows[right], d + 1)]
            used += 2
    return Forest(feature, split, child, length, depth + 1, max(_average_path(size), 1e-9))


_STATS = schema(("doc_id", T.LongType()), ("content", T.LongType()), ("stats", T.ArrayType(T.DoubleType())))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, content, stats) of every row; a null text counts as empty, content is a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                s = statistics(c)
                h = tv.span_hashes(c.buf, c.offsets[:-1], c.offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(c.rows + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(h.view(np.int64)), lists], names=["doc_id", "content", "stats"])

    return docs.select(*pick(docs, doc_id="doc_id", text="text")).mapInArrow(run, _STATS)


def scorer(forest: Forest):
    @F.arrow_udf(T.DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        rows = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), len(STATISTICS))
        return pa.array(forest.scores(rows))

    return score


def fit(stats: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE, max_good_loss: float = MAX_GOOD_LOSS) -> tuple[Forest | None, float]:
    """The forest, and the score from which a document is rejected.

    The forest grows on the ``trees * sample`` rows of least seeded hash (all, if
    there are fewer), over the whole table. The threshold is the one, over all labelled rows, with
    the largest difference between the shares of bad and of good rows at or
    above it, among those that reject at most ``max_good_loss`` of the good
    ones; without labelled good rows, or where no threshold gains, nothing is
    rejected.
    """
    order = F.xxhash64(F.lit(SEED), "doc_id", "content")
    rows = least_hashed(stats, order, trees * sample).select("stats").collect()
    if not rows:
        return None, 2.0
    forest = grow(np.array([r.stats for r in rows]), trees, sample)
    known = labels.select(*pick(labels, doc_id="doc_id", quality="quality")).where("quality IN (0, 1)").distinct()
    binned = stats.join(known, "doc_id").select("quality", F.floor(scorer(forest)("stats") * SCORE_BINS).cast("int").alias("bin"))
    counts = {(r.quality, r.bin): r.n for r in binned.groupBy("quality", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = sum(n for (q, _), n in counts.items() if q == 1)
    if not good:
        return forest, 2.0
    bad = sum(n for (q, _), n in counts.items() if q == 0)
    best, threshold, lost, caught = 0.0, 2.0, 0, 0
    for at in range(SCORE_BINS, -1, -1):
        lost, caught = lost + counts.get((1, at), 0), caught + counts.get((0, at), 0)
        if lost > max_good_loss * good:
            break
        gain = caught / max(1, bad) - lost / good
        if gain > best:
            best, threshold = gain, at / SCORE_BINS
    return forest, threshold


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, anomaly, kept, and each rule statistic) of every row of ``docs``.

    Null and empty texts have the statistics of rest (pseudo-counts alone) and
    are scored like any row; repeated rows are scored alike; rows without
    doc_id are scored but calibrate nothing; labels other than 0 and 1 are left
    out; without labels all are kept; an empty table gives no rows. A row is
    rejected where ``anomaly`` is at or above the calibrated threshold.
    """
    stats = materialise(rule_statistics(docs), "statistics")
    forest, threshold = fit(stats, labels)
    score = scorer(forest)("stats") if forest else F.lit(0.0)
    named = [F.col("stats")[i].alias(n) for i, n in enumerate(STATISTICS)]
    return stats.select("doc_id", F.round(score, 12).alias("anomaly"), *named).withColumn("kept", F.col("anomaly") < threshold)


def drop_anomalous(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``quality_scores`` rejects; columns untouched.

    Statistics are computed again beside the text rather than joined to it: a
    second reading costs less than a shuffle of all texts. Null and empty texts
    are judged as ``quality_scores`` judges them; a score that ties with the
    threshold is rejected; repeated rows go or stay alike; without labels all
    stay; an empty table stays empty;
    other columns, whatever their names, pass through.
    """
    forest, threshold = fit(materialise(rule_statistics(docs), "statistics"), labels)
    if forest is None or threshold > 1:
        return docs

    @F.arrow_udf(T.BooleanType())
    def kept(texts: pa.Array) -> pa.Array:
        out = [forest.scores(statistics(c)) for c in tv.chunks(texts)]
        return pa.array(np.round(np.concatenate(out), 12) < threshold if out else [], pa.bool_())

    text = next((c for c in docs.columns if c.lower() == "text"), None)
    keep = fresh(docs, "keep")
    return docs.withColumn(keep, kept(F.col(f"`{text}`") if text else F.lit(None).cast("string"))).where(keep).drop(keep)
