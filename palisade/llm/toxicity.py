"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features are densities of lexicons (a list of insults in four languages, and
word stems mined from labels), their nearness to second-person words, capitals,
punctuation and obfuscation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm import boosting
from palisade.llm import textvec as tv
from palisade.llm.common import least_hashed, materialise, pick, release, schema

#: Labelled documents the trees are fitted on, at most: those of least seeded hash. Stems
#: are mined, and probabilities calibrated, over all.
TRAIN_ROWS = 20_000
#: One in so many labelled documents calibrates and isn't trained on.
HELD_OUT = 5
#: Probability from which a document counts as toxic.
CUT = 0.5
#: Evidence (2 * toxic documents * log of their over-representation) a mined stem needs, and over-representation itself.
EVIDENCE, LIFT = 16.0, 8.0
#: Toxic documents a stem must be in: in fewer it is chance.
LEAST_DOCS = 3
#: Mined stems (8 bytes each) up to which they go to every task; more raise an error rather than lose any.
MAX_STEMS = 4_000_000
#: Labels up to which they are broadcast (16 bytes each) rather than joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Margins are told apart to so many parts of one in calibration.
MARGIN_PARTS = 1_000
STEMS = (3, 4, 5, 6, 7)  # characters of a stem; 0 stands for the whole word
NEAR = 5
SEED = 515

INSULTS = "idiot idiots moron morons stupid pathetic worthless disgusting trash scum loser losers clown dumb imbecile ugly filthy garbage vermin parasite freak creep jerk bastard bitch crap shit fuck fucking asshole retard slut whore con connard connasse salope abruti abrutie crétin imbécile débile ordure idiota idiotas estúpido estúpida imbécil imbéciles basura cabrón cerdo asqueroso asquerosa dumm dummkopf trottel depp vollidiot abschaum arschloch schlampe widerlich".split()
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie ihnen usted ustedes vosotros tú ti".split()
FEATURES = ("mined_density", "mined_count", "insult_density", "insult_count", "near_you", "capitals", "exclamations", "questions", "punctuation", "mixed_words", "broken_words", "long_runs", "word_length", "words")

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _LEET[_a] = _b
_GLUE = tv._table(b"@$!*")
_BANG, _ASK, _PUNCT = tv._table(b"!"), tv._table(b"?"), tv._table(b".,;:!?-\"'")


def _known(texts: list[str]) -> np.ndarray:
    data = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(d) for d in data])
    return np.unique(tv.span_hashes(tv.fold_case(buf), ends - [len(d) for d in data], ends))


class Lexicon:
    """Membership of hashes, by a bitmap and then a search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes.astype(np.uint64))
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __contains__(self, h: object) -> bool:
        return bool(self.hits(np.array([h], np.uint64))[0])

    def hits(self, h: np.ndarray) -> np.ndarray:
        out = self.bitmap[(h & np.uint64(0xFFFF)).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.searchsorted(self.sorted, h[some])
            out[some] = self.sorted[np.minimum(at, len(self.sorted) - 1)] == h[some]
        return out


INSULT, SECOND = Lexicon(_known(INSULTS)), Lexicon(_known(YOU))


def stem_hashes(c: tv.Chunk, w: tv.Words) -> list[np.ndarray]:
    """Per stem length, a hash per word (whole words last); shorter words get that of no stem, 0."""
    hasher = tv.SpanHasher(tv.fold_case(c.buf))
    begins = np.flatnonzero(1 - tv.CONTINUES[c.buf])
    ordinal = np.searchsorted(begins, w.start)
    begins = np.concatenate([begins, np.full(max(STEMS) + 1, len(c.buf) + 1)])
    out = []
    for k in STEMS:
        end = begins[ordinal + k]
        whole = end <= w.end
        h = hasher(w.start, np.where(whole, end, w.start))
        out.append(np.where(whole, tv.mix(h + np.uint64(k)), np.uint64(0)))
    return [*out, tv.mix(w.hash)]


def features(c: tv.Chunk, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per document; texts without words are all rest values."""
    w = tv.words(c)
    count = w.counts().astype(float)
    mined = np.zeros(len(w.hash), bool)
    if len(lexicon.sorted):
        for h in stem_hashes(c, w):
            mined |= lexicon.hits(h)
    # Insults as they are, and as read with digits and signs put back to letters.
    glued_at, glued_end = tv.runs(tv.WORD[c.buf] | _GLUE[c.buf], c.offsets)
    glued_first = np.searchsorted(glued_at, c.offsets, "left")
    plain = tv.span_hashes(tv.fold_case(_LEET[c.buf]), glued_at, glued_end)
    hidden = INSULT.hits(plain)
    insult = INSULT.hits(w.hash)
    hostile = insult | mined
    you = np.flatnonzero(SECOND.hits(w.hash))
    at = np.flatnonzero(hostile)
    near = np.zeros(len(w.hash), bool)
    if len(you) and len(at):
        i = np.searchsorted(you, at)
        for side in (np.maximum(i - 1, 0), np.minimum(i, len(you) - 1)):
            near[at] |= (np.abs(you[side] - at) <= NEAR) & (w.row[you[side]] == w.row[at])

    def per(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        return tv.per_row_sum(flags, first).astype(float)

    def total(table: np.ndarray) -> np.ndarray:
        t = np.zeros(len(c.buf) + 1, np.int64)
        np.cumsum(table[c.buf], out=t[1:])
        return t

    digit, letter, glue = total(tv.DIGIT), total(tv.UPPER | tv.LOWER), total(_GLUE)
    mixed = (digit[w.end] > digit[w.start]) & (letter[w.end] > letter[w.start])
    broken = (glue[glued_end - 1] > glue[np.minimum(glued_at + 1, glued_end - 1)]) & (letter[glued_end] > letter[glued_at])
    same = np.zeros(len(c.buf), bool)
    if len(c.buf) > 2:
        same[2:] = (c.buf[2:] == c.buf[1:-1]) & (c.buf[1:-1] == c.buf[:-2]) & ((tv.UPPER | tv.LOWER)[c.buf[2:]] > 0)
    bytes_of = lambda table: per(table[c.buf], c.offsets)
    letters = bytes_of(tv.UPPER | tv.LOWER)
    insults = per(hidden, glued_first) + np.maximum(per(insult, w.first) - per(hidden, glued_first), 0)
    mines = per(mined, w.first)
    return np.stack(
        [
            mines / (count + 5),
            np.log1p(mines),
            insults / (count + 5),
            np.log1p(insults),
            per(near, w.first) / (count + 5),
            bytes_of(tv.UPPER) / (letters + 50),
            bytes_of(_BANG) / (count + 5),
            bytes_of(_ASK) / (count + 5),
            bytes_of(_PUNCT) / (count + 5),
            per(mixed, w.first) / (count + 5),
            per(broken, glued_first) / (count + 5),
            per(same, c.offsets) / (count + 5),
            (bytes_of(tv.WORD) - bytes_of(tv.CONTINUES) + 25) / (count + 5),
            np.log1p(count),
        ],
        axis=1,
    )


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return boosting.calibrated(self.knots, self.trees.margins(x))


_COUNTS = schema(("h", T.LongType()), *((n, T.LongType()) for n in ("clean0", "clean1", "toxic0", "toxic1")))


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stem hash, the clean and toxic documents of each fold it is in."""
    for batch in batches:
        toxic, fold = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2))
        for c in tv.chunks(batch.column(0)):
            w = tv.words(c)
            h = np.concatenate(stem_hashes(c, w))
            row = np.tile(w.row, len(STEMS) + 1)
            # A stem counts once a document: distinct pairs by one hash of both.
            _, once = np.unique(tv.mix(h + tv.mix(row.astype(np.uint64))), return_index=True)
            h, group = h[once], (toxic * 2 + fold)[row[once] + c.first]
            order = np.argsort(h)
            h, group = h[order], group[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            counts = [pa.array(np.add.reduceat((group == g).astype(np.int64), new) if len(new) else new) for g in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), *counts], names=_COUNTS.names)


def _mined(sums: DataFrame, sizes: dict[tuple[int, int], int]) -> list[Lexicon]:
    """Stems over-represented in toxic documents, by evidence: of fold 1, of fold 0, of both."""
    passes = []
    for folds in ((1,), (0,), (0, 1)):
        toxic_n, clean_n = (float(sum(sizes.get((t, f), 0) for f in folds)) for t in (1, 0))
        t, n = (sum((F.col(f"{kind}{f}") for f in folds), F.lit(0.0)) for kind in ("toxic", "clean"))
        expected = (t + n) * toxic_n / max(1.0, toxic_n + clean_n)
        lift = ((t + 0.1) / (toxic_n + 1)) / ((n + 0.1) / (clean_n + 1))
        evidence = 2 * t * F.log(F.greatest(t, F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9)))
        passes.append((evidence >= EVIDENCE) & (lift >= LIFT))
    some = sums.where(f"toxic0 + toxic1 >= {LEAST_DOCS}").select("h", *[p.alias(f"in{i}") for i, p in enumerate(passes)]).where("in0 OR in1 OR in2")
    rows = some.limit(MAX_STEMS + 1).collect()
    if len(rows) > MAX_STEMS:
        raise ValueError(f"more than {MAX_STEMS} stems: ask for more evidence")
    return [Lexicon(np.array([r.h for r in rows if r[1 + i]], np.int64).view(np.uint64)) for i in range(3)]


_ROWS = schema(("place", T.LongType()), ("content", T.LongType()), ("toxic", T.LongType()), ("x", T.ArrayType(T.DoubleType())))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon, trees and calibration from labelled rows.

    Stems are mined from all labelled documents but those held out, and
    calibration is on all of these; only the trees are fitted on a bounded
    sample, of at most ``train_rows`` documents. Stems for a row's training
    features are mined in the other fold, so the trees learn how far to trust
    them; the model then has the stems of both.
    """
    known = labels.select(*pick(labels, doc_id="doc_id", toxic="toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    held = F.pmod(F.shiftright(order, 8), F.lit(HELD_OUT)) == 0
    known = materialise(known.select(F.col("doc_id").alias("k"), "toxic", order.alias("place"), F.pmod(order, F.lit(2)).cast("bigint").alias("fold"), held.alias("held")), "known")
    texts = docs.select(*pick(docs, doc_id="doc_id", text="text")).where("text IS NOT NULL")
    few = known.count() <= BROADCAST_ROWS
    labelled = materialise(texts.join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("k")).select("text", "toxic", "fold", "place", "held"), "labelled")
    mined = labelled.where("NOT held")
    sizes = {(r.toxic, r.fold): r["count"] for r in mined.groupBy("toxic", "fold").count().collect()}
    sums = mined.select("text", "toxic", "fold").mapInArrow(_count_stems, _COUNTS).groupBy("h").agg(*[F.sum(c).alias(c) for c in _COUNTS.names[1:]])
    lexicons = _mined(sums, sizes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                fold = batch.column(2).slice(c.first, c.rows).to_numpy()
                each = [features(c, lx) for lx in lexicons[:2]]
                x = np.where((fold == 0)[:, None], *each)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(c.rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                content = tv.span_hashes(c.buf, c.offsets[:-1], c.offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(c.first, c.rows), pa.array(content.view(np.int64)), batch.column(1).slice(c.first, c.rows), lists], names=_ROWS.names)

    bound = least_hashed(known.where("NOT held").select("place"), F.col("place"), train_rows).agg(F.max("place")).first()[0]
    # Rows that repeat a document are one to learn from.
    sample = mined.where(F.col("place") <= F.lit(bound).cast("bigint")).mapInArrow(rows, _ROWS)
    got = sample.groupBy("place", "content", "toxic").agg(F.first("x").alias("x")).select("toxic", "x").collect()
    got.sort(key=lambda r: (r.toxic, r.x))
    x, y = np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.toxic for r in got], float)
    trees = boosting.fit(x, y)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                m = np.round(trees.margins(features(c, lexicons[2])) * MARGIN_PARTS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m), batch.column(1).slice(c.first, c.rows)], names=["margin", "toxic"])

    binned = labelled.where("held").mapInArrow(margins, "margin bigint, toxic bigint").groupBy("margin").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).orderBy("margin").collect()
    release(labelled)
    m, n, t = (np.array([r[i] for r in binned], float) for i in range(3))
    knots = boosting.isotonic(m / MARGIN_PARTS, t / np.maximum(n, 1), n) if t.sum() else (np.zeros(0), np.zeros(0))
    return Model(lexicons[2], trees, knots)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, probability, toxic, and each feature) of every row of ``docs``.

    The trees are fitted on at most ``train_rows`` labelled documents; stems and
    calibration come from all; scoring is one pass over whole texts. A null text scores as an empty one, which has
    every feature at rest; repeated rows score alike; rows without doc_id are
    scored and never trained on; labels other than 0 and 1 are left out, of
    several for one document the highest counts; without labels nothing is
    known and the probability is low everywhere; an empty table gives no rows;
    other columns are not looked at.
    """
    model = fit(docs, labels, train_rows)
    out = schema(("doc_id", T.LongType()), ("probability", T.DoubleType()), ("toxic", T.BooleanType()), *((f, T.DoubleType()) for f in FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                x = features(c, model.lexicon)
                p = np.round(model.probability(x), 9)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(p), pa.array(p >= CUT), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=out.names)

    return docs.select(*pick(docs, doc_id="doc_id", text="text")).mapInArrow(run, out)
