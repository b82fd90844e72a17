"""MinHash near-duplicate grouping.

128 universal-hash minima over word 3-shingles, 32 bands of 4, verification of
colliding signatures and connected components by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palisade.llm import textvec as tv
from palisade.llm.buckets import split_by_rare_tokens
from palisade.llm.common import fresh, materialise, pick, schema
from palisade.llm.components import connected_components

SHINGLE = 3
FUNCTIONS = 128
BANDS = 32
THRESHOLD = 0.5
SEED = 20250601
#: Nodes not settled by their bucket's hub from which the bucket is split by rare minima.
HOT = 1_000

_SIGNATURE = schema(("doc_id", T.LongType()), ("sig_hash", T.LongType()), ("signature", T.BinaryType()), ("bands", T.ArrayType(T.LongType())))


def signatures(docs: DataFrame, functions: int = FUNCTIONS, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig_hash, signature, bands) of every row with a doc_id and a word."""
    a, b = tv.universal(functions, SEED)
    rows = functions // bands
    salt = tv.seeds(bands, SEED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tv.chunks(batch.column(1)):
                h, first = tv.shingles(tv.words(c), shingle)
                sig = tv.minima(h, first, a, b)
                some = np.flatnonzero(np.diff(first) > 0)
                sig = sig[some]
                key = np.repeat(salt[None, :], len(sig), 0)
                parts = sig.reshape(len(sig), bands, rows)
                for i in range(rows):
                    key = tv.mix(key + parts[:, :, i].astype(np.uint64))
                whole = np.zeros(len(sig), np.uint64)
                for i in range(bands):
                    whole = tv.mix(whole + key[:, i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.rows).take(pa.array(some)),
                        pa.array(whole.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(4 * functions), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "sig_hash", "signature", "bands"],
                )

    slim = docs.select(*pick(docs, doc_id="doc_id", text="text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInArrow(run, _SIGNATURE)


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal minima of two signatures: the Jaccard estimate."""
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pa.array((x == y).mean(1))


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose signatures agree in at least ``threshold``."""
    left = nodes.select(F.col("node").alias("u"), F.col("signature").alias("su"))
    right = nodes.select(F.col("node").alias("v"), F.col("signature").alias("sv"))
    return pairs.join(left, "u").join(right, "v").where(agreement("su", "sv") >= threshold).select("u", "v")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _minima(signatures: pa.Array) -> pa.Array:
    """One hash for each minimum of a signature and its place."""
    if not len(signatures):
        return pa.array([], pa.list_(pa.int64()))
    m = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(len(signatures), -1).astype(np.uint64)
    h = tv.mix(m + (np.arange(m.shape[1], dtype=np.uint64) << np.uint64(32))[None, :]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(h.ravel()))


def _split(open_: DataFrame, mates: DataFrame, signed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``open_`` and ``mates`` (key, node) with the buckets of HOT open nodes or more in smaller
    ones. Signatures that agree in a share t of their n minima have t*n in common, so each
    pair shares one of either's n - t*n + 1 rarest."""
    hot = materialise(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).select("key"), "hot")
    if hot.isEmpty():
        return open_, mates
    members = mates.join(hot, "key", "left_semi").join(signed, "node").select("key", F.col("node").alias("id"), _minima("signature").alias("tokens"))
    subs = materialise(split_by_rare_tokens(members, F.lit(FUNCTIONS - ceil(threshold * FUNCTIONS) + 1)), "subs")
    own = open_.join(subs.withColumnRenamed("id", "node"), ["key", "node"]).select(F.col("sub").alias("key"), "node")
    return open_.join(hot, "key", "left_anti").union(own), mates.join(hot, "key", "left_anti").union(subs.select(F.col("sub").alias("key"), F.col("id").alias("node")))


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, kept) for every distinct doc_id of ``docs``.

    Documents are in one group when a chain of pairs joins them, each pair
    sharing a band and agreeing in ``threshold`` of its 128 minima. ``group_id``
    is the least doc_id of the group, and that document is the one kept.

    Every pair of every bucket is decided: equal signatures collapse to one
    node; a bucket's nodes are compared with its hub (the node met in most
    buckets); pairs not settled by a common component are then compared one by
    one, in buckets with HOT open nodes or more only those that have minima in
    common which few there have: enough for all pairs that could agree in
    ``threshold``. No bucket is capped or skipped.

    Rows without doc_id give no row here (``drop_near_duplicates`` keeps them).
    Null texts and texts without a letter or digit resemble nothing and stay.
    Rows that repeat a doc_id count as one document. A text of one or two words
    is one shingle. No rows give no rows; other columns are not looked at.
    """
    sigs = materialise(signatures(docs), "signatures")
    slim = sigs.select("doc_id", "sig_hash")
    reps = slim.groupBy("sig_hash").agg(F.min("doc_id").alias("node"))
    same = slim.join(reps, "sig_hash").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    nodes = sigs.join(reps, (sigs.sig_hash == reps.sig_hash) & (sigs.doc_id == reps.node)).select("node", "signature", "bands")

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    w = Window.partitionBy("key")
    met = keyed.select("key", "node", F.min("node").over(w).alias("lo"), F.max("node").over(w).alias("hi"), F.count("node").over(w).alias("n"))
    met = materialise(met.where("lo < hi").select("key", "node", "n"), "buckets")
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    met = met.join(degree, "node")
    hubs = met.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    spokes = met.join(hubs, "key").select("key", "node", "hub")
    star = spokes.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    signed = nodes.select("node", "signature")
    good = materialise(_verified(star, signed, threshold), "stars")
    found = connected_components(same.union(good))

    # What the stars leave open: nodes not verified against their bucket's hub, against
    # every bucket mate of another component.
    open_ = spokes.where("node <> hub").join(good, (F.col("node") == good.u) & (F.col("hub") == good.v), "left_anti").select("key", "node")
    open_, mates = _split(materialise(open_, "open"), met.select("key", "node"), signed, threshold)
    part = F.coalesce("component", "node")
    placed = mates.join(found, "node", "left").select("key", F.col("node").alias("v"), part.alias("cv"))
    loose = open_.join(found, "node", "left").select("key", F.col("node").alias("u"), part.alias("cu"))
    rest = loose.join(placed, "key").where("u <> v AND cu <> cv").join(hubs, "key", "left").where("hub IS NULL OR v <> hub")
    rest = rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = materialise(_verified(rest, signed, threshold), "rest")
    if not more.isEmpty():
        found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    ids = docs.select(*pick(docs, doc_id="doc_id")).where("doc_id IS NOT NULL").distinct()
    groups = ids.join(found, ids.doc_id == found.node, "left")
    group = F.coalesce("component", "doc_id")
    return groups.select("doc_id", group.alias("group_id"), (group == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose group keeps another one.

    Columns are untouched, whatever their names. Rows without doc_id stay. Of
    rows that repeat a doc_id one stays: the first by all columns, in their order.
    """
    key = pick(docs, doc_id="doc_id")[0]
    other, nth = fresh(docs, "other_id"), fresh(docs, "nth")
    gone = near_duplicate_groups(docs, threshold).where("NOT kept").select(F.col("doc_id").alias(other))
    stay = docs.join(gone, key == F.col(other), "left_anti")
    # Whether a doc_id recurs is asked of the ids alone: the texts aren't needed for it.
    ids = docs.select(key).where("doc_id IS NOT NULL")
    repeated = materialise(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(other)), "repeats")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, key == F.col(other), "left_anti")
    several = stay.join(repeated, key == F.col(other), "left_semi")
    order = Window.partitionBy(key).orderBy(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
    first = several.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(first)
