"""Proportional stratified interleaving into shards of equal mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import fresh, materialise

SHARDS = 64
SEED = 7
#: Rows of one stratum that one window partition may hold before its key space is split further.
ROWS_PER_BUCKET = 20_000
#: Strata up to which a row's position is counted from the strata's sizes alone.
MAX_STRATA = 2_000


def _column(docs: DataFrame, name: str, kind: str) -> F.Column:
    match = next((c for c in docs.columns if c.lower() == name), None)
    return (F.col(f"`{match}`") if match else F.lit(None)).cast(kind)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET, max_strata: int = MAX_STRATA) -> DataFrame:
    """``docs`` with ``shard`` and ``position``.

    Rows of each source are shuffled by a seeded hash of doc_id and ranked; row r
    of n has fractional rank (2r-1)/2n. ``position`` is the row's place, from 0,
    in the order of fractional rank, then source, and shard k of S holds the
    positions p with floor(p*S/N) = k, so any shard has any source's share of
    the whole to within one row.

    The ranking window is split into hash ranges, offset by exact counts, so a
    hot source is never one task's work. Places need no global sort: with n
    rows in a stratum, the rows before a given fraction are a division. Past
    ``max_strata`` sources the places come from a second ranking instead.

    A null source is the stratum ''. Null doc_ids hash alike; ties go by doc_id,
    then text, and rows equal in these are interchangeable. Fewer rows than
    shards leave shards empty; an empty table gives no rows. Columns named
    shard or position are kept and the new ones get a leading underscore.
    """
    stratum, key, part, before_, size, r, strata_, f_, piece, start, count = (fresh(docs, n) for n in ("stratum", "key", "part", "before", "size", "r", "strata", "fraction", "piece", "start", "n"))
    shard, position = fresh(docs, "shard"), fresh(docs, "position")
    ident = _column(docs, "doc_id", "bigint")
    keyed = docs.withColumns({stratum: F.coalesce(_column(docs, "source", "string"), F.lit("")), key: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))})
    fine = materialise(keyed.groupBy(stratum, F.substring(key, 1, 3).alias(part)).agg(F.count(F.lit(1)).alias(count)), "counts")
    by_stratum = fine.groupBy(stratum).agg(F.sum(count).alias(count))
    n_strata, total, largest = by_stratum.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(1))).first()
    sizes = [(x[0], x[1]) for x in by_stratum.orderBy(stratum).collect()] if n_strata <= max_strata else []
    number = "decimal(38,0)" if largest > 1_500_000_000 else "bigint"
    digits = 0
    while largest / 16**digits > rows_per_bucket:
        digits += 1
    if digits > 3:
        fine = keyed.groupBy(stratum, F.substring(key, 1, digits).alias(part)).agg(F.count(F.lit(1)).alias(count))
    by = Window.partitionBy(stratum).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = fine.groupBy(stratum, F.substring(part, 1, digits).alias(part)).agg(F.sum(count).alias(count))
    offsets = counts.select(stratum, part, F.coalesce(F.sum(count).over(by), F.lit(0)).alias(before_), F.sum(count).over(Window.partitionBy(stratum)).cast(number).alias(size))

    order = [F.col(key), ident, _column(docs, "text", "string")]
    rank = F.col(before_) + F.row_number().over(Window.partitionBy(stratum, part).orderBy(*order))
    ranked = keyed.withColumn(part, F.substring(key, 1, digits)).join(offsets, [stratum, part]).withColumn(r, rank)
    if n_strata <= max_strata:
        strata = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).cast(number).alias("n")) for s, n in sizes]) if sizes else F.expr("cast(array() AS array<struct<s:string,n:bigint>>)")
        ranked = ranked.withColumn(strata_, strata)
        before = F.expr(f"aggregate({strata_}, 0L, (a, t) -> a + ((2 * {r} - 1) * t.n + {size} - IF(t.s < {stratum}, 0, 1)) div (2 * {size}))")
        placed = ranked.withColumn(position, before)
    else:
        fraction = (2 * F.col(r) - 1) / (2 * F.col(size))
        pieces = max(1, total // rows_per_bucket)
        ranked = materialise(ranked.withColumns({f_: fraction, piece: F.floor(fraction * pieces)}), "ranked")
        span = Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
        starts = ranked.groupBy(piece).agg(F.count(F.lit(1)).alias(count)).select(piece, F.coalesce(F.sum(count).over(span), F.lit(0)).alias(start))
        within = F.row_number().over(Window.partitionBy(piece).orderBy(f_, stratum, r))
        placed = ranked.join(starts, piece).withColumn(position, F.col(start) + within - 1)
    out = placed.withColumn(shard, F.floor(F.col(position) * shards / F.lit(max(1, total))).cast("int") if total * shards < 1 << 53 else F.expr(f"cast(cast({position} AS decimal(38,0)) * {shards} div {total} AS int)"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], shard, position)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the interleaved rows, one folder per shard, in order of position.

    Rows are placed as ``interleave`` says for nulls, ties and repeated rows; an
    empty table writes an empty folder; ``path`` must not exist. The new columns
    are the last two whatever the table's own names, and the folders are named
    after the first of them.
    """
    placed = interleave(docs, shards, seed)
    shard, position = placed.columns[-2:]
    placed.repartitionByRange(shards, shard).sortWithinPartitions(shard, position).write.partitionBy(shard).parquet(path)


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    return f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, text) AS r,
    count(*) OVER (PARTITION BY coalesce(source, '')) AS n, count(*) OVER () AS total FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, coalesce(source, ''), r) - 1 AS position FROM ranked
)
SELECT doc_id, text, lang, source, n_chars, CAST(position * {shards} // total AS INTEGER) AS shard, position FROM placed"""
