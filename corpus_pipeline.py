"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Stages work on all that their predecessor
kept, written as Parquet between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import linededup, mixing, neardup, pieces, quality
from palisade.llm.common import documents, materialise, release, table


def reject_anomalous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules reject go.

    Null and empty texts are judged like any other; repeated rows go alike; an
    empty table, or one without labels, stays as it is; other columns, whatever
    their names, pass through, here and in the stages after.
    """
    return quality.drop_anomalous(docs, table(spark, sf_dir, "labels"))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites are cut from the texts.

    No row goes: null texts stay null, and a document of nothing but such lines
    stays whole for the next stage to settle. Repeated rows are cut alike; an
    empty table stays empty.
    """
    return linededup.remove_spread_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least doc_id.

    Rows without doc_id, null texts and texts without a word stay; of rows that
    repeat a doc_id one stays; an empty table stays empty.
    """
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per chosen copy of a document, so that sources reach their weights.

    Null columns are no membership, and a document of no source is not chosen;
    null and blank texts have no tokens and go where they fall; an empty table
    stays empty.
    """
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the text decoded from them.

    A null text has null ids; an empty one has none; an empty table gives no
    rows; the new columns get a leading underscore where their names are taken.
    """
    return pieces.encode_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", reject_anomalous),
    ("line dedup", cut_boilerplate),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The forest, the flow and the encoding have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over ``documents``. Nulls, empty texts, repeated
    rows, empty tables and extra columns are as each stage says."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
