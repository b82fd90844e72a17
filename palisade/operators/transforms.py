"""Rewrites of documents: entities, quotes, bracket escapes.

Each works on DataFrames with an ``ast`` column, to be chained with
``df.transform``; ``decode_node_entities`` is the relational form for node tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.core import entities
from palisade.functions import udfs

Transformer = Callable[[DataFrame], DataFrame]


def html_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(entities.HTML.items()), "name string, text string")


def symbolic_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(entities.SYMBOLIC.items()), "name string, text string")


def _on_ast(step) -> Transformer:
    return lambda df: df.withColumn("ast", step(F.col("ast")))


#: Known references become text, except in attribute values.
decode_entities: Transformer = _on_ast(udfs.ast_decode_entities)
#: Quote elements become directed quotation marks around their content.
direct_quotes: Transformer = _on_ast(udfs.ast_direct_quotes)


def escape_matchers(symbolic: bool = False) -> Transformer:
    """Unmatched brackets of each list of siblings become references."""
    return _on_ast(udfs.ast_escape_symbolic if symbolic else udfs.ast_escape_decimal)


def with_transformers(df: DataFrame, *steps: Transformer) -> DataFrame:
    return reduce(lambda d, step: d.transform(step), steps, df)


def decode_node_entities(nodes: DataFrame) -> DataFrame:
    """Entity decoding on the node table: a broadcast join with the fixed table of
    2,217 names. Nodes inside an attribute's range are left alone."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(sorted(entities.ALL.items()), "ref string, decoded string")
    before = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_value = F.coalesce(F.max(F.when(F.col("kind") == "attr", F.col("subtree_end"))).over(before) > F.col("node_id"), F.lit(False))
    known = nodes.withColumn("in_value", in_value).join(F.broadcast(names), (F.col("kind") == "ref") & (F.col("name") == F.col("ref")) & ~F.col("in_value"), "left")
    hit = F.col("decoded").isNotNull()
    changed = {"kind": F.when(hit, "text").otherwise(F.col("kind")), "name": F.when(~hit, F.col("name")), "value": F.coalesce("decoded", "value")}
    return known.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in nodes.columns])
