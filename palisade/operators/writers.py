"""HTML and XML from AST columns, inside the JVM.

Writing tags is an ordered concatenation: every node gives an opening piece at
its own place and, for elements and attributes, a closing piece at the last
place of its subtree, deeper ones first. All look-ups are by index into the
array, so a document costs O(n log n) and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import native
from palisade.operators.nodes import collect_nodes


def _write(ast: Column, xml: bool) -> Column:
    def pieces(n: Column) -> Column:
        kind, name, value, place, stop = (n[f] for f in ("kind", "name", "value", "node_id", "subtree_end"))
        parent = F.get(ast, n["parent_id"])
        in_attr = F.coalesce(parent["kind"] == "attr", F.lit(False))
        after = F.get(ast, stop)
        last_attr = F.coalesce((after["kind"] != "attr") | (after["parent_id"] != n["parent_id"]), F.lit(True)) | after.isNull()
        child = F.get(ast, place + 1)
        has_attrs = F.coalesce((child["kind"] == "attr") & (child["parent_id"] == place), F.lit(False))
        final = F.get(ast, stop - 1)
        holder = F.get(ast, final["parent_id"])
        only_attrs = F.coalesce((final["kind"] == "attr") & (final["parent_id"] == place), F.lit(False)) | F.coalesce((holder["kind"] == "attr") & (holder["parent_id"] == place), F.lit(False))
        closes = F.lit(True) if xml else native.is_void(name)
        own_end = ((stop == place + 1) | only_attrs) & closes
        parent_end = (stop == parent["subtree_end"]) & (F.lit(True) if xml else native.is_void(parent["name"]))
        plain = F.when(in_attr, native.xml_escape(value, native.ESC_IN_QUOT)).otherwise(native.xml_escape(value))
        opening = (
            F.when(kind == "text", plain)
            .when(kind == "rawtext", F.when(in_attr, plain).otherwise(native.xml_cdata(value) if xml else plain))
            .when(kind == "ref", native.tag_reference(name))
            .when(kind == "comment", native.tag_comment(value))
            .when(kind == "attr", F.concat(F.lit(" "), name, F.lit('="')))
            .otherwise(F.concat(F.lit("<"), name, F.when(has_attrs, "").when(own_end, "/>").otherwise(">")))
        )
        closing = F.when(kind == "attr", F.concat(F.lit('"'), F.when(~last_attr, "").when(parent_end, "/>").otherwise(">"))).when((kind == "element") & ~own_end, F.concat(F.lit("</"), name, F.lit(">"))).otherwise("")

        def piece(pos: Column, phase: int, key: Column, text: Column) -> Column:
            return F.struct(pos.alias("pos"), F.lit(phase).alias("phase"), key.alias("key"), text.alias("text"))

        return F.array(piece(place, 0, F.lit(0), opening), piece(stop - 1, 1, -n["depth"], closing))

    ordered = F.array_sort(F.flatten(F.transform(ast, pieces)))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), "")


def to_html(ast: Column) -> Column:
    """HTML text of an AST; null for a null AST, empty for an empty one.

    The expression names ``ast`` many times: pass a column, not a long
    expression, so that it is computed once."""
    return _write(ast, xml=False)


def to_xml(ast: Column) -> Column:
    return _write(ast, xml=True)


def nodes_to_html(nodes: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """HTML per document of a node table."""
    return collect_nodes(nodes, by).select(*by, to_html(F.col("ast")).alias("html"))


def nodes_to_xml(nodes: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return collect_nodes(nodes, by).select(*by, to_xml(F.col("ast")).alias("xml"))
