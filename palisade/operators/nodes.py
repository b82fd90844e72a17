"""The node table: one row per node, in pre-order, and its column form.

``subtree_end`` is the exclusive end of a node's subtree in pre-order, so
descendants are a range of node_id and no recursion is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.core import markup
from palisade.functions.udfs import AST, NODE, parse_markup

FIELDS = [f.name for f in NODE.fields]


def ast_literal(tree: list) -> Column:
    """An AST column of a constant forest of (kind, name, value, children)."""
    nodes = markup.rebuild(tree)
    rows = [F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip((i, n.parent if n.parent >= 0 else None, n.ordinal, n.depth, n.end, n.kind, n.name, n.value), NODE.fields)]) for i, n in enumerate(nodes)]
    return F.array(*rows).cast(AST)


def _leaf(kind: str, name: Column | None = None, value: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), F.lit(1).alias("subtree_end"), F.lit(kind).alias("kind"), (null if name is None else name).alias("name"), (null if value is None else value).alias("value"))).cast(AST)


def new_text(value: Column) -> Column:
    return _leaf(markup.TEXT, value=value)


def new_raw_text(value: Column) -> Column:
    return _leaf(markup.RAW, value=value)


def new_reference(name: Column) -> Column:
    return _leaf(markup.REF, name=name)


def new_comment(value: Column) -> Column:
    return _leaf(markup.COMMENT, value=value)


def _shift(ast: Column, by: Column, parent: Column, depth: Column, content: Column, attrs: Column) -> Column:
    """``ast`` moved ``by`` places, its top level under ``parent`` and numbered on
    from ``content`` and ``attrs`` siblings.

    The amounts come zipped to the nodes: an inner lambda that named a variable
    of an outer one would keep Python UDFs above it from being planned.
    """
    amounts = F.struct(by.alias("by"), parent.alias("parent"), depth.alias("depth"), content.alias("content"), attrs.alias("attrs"))
    return F.zip_with(
        ast,
        F.array_repeat(amounts, F.size(ast)),
        lambda n, k: F.struct(
            (n["node_id"] + k["by"]).alias("node_id"),
            F.coalesce(n["parent_id"] + k["by"], k["parent"]).alias("parent_id"),
            (n["ordinal"] + F.when(n["parent_id"].isNotNull(), 0).when(n["kind"] == "attr", k["attrs"]).otherwise(k["content"])).alias("ordinal"),
            (n["depth"] + k["depth"]).alias("depth"),
            (n["subtree_end"] + k["by"]).alias("subtree_end"),
            n["kind"].alias("kind"),
            n["name"].alias("name"),
            n["value"].alias("value"),
        ),
    ).cast(AST)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def concat_asts(*parts: Column) -> Column:
    """Forests next to each other. Attributes and content are numbered apart."""
    if not parts:
        return F.array().cast(AST)
    if len(parts) == 1:
        return parts[0].cast(AST)

    def tops(ast: Column, attrs: bool) -> Column:
        return F.size(F.filter(ast, lambda n: n["parent_id"].isNull() & ((n["kind"] == "attr") if attrs else (n["kind"] != "attr"))))

    def join(forests: Column) -> Column:
        sizes = F.transform(forests, lambda f: F.struct(F.size(f).alias("by"), tops(f, False).alias("content"), tops(f, True).alias("attrs")))

        def shifted(all_sizes: Column) -> Column:
            before = [F.lit(0)] * 3
            amounts = []
            for i in range(len(parts)):
                amounts.append(F.struct(*[b.alias(n) for b, n in zip(before, ("by", "content", "attrs"))]))
                before = [b + all_sizes[i][n] for b, n in zip(before, ("by", "content", "attrs"))]
            return F.array(*amounts)

        moves = _once(sizes, shifted)
        none = F.lit(None).cast("int")
        return F.flatten(F.zip_with(forests, moves, lambda f, k: _shift(f, k["by"], none, F.lit(0), k["content"], k["attrs"])))

    return _once(F.array(*[p.cast(AST) for p in parts]), join).cast(AST)


def _parent(kind: str, name: Column, children: Column) -> Column:
    def build(kids: Column) -> Column:
        head = F.struct(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), (F.size(kids) + 1).alias("subtree_end"), F.lit(kind).alias("kind"), name.alias("name"), F.lit(None).cast("string").alias("value"))
        return F.concat(F.array(head).cast(AST), _shift(kids, F.lit(1), F.lit(0), F.lit(1), F.lit(0), F.lit(0)))

    return _once(children, build)


def new_attribute(name: Column, value: Column) -> Column:
    """An attribute whose value is the AST ``value`` (texts and references)."""
    return _parent(markup.ATTR, name, value)


def new_element(name: Column, *parts: Column) -> Column:
    """An element; leading attributes of ``parts`` are its attributes, the rest its content."""
    return _parent(markup.ELEMENT, name, concat_asts(*parts))


def explode_nodes(df: DataFrame, ast: str = "ast", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Node table of an AST column: one row per node beside the ``keep`` columns."""
    # Not plain inline: Spark would infer a filter from it and parse once more, before any exchange, to evaluate it.
    return df.select(*keep, F.inline_outer(F.col(ast))).where("node_id IS NOT NULL OR kind IS NOT NULL")


def collect_nodes(nodes: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """AST column of a node table, one row per document (documents without nodes have no row)."""
    return nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).cast(AST).alias("ast"))


def markup_nodes(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Node table of documents; documents that don't parse give no rows."""
    return explode_nodes(df.select(*keep, parse_markup(F.col(content))["ast"].alias("ast")), keep=keep)


def same_ast(a: Column, b: Column) -> Column:
    """Deep, ordered equality; text and raw text differ. Null-safe."""
    return a.eqNullSafe(b)


def diff_nodes(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Nodes that only one of two node tables has, or that one has more often, with ``side``.

    One signed count over both: each is read once, and nearly all rows being distinct,
    they are shuffled as they are and counted behind it, where a task has a share of them."""
    columns = [*by, *FIELDS]
    both = a.select(*columns, F.lit(1).alias("sign")).unionAll(b.select(*columns, F.lit(-1).alias("sign")))
    n = both.repartition(*columns).groupBy(*columns).agg(F.sum("sign").alias("n")).where("n <> 0")
    times = F.explode(F.array_repeat(F.when(F.col("n") > 0, "a").otherwise("b"), F.abs("n").cast("int")))
    return n.select(*columns, times.alias("side"))


def events(nodes: DataFrame, comments: bool = True, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The parser's events of a node table, with their order ``seq`` in the document:
    start and end of elements and attributes, texts, raw texts, references and, unless
    left out, comments. A node's end comes at the last place of its subtree, deeper
    ones first; places follow from the table itself, without a shuffle."""

    def event(kind: Column, seq: list[Column], name: Column, value: Column) -> Column:
        return F.struct(F.struct(*[c.cast("int").alias(n) for n, c in zip(("at", "phase", "inner"), seq)]).alias("seq"), kind.alias("event"), name.alias("name"), value.alias("value"))

    holds = F.col("kind").isin(markup.ELEMENT, markup.ATTR)
    begin = event(F.when(holds, F.concat(F.lit("start "), "kind")).otherwise(F.col("kind")), [F.col("node_id"), F.lit(0), F.lit(0)], F.col("name"), F.col("value"))
    end = event(F.concat(F.lit("end "), "kind"), [F.col("subtree_end") - 1, F.lit(1), -F.col("depth")], F.col("name"), F.lit(None).cast("string"))
    kept = nodes if comments else nodes.where(F.col("kind") != markup.COMMENT)
    return kept.select(*by, F.inline(F.when(holds, F.array(begin, end)).otherwise(F.array(begin))))


def write_fault(ast: Column) -> Column:
    """Why no markup, HTML or XML stands for an AST: its first node of no known kind, or
    attribute that is not an element's. Null where there is none."""
    kinds = [markup.TEXT, markup.RAW, markup.REF, markup.ELEMENT, markup.ATTR, markup.COMMENT]
    parent = lambda n: F.get(ast, n["parent_id"])["kind"]
    bad = F.filter(ast, lambda n: ~F.coalesce(n["kind"].isin(kinds), F.lit(False)) | ((n["kind"] == markup.ATTR) & ~parent(n).eqNullSafe(F.lit(markup.ELEMENT))))
    return F.when(F.size(bad) > 0, F.concat(F.coalesce(bad[0]["kind"], F.lit("nothing")), F.lit(" out of place")))


def children(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent, child ids ...): parent-child pairs by equi-join."""
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"))
    return nodes.where("parent_id IS NOT NULL").join(up, ["doc_id", "parent_id"])


def descendants(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, ancestor, node): each node's range of places. Of ``whole`` documents, as they are
    parsed, every place is a node, and no join is needed; else those left are found by an equi-join."""
    start, stop = F.col("node_id") + 1, F.col("subtree_end") - 1
    pairs = nodes.where(start <= stop).select("doc_id", F.col("node_id").alias("ancestor"), F.explode(F.sequence(start, stop)).alias("node"))
    return pairs if whole else pairs.join(nodes.select("doc_id", F.col("node_id").alias("node")), ["doc_id", "node"]).select("doc_id", "ancestor", "node")
