"""Arrow UDFs over whole batches of documents: scanning, parsing, writing.

Texts are taken as bytes, so offsets are byte offsets. Nulls give nulls.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.core import brackets, entities, markup

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("subtree_end", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
AST = T.ArrayType(NODE)
ERROR = T.StructType([T.StructField("msg", T.StringType()), T.StructField("ofs", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])
PARSED = T.StructType([T.StructField("ast", AST), T.StructField("error", ERROR)])
PAIR = T.StructType([T.StructField("open_ofs", T.LongType()), T.StructField("close_ofs", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("depth", T.IntegerType())])

_PA_NODE = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("subtree_end", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string())])
_PA_ERROR = pa.struct([("msg", pa.string()), ("ofs", pa.int64()), ("line", pa.int32()), ("col", pa.int32())])
_PA_PAIR = pa.struct([("open_ofs", pa.int64()), ("close_ofs", pa.int64()), ("kind", pa.string()), ("depth", pa.int32())])


def _values(column: pa.Array) -> Iterable[bytes | None]:
    """Each value's bytes, of a string or binary column."""
    for x in column.to_pylist():
        yield x.encode() if isinstance(x, str) else x


def _map(column: pa.Array, f, kind: pa.DataType) -> pa.Array:
    return pa.array([None if x is None else f(x) for x in _values(column)], kind)


@F.arrow_udf(T.ArrayType(T.LongType()))
def unmatched_offsets(data: pa.Array) -> pa.Array:
    """Sorted byte offsets of unmatched brackets; empty for balanced text."""
    return _map(data, brackets.unmatched, pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def unmatched_mask(data: pa.Array) -> pa.Array:
    """As many bytes, all zero but the unmatched brackets."""
    return _map(data, brackets.mask, pa.binary())


@F.arrow_udf(T.BooleanType())
def is_balanced(data: pa.Array) -> pa.Array:
    """Whether all brackets match."""
    return _map(data, lambda x: not brackets.unmatched(x), pa.bool_())


@F.arrow_udf(T.LongType())
def embedding_count(data: pa.Array) -> pa.Array:
    """Matched pairs."""
    return _map(data, brackets.embeddings, pa.int64())


@F.arrow_udf(ERROR)
def bracket_error(data: pa.Array) -> pa.Array:
    """Where strict reading stops and why; null for balanced text."""

    def first(x: bytes) -> dict | None:
        _, error = brackets.scan(x)
        if error is None:
            return None
        line, column = brackets.position(x, error[1])
        return {"msg": error[0], "ofs": error[1], "line": line, "col": column}

    return _map(data, first, _PA_ERROR)


@F.arrow_udf(T.ArrayType(PAIR))
def matcher_pairs(data: pa.Array) -> pa.Array:
    """Matched pairs of strict reading, in order of opening, with depth from 0."""

    def pairs(x: bytes) -> list[dict]:
        return [{"open_ofs": o, "close_ofs": c, "kind": chr(x[o]) + chr(x[c]), "depth": d} for o, c, d in brackets.scan(x)[0]]

    return _map(data, pairs, pa.list_(_PA_PAIR))


@F.arrow_udf(T.IntegerType())
def deepest(data: pa.Array) -> pa.Array:
    """The greatest depth of texts read side by side, of each one's ``brackets.steps``."""
    return pa.array([None if x is None else brackets.deepest(brackets.side_by_side(x)) for x in data.to_pylist()], pa.int32())


def ast_array(forests: list[list[markup.Node] | None]) -> pa.Array:
    """Flat forests as a column of arrays of node structs."""
    flat = [n for f in forests if f for n in f]
    offsets, at = [], 0
    for f in forests:
        offsets.append(at if f is not None else None)
        at += len(f or ())
    ids = [i for f in forests if f for i in range(len(f))]
    fields = [
        pa.array(ids, pa.int32()),
        pa.array([n.parent if n.parent >= 0 else None for n in flat], pa.int32()),
        pa.array([n.ordinal for n in flat], pa.int32()),
        pa.array([n.depth for n in flat], pa.int32()),
        pa.array([n.end for n in flat], pa.int32()),
        pa.array([n.kind for n in flat], pa.string()),
        pa.array([n.name for n in flat], pa.string()),
        pa.array([n.value for n in flat], pa.string()),
    ]
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_PA_NODE)))


def forests(column: pa.Array) -> list[list[markup.Node] | None]:
    """Flat forests of a column of arrays of node structs, read field by field."""
    flat = column.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten()))
    numbers = (fields[n].fill_null(-1).to_numpy(zero_copy_only=False).tolist() for n in ("parent_id", "depth", "subtree_end", "ordinal"))
    nodes = list(map(markup.Node, *(_shared(fields[n]) for n in ("kind", "name")), fields["value"].to_pylist(), *numbers))
    out, at = [], 0
    for size in column.value_lengths().to_pylist():
        out.append(None if size is None else nodes[at : at + size])
        at += size or 0
    return out


def _shared(column: pa.Array) -> list[str | None]:
    """The strings of a column of few distinct ones, each made once."""
    coded = column.dictionary_encode()
    words = [*coded.dictionary.to_pylist(), None]
    return [words[i] for i in coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]


def _parse(data: pa.Array, elements: bool) -> pa.Array:
    trees, errors = [], []
    for x in _values(data):
        tree = error = None
        if x is not None:
            try:
                tree = markup.parse(x, elements)
            except markup.MarkupError as e:
                error = {"msg": e.message, "ofs": e.offset, "line": e.line, "col": e.column}
        trees.append(tree)
        errors.append(error)
    return pa.StructArray.from_arrays([ast_array(trees), pa.array(errors, _PA_ERROR)], names=["ast", "error"], mask=data.is_null())


@F.arrow_udf(PARSED)
def parse_markup(data: pa.Array) -> pa.Array:
    """STRUCT(ast, error): the nodes of a document, or the first fault; one of them is null."""
    return _parse(data, True)


@F.arrow_udf(PARSED)
def parse_text(data: pa.Array) -> pa.Array:
    """The same for text without elements: texts and references only, as in attribute values."""
    return _parse(data, False)


def _rewrite(step):
    @F.arrow_udf(AST)
    def rewrite(ast: pa.Array) -> pa.Array:
        return ast_array([None if f is None else step(f) for f in forests(ast)])

    return rewrite


ast_decode_entities = _rewrite(markup.decode_entities)
ast_direct_quotes = _rewrite(markup.direct_quotes)
ast_escape_decimal = _rewrite(markup.escape_brackets)
ast_escape_symbolic = _rewrite(lambda f: markup.escape_brackets(f, entities.SYMBOLIC_ESCAPES))


@F.arrow_udf(T.StringType())
def to_markup(ast: pa.Array) -> pa.Array:
    """The markup of an AST; what comes next depends on the byte written last, so
    this is the one writer that no aggregate can express. An AST that no markup
    can stand for (see ``nodes.write_fault``) gives null."""

    def write(f: list[markup.Node]) -> str | None:
        try:
            return markup.write_markup(f)
        except markup.UnwritableError:
            return None

    return pa.array([None if f is None else write(f) for f in forests(ast)], pa.string())


CONVERTED = T.StructType([T.StructField("html", T.StringType()), T.StructField("error", ERROR)])


@F.arrow_udf(CONVERTED)
def markup_to_html(data: pa.Array) -> pa.Array:
    """STRUCT(html, error): parse, decode, direct quotes and write, in one crossing."""
    pages, errors = [], []
    for x in _values(data):
        page = error = None
        if x is not None:
            try:
                page = markup.convert(x)
            except markup.MarkupError as e:
                error = {"msg": e.message, "ofs": e.offset, "line": e.line, "col": e.column}
        pages.append(page)
        errors.append(error)
    return pa.StructArray.from_arrays([pa.array(pages, pa.string()), pa.array(errors, _PA_ERROR)], names=["html", "error"], mask=data.is_null())


@F.udtf(returnType=NODE)
class MarkupNodes:
    """SQL table function: ``SELECT ... FROM docs, LATERAL markup_nodes(content)``."""

    def eval(self, content):  # noqa: ANN001, ANN201
        if content is None:
            return
        try:
            nodes = markup.parse(content.encode() if isinstance(content, str) else bytes(content))
        except markup.MarkupError:
            return
        for i, n in enumerate(nodes):
            yield i, n.parent if n.parent >= 0 else None, n.ordinal, n.depth, n.end, n.kind, n.name, n.value


def register(spark) -> None:  # noqa: ANN001
    """Make the functions callable from SQL."""
    for name in ("unmatched_offsets", "unmatched_mask", "is_balanced", "embedding_count", "bracket_error", "matcher_pairs", "parse_markup", "parse_text", "ast_decode_entities", "ast_direct_quotes", "ast_escape_decimal", "ast_escape_symbolic", "to_markup", "markup_to_html"):
        spark.udf.register(name, globals()[name])
    spark.udtf.register("markup_nodes", MarkupNodes)
