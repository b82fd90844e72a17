from pathlib import Path

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palisade.core import brackets, markup
from palisade.functions import native, udfs
from palisade.operators import nodes, transforms, writers
from palisade.plans import queries
from palisade.sources import files
from palisade.streaming import live
from tests import vectors as v

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def texts(spark, values):
    return spark.createDataFrame([(i, s) for i, s in enumerate(values)], "doc_id bigint, content string")


def asts(spark, forests):
    kind = "doc_id bigint, ast array<struct<node_id:int,parent_id:int,ordinal:int,depth:int,subtree_end:int,kind:string,name:string,value:string>>"
    rows = []
    for i, f in enumerate(forests):
        flat = markup.rebuild(f)
        rows.append((i, [(j, n.parent if n.parent >= 0 else None, n.ordinal, n.depth, n.end, n.kind, n.name, n.value) for j, n in enumerate(flat)]))
    return spark.createDataFrame(rows, kind)


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_scan_functions(spark):
    values = [*v.UNMATCHED, None]
    df = texts(spark, values).select("doc_id", *[f(F.col("content")).alias(n) for n, f in (("u", udfs.unmatched_offsets), ("ok", udfs.is_balanced), ("m", udfs.unmatched_mask), ("e", udfs.embedding_count))])
    assert column(df, "u") == [*v.UNMATCHED.values(), None]
    assert column(df, "ok") == [not x for x in v.UNMATCHED.values()] + [None]
    for s, m in zip(values[:-1], column(df, "m")[:-1]):
        assert [i for i, b in enumerate(m) if b] == v.UNMATCHED[s]
    assert column(df, "e")[-1] is None


def test_pairs_errors_and_positions(spark):
    df = texts(spark, ["a(b[c])", "é(\n]", None]).select("doc_id", udfs.matcher_pairs(F.col("content")).alias("p"), native.error_text(udfs.bracket_error(F.col("content"))).alias("e"))
    assert [[tuple(x) for x in r] if r else r for r in column(df, "p")] == [[(1, 6, "()", 0), (3, 5, "[]", 1)], [], None]
    assert column(df, "e") == [None, "2:1 opener ( closed with mismatched ]", None]
    at = texts(spark, ["é\nab"]).select("doc_id", native.byte_position(F.encode("content", "UTF-8"), F.lit(4)).alias("p"))
    assert tuple(column(at, "p")[0]) == (4, 2, 2)


@pytest.mark.parametrize("name,table", [("html", v.HTML), ("xml", v.XML)])
def test_native_writers(spark, name, table):
    df = asts(spark, [f for f, _ in table])
    write = writers.to_html if name == "html" else writers.to_xml
    assert column(df.select("doc_id", write(F.col("ast")).alias("out")), "out") == [x for _, x in table]
    by_node = writers.nodes_to_html if name == "html" else writers.nodes_to_xml
    full = {i: x for i, (f, x) in enumerate(table) if f}
    assert {r.doc_id: r[name] for r in by_node(nodes.explode_nodes(df)).collect()} == full


def test_parse_write_and_rewrite(spark):
    df = texts(spark, [s for s, _ in v.PARSE] + v.FAILS)
    parsed = df.select("doc_id", udfs.parse_markup(F.col("content")).alias("p")).select("doc_id", "p.*")
    want = asts(spark, [f for _, f in v.PARSE])
    assert column(parsed, "ast") == column(want, "ast") + [None] * len(v.FAILS)
    assert [e is None for e in column(parsed, "error")] == [True] * len(v.PARSE) + [False] * len(v.FAILS)
    written = asts(spark, [f for f, _ in v.MARKUP]).select("doc_id", udfs.to_markup(F.col("ast")).alias("m"))
    assert column(written, "m") == [x for _, x in v.MARKUP]
    done = texts(spark, [s for s, _ in v.TRANSFORMED]).select("doc_id", udfs.parse_markup(F.col("content"))["ast"].alias("ast"))
    done = transforms.with_transformers(done, transforms.decode_entities, transforms.direct_quotes)
    assert column(done, "ast") == column(asts(spark, [f for _, f in v.TRANSFORMED]), "ast")
    escaped = asts(spark, [f for f, _ in v.ESCAPED]).transform(transforms.escape_matchers())
    assert column(escaped, "ast") == column(asts(spark, [f for _, f in v.ESCAPED]), "ast")


def test_node_entities_leave_attribute_values(spark):
    df = texts(spark, ["p{a=[[amp]]}[[amp][zz]]"])
    flat = transforms.decode_node_entities(nodes.markup_nodes(df))
    assert [(r.kind, r.name, r.value) for r in flat.orderBy("node_id").collect()] == [("element", "p", None), ("attr", "a", None), ("ref", "amp", None), ("text", None, "&"), ("ref", "zz", None)]
    assert transforms.html_entities(spark).count() == 2125 and transforms.symbolic_entities(spark).count() == 92


def test_constructors_and_table_function(spark):
    ast = nodes.new_element(F.lit("p"), nodes.new_attribute(F.lit("a"), nodes.new_text(F.lit("x"))), nodes.new_reference(F.lit("amp")), nodes.new_comment(F.lit("c")), nodes.new_raw_text(F.lit("r")))
    want = v.el("p", v.attr("a", v.t("x")), v.ref("amp"), v.com("c"), v.raw("r"))
    got = spark.range(1).select(ast.alias("a"), nodes.ast_literal([want]).alias("b")).select("a", "b", nodes.same_ast(F.col("a"), F.col("b")).alias("same")).first()
    assert got.a == got.b and got.same
    udfs.register(spark)
    texts(spark, ["a[b]", "x]"]).createOrReplaceTempView("docs")
    rows = spark.sql("SELECT doc_id, kind, name, value FROM docs, LATERAL markup_nodes(content) ORDER BY node_id").collect()
    assert [tuple(r) for r in rows] == [(0, "element", "a", None), (0, "text", None, "b")]
    assert spark.sql("SELECT unmatched_offsets('(]') AS u").first().u == [0, 1]


def test_lexical_predicates(spark):
    words = {"a": True, ":a-b.c": True, "é·": True, "1a": False, "": False, "a b": False, "a\n": False, "𐐀": False}
    df = texts(spark, list(words)).select("doc_id", native.is_xml_name(F.col("content")).alias("n"))
    assert column(df, "n") == list(words.values())
    assert [markup.is_name(w.encode()) for w in words] == list(words.values())
    cps = spark.createDataFrame([(i, c) for i, c in enumerate((0x110000, 0xD800, 0xDFFF, -1, 9, 0x10FFFF, 0xFFFE))], "doc_id bigint, cp int")
    assert column(cps.select("doc_id", native.is_xml_char(F.col("cp")).alias("c")), "c") == [False] * 4 + [True, True, False]
    refs = {"amp": True, "#12": True, "#xaF": True, "#": False, "#x": False, "#xg": False, "#12a": False}
    df = texts(spark, list(refs)).select("doc_id", native.is_xml_reference(F.col("content")).alias("r"))
    assert column(df, "r") == list(refs.values())


def tree(root: Path):
    (root / "sub").mkdir(parents=True)
    (root / "a.mk").write_text("em[x] [copy]")
    (root / "sub" / "b.m").write_text("p[é]")
    (root / "sub" / "bad.m").write_text("p[")
    (root / "c.M").write_text("em[x]")


def test_convert_files(spark, tmp_path):
    tree(tmp_path)
    rows = {Path(r.path).name: r for r in files.convert(spark, tmp_path.as_uri(), ("mk", "m"), headers=True).collect()}
    assert {n: r.html for n, r in rows.items()} == {"a.mk": "<em>x</em> ©", "b.m": "<p>é</p>", "bad.m": None, "c.M": None}
    assert rows["bad.m"].error.msg == "unmatched opener [" and rows["c.M"].header.endswith("c.M: ")
    assert files.convert(spark, tmp_path.as_uri(), ("mk", "m"), mode="DROPMALFORMED").count() == 2
    with pytest.raises(PySparkException, match="parsing .*bad.m: 1:3 unmatched opener"):
        files.convert(spark, tmp_path.as_uri(), ("mk", "m"), mode="FAILFAST").collect()
    assert files.convert(spark, (tmp_path / "sub" / "b.m").as_uri()).first().html == "<p>é</p>"


def test_usual_extensions(spark):
    paths = ["a/b.m", "b.n.m", "c.M", "d.min", "e.m.txt", "m", "f.mm"]
    df = texts(spark, paths).select("doc_id", native.is_markup_file(F.col("content")).alias("x"))
    assert column(df, "x") == [True, True, False, False, False, False, False]


def test_build_site(spark, tmp_path):
    tree(tmp_path / "in")
    files.build_site(spark, str(tmp_path / "in"), str(tmp_path / "out"), ("mk", "m"))
    made = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert made == {"a.html": "<em>x</em> ©", "sub/b.html": "<p>é</p>", "c.M": "em[x]"}


def test_change_feed():
    old, new = {"a": "1", "b": "1", "c": "1"}, {"a": "1", "b": "2"}
    assert [(p, op) for p, op, _ in live.changes("/nonexistent", old, new)] == [("b", "delete"), ("c", "delete")]


def test_live_conversion(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    tree(root)
    (root / ".hidden.m").write_text("x")
    run = lambda: live.live_convert(spark, str(root), str(out), str(tmp_path / "ck"), ("mk", "m"), suffix="<!--r-->", available_now=True).awaitTermination()
    run()
    made = lambda: {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    assert made() == {"a.html": "<em>x</em> ©<!--r-->", "sub/b.html": "<p>é</p><!--r-->", "c.M": "em[x]"}
    (root / "a.mk").write_text("b[new]")
    (root / "sub" / "b.m").unlink()
    run()
    assert made() == {"a.html": "<b>new</b><!--r-->", "c.M": "em[x]"}


def test_last_change_of_a_path_wins(spark):
    df = spark.createDataFrame([("a.m", "create", b"p[1]", 0), ("a.m", "modify", b"p[2]", 1), ("b.m", "create", b"x", 0), ("b.m", "delete", None, 2)], "path string, op string, content binary, seq bigint")
    got = {r.path: (r.op, r.content) for r in live.converted(df).collect()}
    assert got == {"a.html": ("modify", b"<p>2</p>"), "b.html": ("delete", None)}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value != value or str(value) == "<NA>":
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_query_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    found = duck.execute(queries.SQL[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == names
    want = sorted(tuple(plain(r[own.index(n)]) for n in names) for r in found.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == want


def test_depths_of_odd_pages_against_sql(spark, tmp_path):
    rows = [(1, "<a>"), (2, None), (3, ""), (4, "abc"), (5, ">"), (6, "x>"), (7, "><"), (8, "<(>)"), (9, "<é<"), (10, "<a>"), (10, "b<"), (None, "<"), (None, "<<"), (11, ""), (11, "<"), (12, ">>"), (12, "><<<"), (13, "<"), (13, None), (14, "é<"), (14, "<")]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(queries.SQL["matcher_depth_max"]).fetchall(), key=str)
    assert sorted(map(tuple, queries.matcher_depth_max(spark, str(tmp_path)).collect()), key=str) == want and len(want) == 14


def test_queries_without_sql(spark):
    got = {r.file: r.html for r in queries.convert_files(spark, DATA).collect()}
    assert len(got) == 25 and got["1.m"].startswith("<p>NATION_1 ") and got["0.txt"] is None
    assert queries.live_convert(spark, DATA).count() == 25


def test_entry_point_without_the_optional_part(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "palisade.llm.queries", None)
    assert set(e.queries()) == set(queries.QUERIES) and set(e.oracle_sql()) == set(queries.SQL)
    assert e.entry(spark).count() > 0


def test_scan_agrees_with_brute_force_on_real_texts(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(5).select(F.translate("html", "<>/b", "[]{)").alias("t")).collect()
    for r in pages:
        data = r.t.encode()
        lost = set(brackets.unmatched(data))
        rest = bytes(b for i, b in enumerate(data) if i not in lost)
        assert brackets.scan(rest)[1] is None


def test_census_sends_only_texts_with_brackets(spark):
    from palisade.plans import census

    df = texts(spark, ["a(b", "plain", "", None, "[]"])
    counted = census.census(df, F.col("content"))
    assert tuple(counted.first()) == (5, 2, 1, 1, 1)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "unmatched_offsets(CASE WHEN" in plan


def test_reading_stops_at_a_closer(spark):
    df = texts(spark, ["é(a)]b", "a(b)", "a(]", "", None, "("])
    got = column(df.select("doc_id", native.text_stop(F.col("content"), udfs.bracket_error(F.col("content"))).alias("s")), "s")
    assert [x and tuple(x) for x in got] == [(5, "]", None), (4, None, None), (None, None, "1:3 opener ( closed with mismatched ]"), (0, None, None), None, (None, None, "1:2 unmatched opener (")]


def test_text_only_parsing(spark):
    df = texts(spark, ["p[x] q{a}", "[> x <]", "a]", None]).select("doc_id", udfs.parse_text(F.col("content")).alias("p")).select("doc_id", "p.*")
    kinds = [r and [(n.kind, n.name, n.value) for n in r] for r in column(df, "ast")]
    assert kinds == [[("text", None, "p"), ("ref", "x", None), ("text", None, " q{a}")], [("text", None, "[x]")], None, None]


def test_events_and_unwritable_trees(spark):
    flat = nodes.markup_nodes(texts(spark, ["p{a=[x]}[b[]-[c]]+[r]", ""]))
    found = [(r.event, r.name or r.value) for r in nodes.events(flat).orderBy("seq").collect()]
    assert found == [("start element", "p"), ("start attr", "a"), ("text", "x"), ("end attr", "a"), ("start element", "b"), ("end element", "b"), ("comment", "c"), ("end element", "p"), ("rawtext", "r")]
    assert nodes.events(flat, comments=False).where("event = 'comment'").count() == 0
    stray = asts(spark, [[v.attr("a", v.t("x"))], [v.el("p", v.attr("a"), v.t("y"))], [("odd", None, None, [])]])
    both = stray.select("doc_id", udfs.to_markup(F.col("ast")).alias("m"), nodes.write_fault(F.col("ast")).alias("f"))
    assert column(both, "m") == [None, "p{a=[]}[y]", None]
    assert column(both, "f") == ["attr out of place", None, "odd out of place"]


def test_node_relations_and_name_characters(spark):
    flat = nodes.markup_nodes(texts(spark, ["a[b[c]]"]))
    assert sorted((r.node_id, r.parent_id, r.parent_name) for r in nodes.children(flat).collect()) == [(1, 0, "a"), (2, 1, "b")]
    assert len(nodes.collect_nodes(flat).first().ast) == 3
    chars = texts(spark, ["a", "-", ":", "1", "é", " ", ""])
    assert column(chars.select("doc_id", native.is_name_start_char(F.col("content")).alias("x")), "x") == [True, False, True, False, True, False, False]
    assert column(chars.select("doc_id", native.is_name_char(F.col("content")).alias("x")), "x") == [True, True, True, True, True, False, False]


def test_diff_counts_both_tables_at_once(spark):
    flat = nodes.markup_nodes(texts(spark, ["a[b]", None, "c"]))
    a, b = flat.union(flat.where("name = 'a'")), flat.where("value IS NULL OR value <> 'c'").union(texts(spark, ["+[x]"]).transform(nodes.markup_nodes))
    diff = nodes.diff_nodes(a, b)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]
    assert sorted((r.side, r.name or r.value) for r in diff.collect()) == [("a", "a"), ("a", "c"), ("b", "x")]


def test_descendants_of_whole_tables_need_no_join(spark):
    flat = nodes.markup_nodes(texts(spark, ["a{x=[y]}[b[c]d[]]", "", "e"]))
    want = sorted((r.doc_id, r.ancestor, r.node) for r in nodes.descendants(flat).collect())
    whole = nodes.descendants(flat, whole=True)
    assert sorted(map(tuple, whole.collect())) == want and len(want) == 7
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    left = nodes.descendants(flat.where("kind <> 'attr'"))
    assert sorted((r.ancestor, r.node) for r in left.collect()) == [(0, 2), (0, 3), (0, 4), (0, 5), (3, 4)]


def test_long_row_groups_are_spread(spark, tmp_path):
    spark.range(1000).selectExpr("id", "if(id % 2 = 0, NULL, 'x') AS t").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = files.spread(df, 100)
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 10 and max(parts) < 200 and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.spread(df) is df and files.spread(df.limit(0)).count() == 0


def test_random_trees_survive_writing_and_parsing():
    import random

    rng = random.Random(7)

    def forest(depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            kind = rng.choice("tecm" if depth else "tcm")
            if kind == "t" and not (out and out[-1][0] == markup.TEXT):
                out.append(v.t("".join(rng.choice("ab é(x)") for _ in range(3)).replace("(", "").replace(")", "") + " .z"))
            elif kind == "e":
                out.append(v.el(rng.choice(["p", "em"]), *([v.attr("a", v.t("v"))] if rng.random() < 0.5 else []), *forest(depth - 1)))
            elif kind == "c":
                out.append(v.com("n [x]"))
            elif kind == "m":
                out.append(v.raw("r {y}"))
        return out

    for _ in range(300):
        tree = markup.rebuild(forest(4))
        assert markup.parse(markup.write_markup(tree).encode()) == tree
