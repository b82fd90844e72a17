"""Tables whose extra columns have the very names the operators use inside."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import fingerprints, linededup, mixing, neardup, passages, pieces, quality, sharding, toxicity, urlrules
from palisade.llm.common import materialise
from tests.llm.helpers import odd_rows
from tests.llm.test_documents import sentence

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def names_in(*modules):
    """Every name a string of these modules has in it, other than the columns of documents."""
    found = set()
    for m in modules:
        for literal in re.findall(r'"([^"\n]*)"', Path(m.__file__).read_text()):
            found |= {x.lower() for x in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", literal)}
    return sorted(found - set(COLUMNS) - {"page_id", "url", "html", "quality", "toxic", "item_id"})


def rows():
    import numpy as np

    rng = np.random.default_rng(3)
    out = [(i, f"{sentence(rng, 45)}\nfooter of all\nown {i}", f"s{i % 12}") for i in range(24)]
    return [*out, *((30 + i, out[i][1], f"s{i}") for i in range(4)), *odd_rows()]


def table(spark, names):
    plain = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return plain, plain.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in names])


def marks(spark):
    return spark.createDataFrame([(i, int(i % 9 > 0), int(i % 6 == 0)) for i in range(24)], "doc_id bigint, quality int, toxic int")


def sharded(d, m):
    return sharding.interleave(d, 4)


def sharded_by_rank(d, m):
    return sharding.interleave(d, 4, 7, 5, 1)


def cut_by_join(d, m):
    return linededup.remove_spread_lines(d, inline_rows=0, report=True)


THROUGH = [
    (mixing, lambda d, m: mixing.mix(d)),
    (sharding, sharded),
    (sharding, sharded_by_rank),
    (linededup, lambda d, m: linededup.remove_spread_lines(d, report=True)),
    (linededup, cut_by_join),
    (neardup, lambda d, m: neardup.drop_near_duplicates(d)),
    (passages, lambda d, m: passages.remove_passages(d)),
    (pieces, lambda d, m: pieces.encode_documents(d)),
    (quality, lambda d, m: quality.drop_anomalous(d, m)),
]


@pytest.mark.parametrize("module, f", THROUGH)
def test_columns_of_internal_names_pass_through(spark, module, f):
    names = names_in(module)
    plain, extra = table(spark, names)
    want = f(plain, marks(spark))
    got = materialise(f(extra, marks(spark)), "named")
    assert got.columns[: len(extra.columns)] == extra.columns
    for n in names:
        assert got.where(F.col(n) != F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).isEmpty()
    own = got.select(*COLUMNS, *[got.columns[len(extra.columns) + i] for i in range(len(want.columns) - len(COLUMNS))])
    assert sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


BY_ID = [
    (neardup, lambda d, m: neardup.near_duplicate_groups(d)),
    (passages, lambda d, m: passages.repeated_passages(d)),
    (toxicity, lambda d, m: toxicity.toxicity(d, m)),
    (fingerprints, lambda d, m: fingerprints.fingerprints(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(5))),
    (quality, lambda d, m: quality.quality_scores(d, m)),
]


@pytest.mark.parametrize("module, f", BY_ID)
def test_columns_of_internal_names_change_no_result(spark, module, f):
    plain, extra = table(spark, names_in(module))
    want, got = f(plain, marks(spark)), f(extra, marks(spark))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_url_filter_with_columns_of_internal_names(spark):
    urls = spark.createDataFrame([(i, f"http://{'casino' if i % 2 else 'news'}.example.com/{i}") for i in range(24)], "page_id bigint, url string")
    bad = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(24)], "doc_id bigint, quality int, toxic int")
    extra = urls.select("*", *[F.lit("x").alias(n) for n in [*names_in(urlrules), "quality", "toxic"] if n not in ("page_id", "url")])
    want, got = (sorted(map(tuple, urlrules.filter_urls(d, bad).collect())) for d in (urls, extra))
    assert got == want and any(r[-1] for r in want)


def test_pipeline_with_columns_of_internal_names(spark, tmp_path):
    names = names_in(mixing, linededup, neardup, pieces, quality)
    plain, extra = table(spark, names)
    for kind, d in (("plain", plain), ("extra", extra), ("none", extra.limit(0))):
        d.write.parquet(str(tmp_path / kind / "documents.parquet"))
        marks(spark).write.parquet(str(tmp_path / kind / "labels.parquet"))
    want, got, none = (corpus_pipeline.run(spark, str(tmp_path / kind)) for kind in ("plain", "extra", "none"))
    assert got.columns[: len(extra.columns)] == extra.columns and none.count() == 0
    ids = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    assert ids(got) == ids(want)
    for n in names:
        assert got.where(F.col(n) != F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).isEmpty()
