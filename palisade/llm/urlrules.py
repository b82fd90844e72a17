"""URL filter: association rules over URL tokens, mined by FP-growth from labels."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import INLINE_ROWS, materialise, pick

#: A rule needs so many bad labelled pages, at any size of the table, and this confidence.
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5


def tokens(url: F.Column) -> F.Column:
    """Distinct tokens of a URL, sorted: lower-case runs of ASCII letters and digits, without pure numbers."""
    parts = F.regexp_extract_all(F.lower(url), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: ~t.rlike("^[0-9]+$"))))


def _indexed(rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """``rules`` with ``token``: of each rule's tokens the one of least weight in ``rarity`` (token, weight)."""
    spread = rules.select("*", F.explode("rule").alias("token")).join(rarity, "token")
    least = F.min_by("token", F.struct("weight", "token")).alias("token")
    return spread.groupBy(*rules.columns).agg(least)


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame | None:
    """(rule, n, bad, confidence): token sets, pruned, from (tokens, bad) rows.

    ``n`` pages have all tokens of the rule, ``bad`` of them are bad;
    confidence is their quotient. A rule stays if ``min_count`` bad pages and
    the confidence support it and no rule of fewer of its tokens is as
    confident. Rules are of any length.

    FP-growth runs over the bad pages, as only what they have can be a rule;
    tokens that stand on the very same labelled pages are one item to it and
    are told apart after, since two of them in a rule say no more than one. So
    a host's or a template's words don't multiply the item sets. How many of
    all pages have an item set is counted by an index on its rarest token.

    No rows, or fewer bad ones than ``min_count``, give None; pages without
    tokens count nowhere; repeated rows count each.
    """
    rows = materialise(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("row")), "transactions")
    n_bad = rows.where("bad").count()
    if n_bad < min_count:
        return None
    stands = rows.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(38,0)").alias("h"))
    known = stands.groupBy("token").agg(F.count(F.lit(1)).alias("weight"), F.sum("h").alias("h")).where(F.col("weight") >= min_count)
    classes = materialise(known.groupBy("weight", "h").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")), "classes")
    item_of = classes.select("item", F.explode("members").alias("token"))
    items = rows.select("row", "bad", F.explode("tokens").alias("token")).join(item_of, "token").groupBy("row", "bad").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = materialise(items, "items")

    bad = items.where("bad").select("items")
    found = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / max(1, bad.count()), minConfidence=1.0).fit(bad).freqItemsets
    sets = materialise(found.select(F.array_sort("items").alias("rule"), F.col("freq").alias("bad")).where(F.col("freq") >= min_count), "itemsets")
    rarity = classes.select(F.col("item").alias("token"), "weight")
    index = _indexed(sets.select("rule"), rarity)
    met = items.select("items", F.explode("items").alias("token")).join(index, "token").where("size(array_except(rule, items)) = 0")
    rules = met.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(sets, "rule")
    rules = materialise(rules.withColumn("confidence", F.col("bad") / F.col("n")).where(F.col("confidence") >= min_confidence), "confident")
    weaker = rules.select(F.col("rule").alias("r"), F.col("confidence").alias("c"), F.explode("rule").alias("token")).join(_indexed(rules.select("rule", "confidence"), rarity), "token")
    weaker = weaker.where("size(rule) < size(r) AND confidence >= c AND size(array_except(rule, r)) = 0").select(F.col("r").alias("rule")).distinct()
    rules = rules.join(weaker, "rule", "left_anti")
    # Back from items to tokens: each item of a rule stands for any one of its tokens.
    members = rules.select("rule", "n", "bad", "confidence", F.explode("rule").alias("item")).join(classes.select("item", "members"), "item")
    lists = members.groupBy("rule", "n", "bad", "confidence").agg(F.collect_list("members").alias("lists"))
    product = F.expr("aggregate(lists, cast(array(array()) AS array<array<string>>), (a, m) -> flatten(transform(a, x -> transform(m, t -> array_append(x, t)))))")
    return materialise(lists.select(F.explode(product).alias("rule"), "n", "bad", "confidence").withColumn("rule", F.array_sort("rule")), "rules")


def filter_urls(pages: DataFrame, labels: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, url, n_rules, rule, confidence, rejected) of every row of ``pages``.

    A page is labelled through the labels row of its id, bad if that has
    quality 0 or toxic 1. Rules mined from all labelled pages are looked up by
    an inverted index: a URL's tokens meet the rules listed under their rarest
    token, and those whose other tokens the URL has too apply. ``rule`` is the
    applying rule of most confidence (then support, then least by name), its
    tokens joined by spaces; a page is rejected if any applies.

    A null or tokenless URL meets no rule and is kept; rows without page_id are
    judged but teach nothing; repeated rows are judged alike and repeated
    labels of a page count once, bad if any is; without labels all are kept; an
    empty table gives no rows; other columns are not looked at.
    """
    slim = pages.select(*pick(pages, page_id="page_id", url="url")).withColumn("tokens", F.coalesce(tokens(F.col("url")), F.expr("cast(array() AS array<string>)")))
    own = labels.select(*pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")).where("doc_id IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    labelled = slim.join(own, slim.page_id == own.doc_id).select("tokens", (F.col("bad") == 1).alias("bad"))
    rules = mine(materialise(labelled, "labelled-urls"), min_confidence)
    nothing = [F.lit(0).cast("bigint").alias("n_rules"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("rejected")]
    if rules is None or rules.isEmpty():
        return slim.select("page_id", "url", *nothing)
    single = rules.select(F.explode("rule").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("weight"))
    index = _indexed(rules.select("rule", "bad", "confidence"), single)
    if rules.count() <= INLINE_ROWS:
        index = F.broadcast(index)
    urls = slim.select("url", "tokens").distinct()
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where("size(array_except(rule, tokens)) = 0")
    name = F.array_join("rule", " ")
    best = F.min_by(F.struct(name.alias("rule"), "confidence"), F.struct(-F.col("confidence"), -F.col("bad"), name))
    hits = met.groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"), best.alias("best")).withColumnRenamed("url", "hit")
    out = slim.join(hits, slim.url == hits.hit, "left")
    return out.select("page_id", "url", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.col("best.rule").alias("rule"), F.col("best.confidence").alias("confidence"), F.col("hit").isNotNull().alias("rejected"))


def oracle() -> str:
    return f"""
WITH RECURSIVE tok AS (
  SELECT page_id, url, list_sort(list_distinct(list_filter(regexp_extract_all(lower(url), '[a-z0-9]+'), lambda t: NOT regexp_full_match(t, '[0-9]+')))) AS tokens FROM pages
), lab AS (
  SELECT page_id, tokens, bad FROM tok JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id) ON page_id = doc_id
), item AS (
  SELECT page_id, unnest(tokens) AS t FROM lab WHERE bad = 1
), subset AS (
  SELECT page_id, [t] AS rule FROM item
  UNION ALL
  SELECT s.page_id, list_append(s.rule, i.t) FROM subset s JOIN item i ON s.page_id = i.page_id AND i.t > s.rule[len(s.rule)]
), freq AS (
  SELECT rule, count(*) AS bad FROM subset GROUP BY rule HAVING count(*) >= {MIN_COUNT}
), conf AS (
  SELECT rule, any_value(f.bad) AS bad, any_value(f.bad)::DOUBLE / count(*)::DOUBLE AS confidence FROM freq f JOIN lab ON list_has_all(tokens, rule)
  GROUP BY rule HAVING any_value(f.bad)::DOUBLE / count(*)::DOUBLE >= {MIN_CONFIDENCE}
), rules AS (
  SELECT * FROM conf r WHERE NOT EXISTS (SELECT 1 FROM conf s WHERE len(s.rule) < len(r.rule) AND s.confidence >= r.confidence AND list_has_all(r.rule, s.rule))
), met AS (
  SELECT u.url, array_to_string(r.rule, ' ') AS rule, r.confidence, r.bad FROM (SELECT DISTINCT url, tokens FROM tok) u JOIN rules r ON list_has_all(u.tokens, r.rule)
), best AS (
  SELECT *, count(*) OVER (PARTITION BY url) AS n_rules, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, bad DESC, rule) AS k FROM met
)
SELECT t.page_id, t.url, coalesce(n_rules, 0) AS n_rules, b.rule, b.confidence, b.url IS NOT NULL AS rejected
FROM tok t LEFT JOIN best b ON t.url = b.url AND k = 1"""
