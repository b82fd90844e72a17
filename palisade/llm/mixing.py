"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palisade.llm.common import INLINE_ROWS, fresh, materialise, schema

SEED = 11
#: Cost per token of the first, second, ... pass over a document: convex, so passes fill in turn.
EPOCH_COSTS = (0, 1, 3, 6)
#: Cost per token of a quota left unfilled: above any repetition.
UNFILLED = 1_000
#: Patterns up to which the driver holds and solves the flow; more raise an error rather than lose any.
MAX_PATTERNS = 100_000
#: Weight of a source is its tokens to this power, unless weights are given.
TEMPER = 0.25


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], costs: tuple[int, ...] = EPOCH_COSTS) -> dict[tuple[str, str], int]:
    """Tokens to route from each pattern to each source quota.

    Every pattern may supply its tokens once at ``costs[0]``, again at
    ``costs[1]`` and so on; every quota takes at most its tokens, and each
    missing one costs ``UNFILLED``. Successive shortest paths with potentials,
    on integers: exact. The graph has one node a pattern and one a quota.
    """
    patterns, quotas = sorted(capacity), sorted(quota)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("q", q): i + 2 + len(patterns) for i, q in enumerate(quotas)}
    to: list[int] = []
    left: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(node) + 2)]

    def arc(u: int, v: int, room: int, cost: int) -> int:
        for a, b, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            out[a].append(len(to))
            to.append(b)
            left.append(r)
            price.append(c)
        return len(to) - 2

    everything = sum(quota.values())
    routes = {}
    for p in patterns:
        for c in costs:
            arc(0, node["p", p], capacity[p], c)
        for q in members[p]:
            if q in quota:
                routes[p, q] = arc(node["p", p], node["q", q], everything, 0)
    for q in quotas:
        arc(node["q", q], 1, quota[q], 0)
        arc(0, node["q", q], quota[q], UNFILLED)
    potential = [0] * len(out)
    while True:
        distance: list[float] = [float("inf")] * len(out)
        distance[0], via, heap = 0, [-1] * len(out), [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for e in out[u]:
                if left[e] and (n := d + price[e] + potential[u] - potential[to[e]]) < distance[to[e]]:
                    distance[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if distance[1] == float("inf"):
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push
    return {pq: left[e ^ 1] for pq, e in routes.items() if left[e ^ 1]}


def quotas_of(tokens: dict[str, int], budget: int, weights: dict[str, float] | None) -> dict[str, int]:
    """Whole-token quotas that sum to ``budget``, by largest remainder."""
    weights = {s: float(n) ** TEMPER for s, n in tokens.items() if n > 0} if weights is None else {s: w for s, w in weights.items() if w > 0}
    whole = sum(weights.values())
    if not whole:
        return {}
    exact = {s: budget * w / whole for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def mix(docs: DataFrame, memberships: list[tuple[str, str]] | None = None, weights: dict[str, float] | None = None, budget: float = 1.0, costs: tuple[int, ...] = EPOCH_COSTS, seed: int = SEED) -> DataFrame:
    """``docs``, one row per chosen copy, with ``target``, ``copy`` and ``tokens``.

    ``memberships`` lists (prefix, column): a document belongs to the source
    ``prefix:value`` of each column, by default its ``source`` and its ``lang``,
    so sources overlap. ``weights`` gives each source's share of the mixture
    (default: tokens ** 0.25); quotas are those shares of ``budget`` times the
    tokens (white-space words) of ``docs``. Documents with equal memberships
    form a pattern; the flow routes patterns' tokens to quotas at convex
    repetition costs. Within a pattern, documents follow in the order of a
    seeded hash of doc_id, pass after pass, and copy k goes to the quota in
    whose stretch of tokens it starts; so a quota is met to within one document
    a pattern, and ``copy`` counts from 1.

    The driver sees one row per pattern (MAX_PATTERNS at most) and per cut; documents are never
    gathered or sorted as a whole: exact cut points come from a histogram of
    hash ranges and a sort of the ranges a cut falls in. The cut table is
    joined by pattern, broadcast only when small.

    A null column is no membership; documents of no source with a weight are
    not chosen, as no quota takes them. Null and blank texts have no tokens and
    go where they fall. Other columns, whatever their names, pass through. Rows that share a doc_id (or have none) share their
    hash and their fate. Quotas beyond what all passes supply stay unfilled;
    ``mixture_report`` says by how much.
    Empty tables give no rows. Columns named target, copy or tokens are kept
    and the new ones get a leading underscore.
    """
    pattern, key, tokens = _keys(docs, memberships, seed)
    slim = materialise(docs.select(pattern.alias("pattern"), key.alias("key"), tokens.alias("tokens")), "tokens")
    capacity, members, _, quota = _demand(slim, weights, budget)
    routed = min_cost_flow(capacity, members, quota, costs)

    # Each pattern's routed tokens as consecutive stretches, cut at the ends of passes.
    stretches: list[tuple[str, str, int, int, int]] = []  # pattern, target, copy, from, to
    for p in sorted(capacity):
        at = 0
        for q in sorted(members[p]):
            rest = routed.get((p, q), 0)
            while rest > 0:
                lap, start = divmod(at, capacity[p])
                step = min(rest, capacity[p] - start)
                stretches.append((p, q, lap + 1, start, start + step))
                at, rest = at + step, rest - step
    cuts = sorted({(p, x) for p, _, _, a, b in stretches for x in (a, b) if 0 < x < capacity[p]})
    bounds = dict(_cut_keys(slim, cuts)) if cuts else {}
    low, high = "", "g"  # below and above every hash
    parts = [(p, q, k, bounds.get((p, a), low), bounds.get((p, b), high if b == capacity[p] else low)) for p, q, k, a, b in stretches]
    own_pattern, own_key, own_tokens, p_, q_, k_, lo, hi = (fresh(docs, n) for n in ("own_pattern", "own_key", "own_tokens", "cut_pattern", "cut_target", "cut_copy", "cut_lo", "cut_hi"))
    table = docs.sparkSession.createDataFrame([x for x in parts if x[3] < x[4]], schema((p_, T.StringType()), (q_, T.StringType()), (k_, T.IntegerType()), (lo, T.StringType()), (hi, T.StringType())))
    if len(parts) <= INLINE_ROWS:
        table = F.broadcast(table)
    keyed = docs.withColumns({own_pattern: pattern, own_key: key, own_tokens: tokens})
    chosen = keyed.join(table, (F.col(own_pattern) == F.col(p_)) & (F.col(own_key) >= F.col(lo)) & (F.col(own_key) < F.col(hi)))
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(q_).alias(fresh(docs, "target")), F.col(k_).alias(fresh(docs, "copy")), F.col(own_tokens).alias(fresh(docs, "tokens")))


def _keys(docs: DataFrame, memberships: list[tuple[str, str]] | None, seed: int) -> tuple[F.Column, F.Column, F.Column]:
    """Pattern (JSON list of the sources a row is in), seeded hash and tokens of each row."""
    memberships = [("source", "source"), ("lang", "lang")] if memberships is None else memberships
    have = {c.lower(): c for c in docs.columns}
    member = [F.concat(F.lit(prefix + ":"), F.col(f"`{have[c.lower()]}`").cast("string")) for prefix, c in memberships if c.lower() in have]
    text = F.col(f"`{have['text']}`") if "text" in have else F.lit(None).cast("string")
    ident = F.col(f"`{have['doc_id']}`").cast("string") if "doc_id" in have else F.lit(None).cast("string")
    pattern = F.to_json(F.array_sort(F.array_distinct(F.array_compact(F.array(*member))))) if member else F.lit("[]")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident, F.lit(""))))
    return pattern, key, F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _demand(slim: DataFrame, weights: dict[str, float] | None, budget: float) -> tuple[dict[str, int], dict[str, list[str]], dict[str, int], dict[str, int]]:
    """Tokens and sources of each pattern, tokens and quota of each source."""
    rows = slim.groupBy("pattern").agg(F.sum("tokens").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: mix by coarser sources")
    capacity = {r.pattern: int(r.n) for r in rows}
    members = {p: json.loads(p) for p in capacity}
    supply: dict[str, int] = {}
    for p, ms in members.items():
        for m in ms:
            supply[m] = supply.get(m, 0) + capacity[p]
    return capacity, members, supply, quotas_of(supply, round(sum(capacity.values()) * budget), weights)


def mixture_report(docs: DataFrame, memberships: list[tuple[str, str]] | None = None, weights: dict[str, float] | None = None, budget: float = 1.0, costs: tuple[int, ...] = EPOCH_COSTS, seed: int = SEED) -> DataFrame:
    """(source, supply, quota, routed, unfilled) of every source with a quota, as ``mix``
    routes them: ``unfilled`` tokens are beyond what ``len(costs)`` passes supply.

    Rows are as in ``mix``: nulls are no membership and an empty table has no sources.
    """
    pattern, key, tokens = _keys(docs, memberships, seed)
    capacity, members, supply, quota = _demand(docs.select(pattern.alias("pattern"), tokens.alias("tokens")), weights, budget)
    got: dict[str, int] = {}
    for (_, q), n in min_cost_flow(capacity, members, quota, costs).items():
        got[q] = got.get(q, 0) + n
    rows = [(q, supply.get(q, 0), n, got.get(q, 0), n - got.get(q, 0)) for q, n in sorted(quota.items())]
    return docs.sparkSession.createDataFrame(rows, "source string, supply bigint, quota bigint, routed bigint, unfilled bigint")


def _cut_keys(slim: DataFrame, cuts: list[tuple[str, int]]) -> list[tuple[tuple[str, int], str]]:
    """For each (pattern, x): the least hash whose documents start at token x or later."""
    spark = slim.sparkSession
    asked = spark.createDataFrame(cuts, schema(("pattern", T.StringType()), ("x", T.LongType())))
    part = F.substring("key", 1, 3)
    sums = slim.groupBy("pattern", part.alias("part")).agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("pattern").orderBy("part")
    spans = sums.select("pattern", "part", F.sum("n").over(w).alias("to"), F.col("n"))
    # The first range that reaches x: the hash with x tokens before it is in it or starts the next one.
    hit = asked.join(spans, "pattern").where("to >= x AND to - n < x").select("pattern", "part", "x", (F.col("to") - F.col("n")).alias("before"))
    rows = slim.withColumn("part", part).join(hit, ["pattern", "part"])
    units = rows.groupBy("pattern", "x", "before", "key").agg(F.sum("tokens").alias("n"))
    inside = Window.partitionBy("pattern", "x").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    starts = units.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    past = F.concat(F.substring(F.max("key"), 1, 3), F.lit("g"))
    found = starts.groupBy("pattern", "x").agg(F.coalesce(F.min(F.expr("CASE WHEN start >= x THEN key END")), past).alias("key"))
    return [((r.pattern, r.x), r.key) for r in found.collect()]
