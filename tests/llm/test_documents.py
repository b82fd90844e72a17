"""Operators on documents against brute force, and on odd tables."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import components, linededup, mixing, neardup, passages, sharding
from palisade.llm import textvec as tv
from tests.llm.helpers import LONG, collect, docs, odd_rows

WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "dan fel gir hom jup kas lem nid pog rut".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


def shingle_set(text, n=3):
    w = ["".join(c for c in x.lower() if c.isalnum()) for x in text.split()]
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def groups_of(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- kernels ------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["Été à la Plage!", None, "", "été", "x-y x"]
    (c,) = tv.chunks(pa.array(texts))
    w = tv.words(c)
    got = [[bytes(c.buf[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [["Été", "à", "la", "Plage"], [], [], ["été"], ["x", "y", "x"]]
    assert w.hash[0] == w.hash[4] and w.hash[5] == w.hash[7] and len(set(w.hash)) == 6


def test_chunks_are_whole_texts_whatever_the_size():
    texts = ["aa bb", "", "cc " * 1000, None, "dd ee ff"]
    for size in (1, 10, 10_000):
        seen = [bytes(c.buf[a:b]).decode() for c in tv.chunks(pa.array(texts), size) for a, b in zip(c.offsets, c.offsets[1:])]
        assert seen == [t or "" for t in texts]
    sliced = pa.array(["zz", *texts]).slice(1)
    assert sum(c.rows for c in tv.chunks(sliced)) == len(texts)


def test_shingles_of_short_rows():
    (c,) = tv.chunks(pa.array(["a", "a b", "a b c d", ""]))
    h, first = tv.shingles(tv.words(c), 3)
    assert np.diff(first).tolist() == [1, 1, 2, 0] and len(set(h)) == 4


# --- components ------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)]
    got = dict(collect(components.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint"))))
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == groups_of([p for p in pairs if p[0] != p[1]], nodes)


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "u bigint, v bigint")
    assert components.connected_components(none).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (4, -4), (4, -4)], "u bigint, v bigint")
    assert sorted(collect(components.connected_components(odd))) == [(-4, -4), (4, -4)]


# --- near duplicates --------------------------------------------------------------


def near_corpus(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        base = sentence(rng, 120).split()
        for _ in range(1 + g % 6):
            copy = list(base)
            for k in rng.integers(0, 120, g % 5):
                copy[k] = str(rng.choice(WORDS))
            rows.append(" ".join(copy))
    rows += [sentence(rng, 100) for _ in range(20)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[i], f"s{i % 3}") for i in order]


def test_near_duplicates_against_brute_force(spark):
    rows = near_corpus()
    sets = {i: shingle_set(t) for i, t, _ in rows}
    pairs = [(a, b) for a, b in combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.5]
    want = groups_of(pairs, sets)
    got = {r.doc_id: r.group_id for r in neardup.near_duplicate_groups(docs(spark, rows)).collect()}
    same = lambda g: {(a, b) for a, b in combinations(sorted(g), 2) if g[a] == g[b]}
    assert len(same(got) & same(want)) >= 0.97 * len(same(want))
    assert len(same(got) - same(want)) <= 0.03 * len(same(want))


def test_near_duplicate_bucket_mates_off_the_hub_are_compared(spark):
    """A chain in which neighbours agree and ends don't still is one group."""
    rng = np.random.default_rng(5)
    words = sentence(rng, 160).split()
    chain = []
    for step in range(6):
        chain.append((step, " ".join(words), "a"))
        for k in range(step * 18, step * 18 + 18):
            words[k] = str(rng.choice(WORDS))
    got = {r.doc_id: r.group_id for r in neardup.near_duplicate_groups(docs(spark, chain)).collect()}
    assert set(got.values()) == {0}


def test_near_duplicates_against_all_signatures(spark, monkeypatch):
    """Exactly the groups that all pairs of signatures sharing a band give, hot buckets split or not."""
    rows = near_corpus(4)
    sigs = {r.doc_id: (np.frombuffer(r.signature, np.uint32), set(enumerate(r.bands))) for r in neardup.signatures(docs(spark, rows)).collect()}
    pairs = [(a, b) for a, b in combinations(sigs, 2) if sigs[a][1] & sigs[b][1] and (sigs[a][0] == sigs[b][0]).mean() >= 0.5]
    want = groups_of(pairs, sigs)
    for hot in (neardup.HOT, 1):
        monkeypatch.setattr(neardup, "HOT", hot)
        got = neardup.near_duplicate_groups(docs(spark, rows)).collect()
        assert {r.doc_id: r.group_id for r in got} == want and all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_near_duplicates_on_odd_tables(spark):
    rows = [*odd_rows(), (8, "twice the same row", "c"), (9, LONG, "a")]
    got = {r.doc_id: (r.group_id, r.kept) for r in neardup.near_duplicate_groups(docs(spark, rows)).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True), 8: (6, False), 9: (5, False)}
    kept = neardup.drop_near_duplicates(docs(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7] and kept.columns == docs(spark, rows).columns
    assert neardup.near_duplicate_groups(docs(spark, [])).count() == 0 and neardup.drop_near_duplicates(docs(spark, [])).count() == 0


# --- lines --------------------------------------------------------------------------


def lines_by_brute_force(rows, least):
    first = {}
    for _, t, s in rows:
        if t is not None and s is not None:
            first[t] = min(s, first.get(t, s))
    sites = {}
    for t, s in first.items():
        for line in t.split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(s)
    spread = {line for line, s in sites.items() if len(s) >= least}
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        lines = t.split("\n")
        flagged = [x for x in lines if x.strip(" ") in spread]
        cut = any(x.strip(" ") and x.strip(" ") not in spread for x in lines)
        out.append((i, "\n".join(x for x in lines if x.strip(" ") not in spread) if cut else t, len(flagged) if cut else 0))
    return sorted(out, key=str)


def line_rows():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(80):
        body = [sentence(rng, 8) for _ in range(4)]
        body.insert(2, "  all rights reserved ")
        if i % 2:
            body.append(f"near {i % 13 % 7}")
        rows.append((i, "\n".join(body), f"site{i % 14}"))
    whole = "\n".join(sentence(rng, 9) for _ in range(3))
    rows += [(100 + i, whole, f"site{i}") for i in range(12)]  # copies of one text: no boilerplate
    like = [sentence(rng, 9) for _ in range(4)]
    rows += [(200 + i, "\n".join(like[: 1 + i % 4]), f"site{i}") for i in range(30)]  # nothing but spread lines
    return rows + [(300 + i, "\n".join([*like, f"own {i}"]), f"site{i}") for i in range(9)]


@pytest.mark.parametrize("inline", [20_000, 0])
def test_line_dedup_against_brute_force(spark, inline):
    rows = [*line_rows(), *odd_rows()]
    got = linededup.remove_spread_lines(docs(spark, rows), min_sites=5, inline_rows=inline, report=True)
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got.collect()], key=str) == lines_by_brute_force(rows, 5)


def test_line_sketches_near_the_threshold_are_counted_exactly(spark):
    rows = [(i, f"kept {i} and some more words\nspread {n}", f"s{i}") for n in range(8, 13) for i in range(100 * n, 100 * n + n)]
    d = docs(spark, rows)
    want = {n for n in range(8, 13) if n >= 10}
    left = {int(x.split()[-1]) for r in linededup.remove_spread_lines(d, min_sites=10).collect() for x in r.text.split("\n") if x.startswith("spread")}
    assert left == set(range(8, 13)) - want
    out = linededup.remove_spread_lines(d, min_sites=10)
    assert out.columns == d.columns and out.where("n_chars <> length(text)").count() == 0
    assert linededup.remove_spread_lines(docs(spark, [])).count() == 0


# --- passages -------------------------------------------------------------------------


def passage_corpus():
    rng = np.random.default_rng(3)
    shared = [sentence(rng, 55) for _ in range(6)]
    rows = [(i, f"{sentence(rng, int(rng.integers(5, 90)))} {shared[i % 6]} {sentence(rng, int(rng.integers(5, 90)))}", "a") for i in range(30)]
    return rows + [(100 + i, sentence(rng, 150), "b") for i in range(30)], shared


def test_passages_are_found_wherever_they_stand(spark):
    rows, shared = passage_corpus()
    got = passages.repeated_passages(docs(spark, rows)).collect()
    together = {}
    for r in got:
        for p in r.passages:
            together.setdefault(p, set()).add(r.doc_id)
    found = {frozenset(p) for ids in together.values() for p in combinations(sorted(ids), 2)}
    assert found == {frozenset(p) for k in range(6) for p in combinations(range(k, 30, 6), 2)}
    texts = {i: t.encode() for i, t, _ in rows}
    inside = lambda r: shingle_set(texts[r.doc_id][r.start : r.end].decode()) & shingle_set(shared[r.doc_id % 6])
    assert all(len(inside(r)) >= 11 for r in got)
    assert {r.doc_id for r in got if not r.removed} >= set(range(6))


def test_edited_passages_share_a_component(spark):
    rng = np.random.default_rng(9)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(6):
        copy = list(base)
        copy[i * 30 + 10] = "edited"
        rows.append((i, " ".join(copy), "a"))
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(6))


@pytest.mark.parametrize("between, lengths", [("\n", (15, 20, 25, 30, 40, 48)), (" ", (20, 25, 31, 35, 40, 48))])
def test_short_paragraphs_are_found_among_other_words(spark, between, lengths):
    rng = np.random.default_rng(12)
    shared = [sentence(rng, n) for n in lengths for _ in range(8)]
    rows = [(2 * i + j, between.join([sentence(rng, 40), p, sentence(rng, 40)]), "a") for i, p in enumerate(shared) for j in range(2)]
    together = {}
    for r in passages.repeated_passages(docs(spark, rows), min_words=12).collect():
        for p in r.passages:
            together.setdefault(p, set()).add(r.doc_id)
    assert {frozenset(ids) for ids in together.values()} == {frozenset((2 * i, 2 * i + 1)) for i in range(len(shared))}


@pytest.mark.parametrize("edit", [False, True])
def test_spans_cover_the_whole_repeated_passage(spark, edit):
    rng = np.random.default_rng(14)
    rows, where = [], {}
    for i, n in enumerate(n for n in (40, 49, 60, 100) for _ in range(6)):
        words = sentence(rng, n).split()
        for j in range(2):
            if j and edit and n > 49:
                words[n // 2] = "edited"
            before = sentence(rng, 40) + " "
            rows.append((2 * i + j, f"{before}{' '.join(words)} {sentence(rng, 40)}", "a"))
            where[2 * i + j] = (len(before), len(before) + len(" ".join(words)))
    covered = {i: set() for i in where}
    for r in passages.repeated_passages(docs(spark, rows), min_words=30 if edit else passages.MIN_WORDS).collect():
        covered[r.doc_id] |= set(range(r.start, r.end))
        assert r.removed == r.doc_id % 2
    share = [len(covered[i] & set(range(a, b))) / (b - a) for i, (a, b) in where.items()]
    beyond = [len(covered[i] - set(range(a, b))) for i, (a, b) in where.items()]
    # A paragraph at the threshold may have four own words on either side.
    assert min(share) >= (0.8 if edit else 1) and max(beyond) <= 2 * 4 * 8


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(13)
    pairs = []
    while len(pairs) < 600:
        base = rng.choice(WORDS, 20)
        copy = base.copy()
        copy[rng.integers(0, 20, int(rng.integers(1, 3)))] = "edited"
        if passages.THRESHOLD <= jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(copy))) <= 0.8:
            pairs += [" ".join(base), " ".join(copy)]
    (batch,) = pa.Table.from_arrays([pa.array(range(len(pairs))), pa.array(pairs)], names=["doc_id", "text"]).to_batches()
    bands, rows = passages.tune_bands()
    a, b = tv.universal(bands * rows, passages.SEED)
    p = passages.Paragraphs(next(tv.chunks(batch.column(1))))
    low = np.stack([(p.sets * a[i] + b[i]).min(1) for i in range(bands * rows)], 1).reshape(-1, 2, bands, rows)
    assert (low[:, 0] == low[:, 1]).all(2).any(1).mean() >= 0.93


def test_bucket_links_join_what_pairs_join():
    rng = np.random.default_rng(4)
    base = np.arange(1, 19, dtype=np.uint64)
    sets = []
    for i in range(30):
        s = base + np.uint64(100 * (i % 3))
        s[rng.integers(0, 18, int(rng.integers(0, 6)))] = np.uint64(5000 + i)
        sets.append(np.sort(s))
    sets = np.array(sets)
    ids = np.arange(30)
    pairs = [(a, b) for a, b in combinations(range(30), 2) if jaccard(set(sets[a]), set(sets[b])) >= 0.6]
    alone, both = np.zeros(30, np.int64), np.repeat([0, 1], 15)
    for bucket, hot in ((alone, 99), (both, 99), (alone, 1), (both, 1)):
        for owner in (ids, np.where(ids % 4 == 0, -1, ids % 5)):
            u, v, still = passages._bucket_links(bucket, owner, sets, 0.6, hot)
            want = [(a, b) for a, b in pairs if bucket[a] == bucket[b] and (owner[a] != owner[b] or owner[a] < 0)]
            open_ = set(still.tolist())
            left = [p for p in want if set(p) <= open_]
            assert set(zip(u.tolist(), v.tolist())) <= {p for a, b in want for p in ((a, b), (b, a))}
            assert bool(open_) == (hot == 1) and groups_of([*zip(u.tolist(), v.tolist()), *left], range(30)) == groups_of(want, range(30))


def test_band_keys_are_shuffled_as_a_row_a_bucket(spark, monkeypatch):
    """Not as a row a paragraph and band; whatever is held at a time, the same contents meet."""
    rows, _ = passage_corpus()
    bands, per = passages.tune_bands()
    packed = passages.contents(docs(spark, [*rows, (-5, rows[0][1], "a"), (1 << 62, rows[0][1], "a")]).coalesce(1), bands, per, range(bands), 3).collect()
    keyed = [(r.bucket, *x) for r in packed for x in passages._unpack(r.rows).T.tolist()]
    assert len(packed) <= 3 * bands < len(keyed) / 50 and {x[3] for x in keyed} >= {-5} and {x[4] for x in keyed} >= {1 << 62}
    # Parts of a bucket come apart, as from several batches.
    halves = [(r.bucket, passages._pack(passages._unpack(r.rows)[:, i::2])) for r in sorted(packed) for i in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in halves]), pa.array([x for _, x in halves], pa.binary())], names=["bucket", "rows"])
    groups = {}
    for bucket, key, content, lo, hi, times in keyed:
        groups.setdefault((bucket, key), []).append((content, times, lo, hi))
    want = set()
    for (bucket, key), g in groups.items():
        if min(x[2] for x in g) < max(x[3] for x in g) and (len({x[0] for x in g}) > 1 or bucket < 3):
            want |= {(key, *x, len(g) > 1) for x in g}
    assert {x[-1] for x in want} == {False, True}
    for held in (passages.HELD_BYTES, 1):
        monkeypatch.setattr(passages, "HELD_BYTES", held)
        for size in (1, len(halves)):
            got = [tuple(x.values()) for out in passages._met(3)(batch.slice(i, size) for i in range(0, len(halves), size)) for x in out.to_pylist()]
            assert len(got) == len(want) and set(got) == want


def test_passages_on_odd_tables(spark):
    again = " ".join(WORDS[:60])
    rows = [*odd_rows(), (20, again, "a"), (20, again, "a"), (None, again, "a")]
    assert passages.repeated_passages(docs(spark, rows)).count() == 0
    got = passages.repeated_passages(docs(spark, [*rows, (21, again, "z"), (8, LONG, "c")])).collect()
    assert {(r.doc_id, r.start, r.end, r.words, r.removed) for r in got} == {(20, 0, len(again), 60, False), (21, 0, len(again), 60, True), (5, 0, len(LONG) - 1, 40_000, False), (8, 0, len(LONG) - 1, 40_000, True)}
    assert passages.repeated_passages(docs(spark, [])).count() == 0
    bands, per = passages.tune_bands()
    assert 1 - (1 - passages.AT**per) ** bands >= passages.RECALL > 1 - (1 - passages.AT**per) ** (bands - 1)


def passages_by_brute_force(rows, threshold, min_words):
    """All pairs of paragraphs, components, first occurrences; spans without growth."""
    (c,) = tv.chunks(pa.array([t for _, t, _ in rows]), 1 << 30)
    p = passages.Paragraphs(c, min_words)
    ids = [rows[r][0] for r in p.row]
    sets = [set(x.tolist()) for x in p.sets]
    of = {}
    for i, content in enumerate(p.content):
        of.setdefault(content, set()).add(ids[i])
    apart = [len(of[x]) > 1 or len(of[y]) > 1 or of[x] != of[y] for x, y in combinations(p.content, 2)]
    pairs = [(a, b) for (a, b), free in zip(combinations(range(len(ids)), 2), apart) if free and jaccard(sets[a], sets[b]) >= threshold]
    where = {}
    for i, g in groups_of(pairs, range(len(ids))).items():
        where.setdefault(g, []).append((ids[i], int(p.word[i]), int(p.word[i] + p.words[i])))
    covered = {}
    for spans in where.values():
        if len({d for d, _, _ in spans}) < 2:
            continue
        spans.sort()
        first, reach = spans[0][0], spans[0][2]
        for d, a, b in spans:
            keep = d == first and a < reach  # paragraphs of the first occurrence overlap
            reach = max(reach, b) if keep else reach
            covered.setdefault((d, not keep), set()).update(range(a, b))
    return covered


def test_repeats_against_all_pairs(spark, monkeypatch):
    """Every word brute force finds repeated is in a span, removed or not alike, with hot buckets split or not."""
    rng = np.random.default_rng(21)
    rows, _ = passage_corpus()
    rows = rows[:18] + rows[30:36]
    for i in range(6):  # variants of one text
        words = rows[40 % len(rows)][1].split()
        for k in rng.integers(0, len(words), 4):
            words[k] = str(rng.choice(WORDS))
        rows.append((200 + i, " ".join(words), "a"))
    want = passages_by_brute_force(rows, passages.THRESHOLD, 30)
    texts = {i: t.split() for i, t, _ in rows}
    found = []
    for hot in (passages.HOT, 1):
        monkeypatch.setattr(passages, "HOT", hot)
        got = {}
        for r in passages.repeated_passages(docs(spark, rows), min_words=30).collect():
            before = len(" ".join(texts[r.doc_id])[: r.start].split())
            got.setdefault((r.doc_id, r.removed), set()).update(range(before, before + r.words))
        found.append(got)
        missed = sum(len(v - got.get(k, set()) - got.get((k[0], not k[1]), set())) for k, v in want.items())
        assert missed <= 0.03 * sum(map(len, want.values()))
        assert {d for d, _ in got} <= {d for d, _ in want}
    assert found[0] == found[1]


def test_removing_passages(spark):
    rows, shared = passage_corpus()
    rows += [(None, rows[0][1], "a"), (500, shared[0] + " " + shared[1], "a"), (500, shared[2], "a"), *odd_rows()]
    d = docs(spark, rows)
    out = passages.remove_passages(d)
    assert out.columns == d.columns and out.count() == len(rows)
    left = {r.doc_id: r.text for r in out.where("doc_id < 100 AND doc_id >= 10").collect()}
    core = lambda k: " ".join(shared[k].split()[2:-2])
    assert all((core(i % 6) in left[i]) == (i < 6) for i in range(10, 30))
    own = {i: t for i, t, _ in rows if i is not None and 100 <= i < 200}
    assert {r.doc_id: r.text for r in out.where("doc_id BETWEEN 100 AND 199").collect()} == own
    assert {r.text for r in out.where("doc_id = 500").collect()} == {rows[-len(odd_rows()) - 1][1], rows[-len(odd_rows()) - 2][1]}
    assert out.where("n_chars <> length(text)").count() == 0 and passages.remove_passages(docs(spark, [])).count() == 0


def test_what_is_split_or_left_open_is_not_broadcast(spark):
    """Spark takes exploded sets, and tables written with few distinct values, for far smaller than they are."""
    from palisade.llm.buckets import split_by_rare_tokens
    from palisade.llm.common import materialise

    members = materialise(spark.range(200).selectExpr("id % 3 AS key", "id", "array(id % 5, id % 7, 100 + id) AS tokens"), "members")
    unlike = members.selectExpr("key", "id AS content", "1L AS times", "-1L AS owner", "unhex(repeat('00000001', 18)) AS shingles")
    links = materialise(unlike.selectExpr("key", "content AS u", "if(content % 2 = 0, NULL, content) AS v"), "links")
    open_ = passages._left_open(unlike, links)
    assert sorted(r.content for r in open_.collect()) == list(range(0, 200, 2))
    for plan in (split_by_rare_tokens(members, F.lit(2)), open_, passages._split(unlike, 0.6)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_buckets_split_by_rare_tokens_lose_no_pair(spark):
    from palisade.llm.buckets import split_by_rare_tokens

    rng = np.random.default_rng(11)
    members = [(k, i, sorted({int(x) for x in np.concatenate([np.arange(5), rng.integers(10, 60, 12)])})) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(members, "key bigint, id bigint, tokens array<bigint>")
    keep = F.size("tokens") - F.ceil(F.size("tokens") * 0.6).cast("int") + 1
    got = {}
    for r in split_by_rare_tokens(df, keep).collect():
        got.setdefault((r.key, r.sub), set()).add(r.id)
    together = {(k, *p) for (k, _), ids in got.items() for p in combinations(sorted(ids), 2)}
    sets = {(k, i): set(t) for k, i, t in members}
    alike = {(k, a, b) for k in (1, 2) for a, b in combinations(range(60), 2) if jaccard(sets[k, a], sets[k, b]) >= 0.6}
    every = {(k, a, b) for k in (1, 2) for a, b in combinations(range(60), 2)}
    assert alike and alike <= together < every


# --- shards -----------------------------------------------------------------------------


def shards_by_brute_force(rows, shards, seed):
    import hashlib
    from fractions import Fraction

    by = {}
    for i, t, s in rows:
        by.setdefault(s or "", []).append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, t or "", i))
    placed = []
    for s, members in by.items():
        members.sort(key=lambda m: m[:3])
        placed += [(Fraction(2 * r - 1, 2 * len(members)), s, r, m[3]) for r, m in enumerate(members, 1)]
    placed.sort(key=lambda p: p[:3])
    return sorted([(p[3] or 0, s, k, k * shards // len(placed)) for k, p in enumerate(placed) for s in [p[1]]])


@pytest.mark.parametrize("bucket,strata", [(20_000, 2_000), (5, 2_000), (5, 1)])
def test_interleaving_against_brute_force(spark, bucket, strata):
    rows = [(i, f"t{i}", f"s{min(i % 7, 3)}") for i in range(203)] + [(1000, "x", None), (1001, "y", None)]
    out = sharding.interleave(docs(spark, rows), 8, 7, bucket, strata)
    got = sorted((r.doc_id, r.source or "", r._position, r._shard) for r in out.collect())
    assert got == shards_by_brute_force(rows, 8, 7)
    assert out.columns[-2:] == ["_shard", "_position"] and out.columns[:-2] == docs(spark, rows).columns


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "hot" if i % 5 else "cold") for i in range(1000)]
    per = {(r._shard, r.source): r["count"] for r in sharding.interleave(docs(spark, rows), 10).groupBy("_shard", "source").count().collect()}
    assert all(abs(per[k, "cold"] - 20) <= 1 and abs(per[k, "hot"] - 80) <= 1 for k in range(10))


def test_interleaving_odd_tables(spark, tmp_path):
    out = sharding.interleave(docs(spark, odd_rows()), 4).collect()
    assert sorted(r._position for r in out) == list(range(9))
    assert sharding.interleave(docs(spark, []), 4).count() == 0
    sharding.write_shards(docs(spark, odd_rows(), extra=False), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 9 and {r.shard for r in back.collect()} == {0, 1, 2}


# --- mixing -----------------------------------------------------------------------------


def cheapest(capacity, members, quota, costs):
    """The least cost of routing whole tokens, by trying every split."""
    quotas = sorted(quota)
    best = [10**18]

    def go(patterns, left, cost):
        if cost >= best[0]:
            return
        if not patterns:
            best[0] = min(best[0], cost + mixing.UNFILLED * sum(left.values()))
            return
        p, rest = patterns[0], patterns[1:]
        options = [q for q in quotas if q in members[p]]

        def spread(k, used, now):
            if k == len(options):
                n = sum(used.values())
                laps = sum(c * max(0, min(n - capacity[p] * i, capacity[p])) for i, c in enumerate(costs))
                if n <= capacity[p] * len(costs):
                    go(rest, now, cost + laps)
                return
            for n in range(now[options[k]] + 1):
                spread(k + 1, used | {options[k]: n}, now | {options[k]: now[options[k]] - n})

        spread(0, {}, left)

    go(sorted(capacity), dict(quota), 0)
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c"]
    capacity = {f"p{i}": int(rng.integers(1, 4)) for i in range(3)}
    members = {p: sorted(set(rng.choice(names, 2))) for p in capacity}
    quota = {n: int(rng.integers(0, 6)) for n in names}
    costs = (0, 1, 3)
    routed = mixing.min_cost_flow(capacity, members, quota, costs)
    total = 0
    for p, cap in capacity.items():
        n = sum(v for (x, _), v in routed.items() if x == p)
        assert n <= cap * len(costs)
        total += sum(c * max(0, min(n - cap * i, cap)) for i, c in enumerate(costs))
    filled = {q: sum(v for (_, x), v in routed.items() if x == q) for q in quota}
    assert all(filled[q] <= quota[q] for q in quota) and all(q in members[p] for p, q in routed)
    assert total + mixing.UNFILLED * sum(quota[q] - filled[q] for q in quota) == cheapest(capacity, members, quota, costs)


def test_mixture_reaches_its_weights(spark):
    rng = np.random.default_rng(0)
    rows = [(i, sentence(rng, int(rng.integers(5, 40))), "hot" if i % 10 else "cold") for i in range(2000)]
    weights = {"source:hot": 0.6, "source:cold": 0.4}
    out = mixing.mix(docs(spark, rows), [("source", "source")], weights, 0.5)
    got = {r.target: r.n for r in out.groupBy("target").agg(F.sum("_tokens").alias("n")).collect()}
    total = sum(len(t.split()) for _, t, _ in rows)
    assert all(abs(got[s] - w * total / 2) <= 40 for s, w in weights.items())
    copies = {r["copy"] for r in out.where("source = 'cold'").collect()}
    assert copies == {1, 2} and {r["copy"] for r in out.where("source = 'hot'").collect()} == {1}
    # A document's copies are its first ones, and repeated runs choose alike.
    per = out.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).where("m <> n").count()
    assert per == 0 and sorted(collect(out.select("doc_id", "copy"))) == sorted(collect(mixing.mix(docs(spark, rows), [("source", "source")], weights, 0.5).select("doc_id", "copy")))


def test_selection_against_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(1)
    rows = [(i, sentence(rng, int(rng.integers(1, 9))), "s") for i in range(300)]
    out = mixing.mix(docs(spark, rows), [("source", "source")], {"source:s": 1.0}, 1.3)
    total = sum(len(t.split()) for _, t, _ in rows)
    budget, at, want = round(total * 1.3), 0, []
    ordered = sorted(rows, key=lambda r: hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest())
    for lap in (1, 2):
        for i, t, _ in ordered:
            if at < budget:
                want.append((i, lap))
            at += len(t.split())
    assert sorted(collect(out.select("doc_id", "copy"))) == sorted(want)


def test_selection_over_several_patterns_against_brute_force(spark):
    import hashlib
    import json

    rng = np.random.default_rng(2)
    rows = [(i, sentence(rng, int(rng.integers(1, 9))), f"s{i % 7 % 3}") for i in range(260)] + [(900, "no source", None), (901, None, "s1")]
    kinds = {i: "en" for i, _, _ in rows}
    weights = {"source:s0": 0.5, "source:s1": 0.2, "source:s2": 0.1, "lang:en": 0.2}
    out = mixing.mix(docs(spark, rows), None, weights, 1.2)
    tokens = {i: len((t or "").split()) for i, t, _ in rows}
    of = {i: json.dumps(sorted([f"lang:{kinds[i]}"] + ([f"source:{s}"] if s else [])), separators=(",", ":")) for i, _, s in rows}
    capacity = {}
    for i, p in of.items():
        capacity[p] = capacity.get(p, 0) + tokens[i]
    members = {p: json.loads(p) for p in capacity}
    quota = mixing.quotas_of({}, round(sum(tokens.values()) * 1.2), weights)
    routed = mixing.min_cost_flow(capacity, members, quota)
    want = []
    for p in capacity:
        order = sorted((i for i in of if of[i] == p), key=lambda i: hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest())
        at = 0
        ends = np.cumsum([routed.get((p, q), 0) for q in sorted(members[p])])
        for lap in range(1, len(mixing.EPOCH_COSTS) + 1):
            for i in order:
                if at < ends[-1] and tokens[i]:
                    want.append((i, sorted(members[p])[int(np.searchsorted(ends, at, "right"))], lap))
                at += tokens[i]
    got = [tuple(r) for r in out.where("_tokens > 0").select("doc_id", "target", "copy").collect()]
    assert sorted(got) == sorted(want)
    report = {r.source: r for r in mixing.mixture_report(docs(spark, rows), None, weights, 1.2).collect()}
    assert {q: r.quota for q, r in report.items()} == quota and all(r.unfilled == r.quota - r.routed >= 0 for r in report.values())
    assert {q: r.routed for q, r in report.items()} == {q: sum(n for (_, x), n in routed.items() if x == q) for q in quota}


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(docs(spark, [(i, "a b", f"s{i}") for i in range(3)]))


def test_mixing_odd_tables(spark):
    out = mixing.mix(docs(spark, odd_rows()))
    assert out.columns[-3:] == ["target", "copy", "_tokens"]
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in odd_rows()}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, "a b", None)]), [("source", "source")]).count() == 0
    assert mixing.quotas_of({"a": 10, "b": 0}, 7, None) == {"a": 7} and sum(mixing.quotas_of({"a": 1, "b": 1, "c": 1}, 100, None).values()) == 100
