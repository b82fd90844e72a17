"""Learned and coded operators: rules, trees, forests, tokens, fingerprints, the pipeline."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import boosting, fingerprints, pieces, quality, toxicity, urlrules
from palisade.llm import textvec as tv
from palisade.llm.common import least_hashed, materialise, pick
from tests.llm.helpers import LONG, collect, docs, odd_rows
from tests.llm.test_documents import sentence

DATA = "/root/testdata/sf0.001"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# --- URL rules ----------------------------------------------------------------------


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "x") for i, u in urls], "page_id bigint, url string, html string, rule string")


def url_corpus():
    urls = [(i, f"https://{'casino' if i % 3 == 0 else 'news'}.example.{'com' if i % 2 else 'org'}/p{i % 5}/{i}") for i in range(60)]
    return urls, [(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i, _ in urls]


def rules_by_brute_force(urls, bad):
    import re
    from itertools import combinations

    toks = {i: sorted({t for t in re.findall("[a-z0-9]+", u.lower()) if not t.isdigit()}) for i, u in urls}
    n, b = {}, {}
    for i, t in toks.items():
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                n[c] = n.get(c, 0) + 1
                b[c] = b.get(c, 0) + bad[i]
    good = {c: b[c] / n[c] for c in n if b[c] >= 5 and b[c] / n[c] >= 0.5}
    return {c: v for c, v in good.items() if not any(set(d) < set(c) and w >= v for d, w in good.items())}


def test_url_rules_against_brute_force(spark):
    urls, marks = url_corpus()
    labelled = pages(spark, urls).select(urlrules.tokens(F.col("url")).alias("tokens"), F.col("page_id").isin([i for i, q, _ in marks if q == 0]).alias("bad"))
    got = {tuple(r.rule): r.confidence for r in urlrules.mine(labelled).collect()}
    assert got == rules_by_brute_force(urls, {i: 1 - q for i, q, _ in marks}) and ("casino", "com") in got
    out = {r.page_id: r for r in urlrules.filter_urls(pages(spark, urls), labels(spark, marks)).collect()}
    parts = lambda u: set(u.replace(":", "/").replace(".", "/").split("/"))
    for i, u in urls:
        apply = sorted((-c, " ".join(r)) for r, c in got.items() if set(r) <= parts(u))
        assert out[i].rejected == bool(apply) and out[i].n_rules == len(apply) and (not apply or out[i].confidence == -apply[0][0])


def test_url_rules_of_many_tokens(spark):
    """Tokens that are bad only all together make a rule of all of them, however many they are."""
    parts = "alpha beta gamma delta".split()
    urls, bad = [], {}
    for i in range(120):
        have = parts if i % 8 == 0 else [p for k, p in enumerate(parts) if k != i % 4]
        urls.append((i, "http://x.org/" + "/".join([*have, f"twin{i % 3}", f"pair{i % 3}"])))
        bad[i] = int(i % 8 == 0)
    labelled = pages(spark, urls).select(urlrules.tokens(F.col("url")).alias("tokens"), F.col("page_id").isin([i for i in bad if bad[i]]).alias("bad"))
    got = {tuple(r.rule): r.confidence for r in urlrules.mine(labelled).collect()}
    assert got == rules_by_brute_force(urls, bad) and got[tuple(sorted(parts))] == 1


def test_url_rules_on_odd_tables(spark):
    urls, marks = url_corpus()
    odd = [(100, None), (101, ""), (102, "123/456"), (None, "http://casino.example.com"), (3, urls[3][1]), (103, "casino com " + "x" * 100_000)]
    out = urlrules.filter_urls(pages(spark, [*urls, *odd]), labels(spark, [*marks, (3, 1, 0), (None, 0, 1), (5, None, None), (77, 7, 7)])).collect()
    assert len(out) == 66 and {r.page_id: r.rejected for r in out if r.page_id and r.page_id > 99} == {100: False, 101: False, 102: False, 103: True}
    assert [r.rejected for r in out if r.page_id is None] == [True]
    assert urlrules.filter_urls(pages(spark, []), labels(spark, marks)).count() == 0
    assert not any(r.rejected for r in urlrules.filter_urls(pages(spark, urls), labels(spark, [])).collect())


# --- boosted trees and toxicity ----------------------------------------------------


def test_boosting_learns_and_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    margin = model.margins(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.97
    noisy = (rng.random(1000) < 1 / (1 + np.exp(-margin))).astype(float)
    knots = boosting.isotonic(margin, noisy)
    p = boosting.calibrated(knots, np.sort(margin))
    assert (np.diff(p) >= -1e-12).all() and abs(p.mean() - noisy.mean()) < 0.02
    assert boosting.fit(np.zeros((0, 5)), np.zeros(0)).margins(x).shape == (3000,)
    assert boosting.fit(np.zeros((9, 5)), np.zeros(9)).margins(x).max() < 0
    for scores, ys in (([3, 1, 2, 2], [1, 0, 1, 0]), ([1, 1, 1], [0, 1, 1])):
        _, ps = boosting.isotonic(np.array(scores, float), np.array(ys, float))
        assert (np.diff(ps) >= 0).all()


def features_by_brute_force(text):
    import re

    w = [x.lower() for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]
    hits = [i for i, x in enumerate(w) if x in toxicity.INSULTS]
    you = [i for i, x in enumerate(w) if x in toxicity.YOU]
    n = len(w)
    letters = sum(c.isascii() and c.isalpha() for c in text)
    return {
        "near_you": sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits) / (n + 5),
        "insult_density": len(hits) / (n + 5),
        "capitals": sum("A" <= c <= "Z" for c in text) / (letters + 50),
        "exclamations": text.count("!") / (n + 5),
        "mixed_words": sum(bool(re.search("[0-9]", x)) and bool(re.search("[a-z]", x)) for x in w) / (n + 5),
        "words": math.log1p(n),
    }


@pytest.mark.parametrize("text", ["You are such an IDIOT, du Idiot!", "nothing bad here", "", "été b2b, ça va? stupid one two three four five six seven you", "you", "moron"])
def test_toxicity_features_against_brute_force(text):
    (c,) = tv.chunks(pa.array(["pad you moron", text, "moron you"]))
    x = dict(zip(toxicity.FEATURES, toxicity.features(c, toxicity.Lexicon(np.zeros(0, np.uint64)))[1]))
    want = features_by_brute_force(text)
    assert {k: pytest.approx(x[k]) for k in want} == want


def test_obfuscated_insults_are_read():
    (c,) = tv.chunks(pa.array(["what an 1d10t", "what an id!ot", "st*pid s t u"]))
    x = toxicity.features(c, toxicity.Lexicon(np.zeros(0, np.uint64)))
    at = toxicity.FEATURES.index
    assert x[0, at("insult_density")] > 0 and x[1, at("insult_density")] > 0 and x[2, at("broken_words")] > 0


def toxic_corpus(n=1200):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(n):
        words = sentence(rng, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for k in rng.integers(0, 60, 6):
                words[k] = str(rng.choice(["vexqua", "vexjol", "idiot"])) + str(rng.choice(["", "s", "nim"]))
        rows.append((i, " ".join(words), "a"))
        if i % 4:
            marks.append((i, 1, int(toxic)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_corpus()
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), labels(spark, marks)).collect()}
    unseen = [i for i, _, _ in rows if i % 4 == 0]
    caught = [got[i].toxic for i in unseen if i % 6 == 0]
    spared = [not got[i].toxic for i in unseen if i % 6]
    assert np.mean(caught) > 0.95 and np.mean(spared) > 0.98
    assert np.mean([got[i].probability for i in unseen if i % 6 == 0]) > 0.8


def test_toxicity_on_odd_tables(spark):
    rows, marks = toxic_corpus(200)
    odd = [*rows, (6, rows[6][1], "a"), *odd_rows()]
    marked = labels(spark, [*marks, (None, 1, 1), (1, None, None), (2, 5, 5)])
    out = toxicity.toxicity(docs(spark, odd), marked).collect()
    assert len(out) == len(odd) and all(0 <= r.probability <= 1 for r in out)
    same = [r.probability for r in out if r.doc_id == 6]
    assert len(same) == 4 and len({round(p, 9) for p in same}) == 2
    none = toxicity.toxicity(docs(spark, odd_rows()), labels(spark, [])).collect()
    assert len(none) == 9 and not any(r.toxic for r in none)
    assert toxicity.toxicity(docs(spark, []), labels(spark, marks)).count() == 0


# --- quality -----------------------------------------------------------------------


def statistics_by_brute_force(text):
    import re

    words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)
    tokens = text.split()
    sign = set("|#*%$&~^<>{}[]\\`")
    shown = sum(not c.isspace() for c in text)
    lines = [x for x in text.split("\n") if x]
    seen, again = set(), 0
    for x in lines:
        again += len(x.encode()) if x in seen else 0
        seen.add(x)
    letters = sum(c.isascii() and c.isalpha() for c in text)
    return [
        (sum(map(len, words)) + 100) / (len(words) + 20),
        sum(c in sign for c in text) / (shown + 50),
        (sum("A" <= c <= "Z" for c in text) + 3) / (letters + 100),
        text.count("!") / (len(tokens) + 10),
        (sum(c in ".," for c in text) + 2) / (len(tokens) + 12),
        sum(a.lower() == b.lower() for a, b in zip(words, words[1:])) / (len(words) + 10),
        again / (len(text.encode()) + 600),
        sum(any(c in sign for c in x) for x in tokens) / (len(tokens) + 10),
    ]


def test_rule_statistics_against_brute_force():
    texts = ["Plain words, and more.", "", "WHAT!! | a%% b\nsame line\nsame line\nthe The the", "été à ö ###", "x" * 3000, "one\n\n\none"]
    (c,) = tv.chunks(pa.array(texts))
    assert np.allclose(quality.statistics(c), [statistics_by_brute_force(t) for t in texts])


def test_forest_paths_against_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    f = quality.grow(x, 20, 64)

    def path(t, row):
        at = 0
        while f.feature[t, at] >= 0:
            at = f.child[t, at] + (row[f.feature[t, at]] >= f.split[t, at])
        return f.length[t, at]

    want = [2 ** -(np.mean([path(t, r) for t in range(20)]) / f.norm) for r in x[:40]]
    assert np.allclose(f.scores(x[:40]), want)
    assert f.scores(np.full((1, 4), 9.0))[0] > np.quantile(f.scores(x), 0.95)
    assert quality.grow(np.zeros((1, 4)), 3, 8).scores(x).shape == (500,)
    assert quality.grow(np.ones((50, 4)), 3, 8).scores(np.ones((2, 4))).tolist() == pytest.approx([quality.grow(np.ones((50, 4)), 3, 8).scores(np.ones((1, 4)))[0]] * 2)


def quality_corpus(n=600):
    rng = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(n):
        text = ". ".join(sentence(rng, 9).capitalize() for _ in range(6)) + "."
        if i % 20 == 0:
            part = int(rng.integers(100, 300))
            text = text[:part].upper().replace(" ", "!! ") + text[part:] if i % 40 else text[:part].replace(" ", "%%% ") + text[part:]
        rows.append((i, text, "a"))
        if i % 3:
            marks.append((i, int(i % 20 != 0), 0))
    return rows, marks


def test_quality_on_held_out_rows(spark):
    rows, marks = quality_corpus()
    got = {r.doc_id: r.kept for r in quality.quality_scores(docs(spark, rows), labels(spark, marks)).collect()}
    unseen = range(0, 600, 3)
    assert np.mean([not got[i] for i in unseen if i % 20 == 0]) > 0.95 and np.mean([got[i] for i in unseen if i % 20]) > 0.95
    kept = quality.drop_anomalous(docs(spark, rows), labels(spark, marks))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in got.items() if k) and kept.columns == docs(spark, rows).columns


def test_threshold_is_the_best_allowed(spark):
    rows, marks = quality_corpus()
    d, known = docs(spark, rows), labels(spark, marks)
    forest, threshold = quality.fit(materialise(quality.rule_statistics(d), "t"), known)
    (c,) = tv.chunks(pa.array([t for _, t, _ in rows]), 1 << 30)
    score = forest.scores(quality.statistics(c))
    good, bad = (np.array([score[i] for i, q, _ in marks if q == k]) for k in (1, 0))
    gain = lambda t: (bad >= t).mean() - (good >= t).mean()
    allowed = [k / quality.SCORE_BINS for k in range(quality.SCORE_BINS + 1) if (good >= k / quality.SCORE_BINS).mean() <= quality.MAX_GOOD_LOSS]
    assert gain(threshold) == pytest.approx(max(map(gain, allowed))) and threshold in allowed


def test_quality_on_odd_tables(spark):
    out = quality.quality_scores(docs(spark, odd_rows()), labels(spark, [(6, 1, 0), (6, 0, 0), (None, 0, 0), (2, None, 1), (4, 9, 9)])).collect()
    assert len(out) == 9 and len({r.anomaly for r in out if r.doc_id == 6}) == 1
    assert all(r.kept for r in quality.quality_scores(docs(spark, odd_rows()), labels(spark, [])).collect())
    assert quality.quality_scores(docs(spark, []), labels(spark, [])).count() == 0
    assert quality.drop_anomalous(docs(spark, odd_rows()), labels(spark, [])).count() == 9
    assert quality.drop_anomalous(docs(spark, []), labels(spark, [])).count() == 0


# --- tokens -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return pieces.Pieces.load(pieces.default_model())


def test_encoding_is_the_library_s(vocab):
    import random

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    table, decoder = pieces.PrefixTable(vocab), pieces.Decoder(vocab)
    rnd = random.Random(2)
    parts = ["a", "b", "th", "ing", "  ", " ", "   ", "\n", "\t", "é", "ё", "中", "😀", "\r\n", "\x00", "&&", "|", "12", "The", "▁x", "      ", "'s", "-"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 22)))
        ids = np.frombuffer(table.encode(s), np.int32)
        assert ids.tolist() == model.encode(s)
        data, at = decoder.decode(ids, np.array([0, len(ids)]))
        assert bytes(data).decode() == s.replace("▁", " ") and at.tolist() == [0, len(data)]


def test_prefix_table_holds_the_last_tokens(vocab):
    """Each prefix's encoding, by merging, ends in the token the table finds for it."""
    table = pieces.PrefixTable(vocab)
    for w in ("▁tokenization", "▁untereinander", "ingenting", "aaaaaaaaab"):
        for end in range(1, len(w) + 1):
            assert table.encode_known(w[:end]) == table.merge(w[:end])


def test_decoding_in_blocks(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 3)
    table, decoder = pieces.PrefixTable(vocab), pieces.Decoder(vocab)
    texts = ["one two three", "", "éé 中", " lead"]
    ids = [np.frombuffer(table.encode(t), np.int32) for t in texts]
    data, at = decoder.decode(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(at, at[1:])] == texts


def test_word_memory_is_bounded(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 4)
    table = pieces.PrefixTable(vocab)
    text = "a\nb c\nd e f\ng h i j k l\nm n o p"
    assert table.encode(text) == pieces.PrefixTable(vocab).encode(text) and len(table.words) <= 4


def test_encoding_odd_tables(spark):
    d = docs(spark, odd_rows())
    out = pieces.encode_documents(d)
    assert out.columns == [*d.columns, "_tokens", "n_tokens", "decoded"]
    rows = {r.text: r for r in out.collect()}
    assert rows[None]["_tokens"] is None and rows[None].n_tokens is None and rows[None].decoded is None
    assert rows[""]["_tokens"] == [] and rows[""].n_tokens == 0 and rows[""].decoded == ""
    assert all(r.decoded == r.text and r.n_tokens == len(r["_tokens"]) for t, r in rows.items() if t is not None) and rows[LONG].n_tokens > 40_000
    assert out.count() == 9 and pieces.encode_documents(docs(spark, [])).count() == 0
    assert pieces.encode_documents(spark.createDataFrame([(1,)], "doc_id int")).first().tokens is None


# --- fingerprints -------------------------------------------------------------------


def test_entropy_and_features_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)).decode() for k, n in ((3, 300), (20, 400), (9, 64), (9, 63), (12, 100))]
    (c,) = tv.chunks(pa.array(texts), 1 << 30)
    k = fingerprints.entropy_classes(c.buf, c.offsets)
    for a, b in zip(c.offsets, c.offsets[1:]):
        for i in range(a, b):
            if i + 64 > b:
                assert k[i] == -1
                continue
            p = np.bincount(c.buf[i : i + 64]) / 64
            h = -sum(x * math.log2(x) for x in p if x)
            assert abs(k[i] - h / 6 * 1024) <= 1.01
    counts = np.bincount(k[k >= 0], minlength=fingerprints.CLASSES)
    ranks = fingerprints.class_ranks(counts)
    assert ranks[counts == 0].max() == 0 and ranks[int(np.argmax(counts))] == ranks.max()
    want = []
    for a, b in zip(c.offsets, c.offsets[1:]):
        n = max(0, b - a - 63)
        usable = [(ranks[k[a + i]], i) if ranks[k[a + i]] else (10**9, i) for i in range(n)]
        votes = [0] * n
        for s in range(n - 63):
            best = min(usable[s : s + 64])
            if best[0] < 10**9:
                votes[best[1]] += 1
        chosen = {i for i in range(n) if votes[i] >= fingerprints.POPULARITY}
        if 0 < n < 64 + fingerprints.POPULARITY - 1 and min(usable)[0] < 10**9:
            chosen.add(min(usable)[1])
        want += sorted(a + i for i in chosen)
    assert fingerprints.select(c.buf, c.offsets, ranks).tolist() == want


def test_overlap_against_bit_sets():
    rng = np.random.default_rng(2)
    a, b = (np.packbits(rng.random((3, 2048)) < p, axis=1) for p in (0.2, 0.3))
    b[0] = a[0] | b[0]
    got = fingerprints.overlap_scores(a[:, None], b[None])
    for i in range(3):
        for j in range(3):
            x, y = (set(np.flatnonzero(np.unpackbits(f))) for f in (a[i], b[j]))
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            sd = math.sqrt(chance * (1 - len(x) / 2048) * (1 - len(y) / 2048))
            cut = chance + max(0.3 * (most - chance), 3 * sd)
            want = min(1, max(0, (len(x & y) - cut) / (most - cut))) if most > cut else 0
            assert got[i, j] == pytest.approx(want, abs=1e-4)
    assert got[0, 0] == pytest.approx(1) and got[1, 1] == 0


def fingerprint_corpus():
    rng = np.random.default_rng(6)
    items = [(i, sentence(rng, 90)) for i in range(8)]
    rows = [(i, f"{sentence(rng, 40)} {items[i % 8][1]} {sentence(rng, 500 if i % 3 else 60)}" if i % 2 else sentence(rng, 200), "a") for i in range(40)]
    return items, rows


def test_every_document_against_every_item(spark):
    items, rows = fingerprint_corpus()
    known = spark.createDataFrame(items, "item_id bigint, text string")
    d = docs(spark, rows)
    got = {r.doc_id: r for r in fingerprints.fingerprints(d, known).collect()}
    ranks = fingerprints.class_ranks(fingerprints.entropy_counts(d))

    features = []

    def digest(text):
        (c,) = tv.chunks(pa.array([text]))
        packed, count, _, h = fingerprints.digests(c, ranks)
        features.append(set(h.tolist()))
        return packed, count

    for i, text, _ in rows:
        own = digest(text)
        assert got[i].digest == own[0].tobytes() and got[i].n_features == own[1].sum() and got[i].n_filters == len(own[1])
        mine = features[-1]
        want = sorted((-round(fingerprints.compare(*own, *digest(t)), 6), item) for item, t in items if [digest(t)] and mine & features[-1])
        want = [(item, -score) for score, item in want if score]
        assert [m.item_id for m in got[i].matches] == [item for item, _ in want]
        assert [m.similarity for m in got[i].matches] == pytest.approx([s for _, s in want], abs=2e-6)
        assert (got[i].item_id, got[i].similarity) == ((want[0][0], pytest.approx(want[0][1], abs=2e-6)) if want else (None, 0))
    assert all(got[i].item_id == i % 8 and got[i].similarity > 0.5 for i in range(1, 40, 2))
    assert all(got[i].similarity < 0.3 for i in range(0, 40, 2))


def test_every_item_of_a_document_is_found_whole_or_in_parts(spark, monkeypatch):
    """A document of three items has all three; a reference set past the bound gives the same in parts."""
    items, rows = fingerprint_corpus()
    rows += [(100, " ".join(t for _, t in items[:3]), "a"), (101, items[0][1][:90], "a"), (None, items[2][1], "a"), (None, items[3][1], "a"), (102, items[4][1], "a"), (102, items[4][1], "a")]
    known = spark.createDataFrame([*items, (50, items[1][1][10:100]), (None, "x"), (51, None)], "item_id bigint, text string")
    tables = []
    for bound in (fingerprints.REFERENCE_ROWS, 3):
        monkeypatch.setattr(fingerprints, "REFERENCE_ROWS", bound)
        tables.append(sorted(collect(fingerprints.fingerprints(docs(spark, rows), known)), key=str))
    assert tables[0] == tables[1]
    got = {r[0]: [m.item_id for m in r[6]] for r in tables[0]}
    assert {0, 1, 2, 50} <= set(got[100]) and got[102] == [4] and got[101] == [0]


def test_short_items_and_short_documents_are_found(spark):
    rng = np.random.default_rng(8)
    cut = lambda n: sentence(rng, n)[:n]
    items = [(n, cut(n)) for n in (64, 65, 70, 81, 100, 127, 133, 180, 229)] + [(900, sentence(rng, 90))]
    rows = [(i, f"{sentence(rng, 70)} {t} {sentence(rng, 300)}", "a") for i, t in items] + [(1000 + i, t, "a") for i, t in items]
    rows += [(2000, items[-1][1][200:290], "a"), (2001, sentence(rng, 300), "a"), (2002, cut(90), "a"), (2003, items[5][1][:63] + " " + cut(90), "a")]
    known = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, rows), known).collect()}
    assert all(got[i].item_id == got[1000 + i].item_id == i for i, _ in items)
    assert all(got[i].similarity == got[1000 + i].similarity == 1 for i, _ in items if got[1000 + i].n_features < fingerprints.LEAST_FEATURES)
    assert sum(got[1000 + i].n_features == 1 for i, _ in items) >= 6
    assert (got[2000].item_id, got[2000].similarity) == (900, 1) and all(got[i].similarity == 0 for i in (2001, 2002, 2003))


def test_fingerprints_on_odd_tables(spark):
    known = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "short")], "item_id bigint, text string")
    out = fingerprints.fingerprints(docs(spark, odd_rows()), known).collect()
    assert len(out) == 9 and all(r.item_id is None and r.similarity == 0 for r in out)
    assert {r.n_filters for r in out if r.doc_id in (1, 2, 3, 7)} == {0} and all(r.digest == b"" for r in out if r.doc_id == 1)
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    assert len({r.digest for r in out if r.doc_id == 6}) == 1


# --- the pipeline --------------------------------------------------------------------


def test_helpers(spark):
    df = spark.createDataFrame([("7", "x")], "DOC_ID string, other string")
    assert collect(df.select(*pick(df, doc_id="doc_id", text="text"))) == [(7, None)]


@pytest.mark.parametrize("n", [0, 7, 900, 5000])
def test_least_hashed_rows_are_the_least(spark, n):
    df = spark.range(3000).withColumn("h", F.xxhash64("id"))
    got = [r.h for r in least_hashed(df, F.col("h"), n).collect()]
    assert got == sorted(r.h for r in df.collect())[:n]


@pytest.mark.parametrize("n", [1, 500, 2001, 21_999, 22_000, 30_000])
@pytest.mark.parametrize("hot", [5, 1999])
def test_least_hashed_of_repeated_rows(spark, n, hot):
    """2,000 distinct rows and 20,000 repeats of one of them, null doc_ids and equal texts alike."""
    df = spark.range(2000).union(spark.range(20_000).select(F.lit(hot).cast("bigint"))).select(F.when(F.col("id") != hot, F.col("id")).alias("id"), F.xxhash64("id").alias("h"))
    got = least_hashed(df, F.col("h"), n)
    assert got.columns == df.columns and sorted(r.h for r in got.collect()) == sorted(r.h for r in df.collect())[:n]


def test_least_hashed_of_few_hashes(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 - 1).alias("h"))
    for n in (0, 1, 333, 334, 700, 1000):
        assert sorted(r.h for r in least_hashed(df, F.col("h"), n).collect()) == sorted(r.h for r in df.collect())[:n]


def test_intermediate_tables(spark, tmp_path):
    from palisade.llm.common import _CLEANUP, release

    before = spark.conf.get(_CLEANUP, None)
    t = materialise(spark.range(3), "t")
    assert spark.conf.get(_CLEANUP, None) == before and t.count() == 3
    from urllib.parse import urlparse

    import os

    assert os.path.isdir(urlparse(t._written).path)
    release(t)
    assert not os.path.exists(urlparse(t._written).path)

def test_pipeline_stages_against_brute_force(spark):
    import hashlib

    import corpus_pipeline as cp

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    source = {r.doc_id: r for r in d.collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "mixing", "sentencepiece"]
    seen = []
    for name, stage in cp.STAGES:
        d = materialise(stage(spark, d, DATA), "test")
        seen.append(d.collect())
        if name != "sentencepiece":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, lines, once, mixed, last = seen
    scores = quality.quality_scores(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in scores.where("kept").collect())
    assert all(r.text == source[r.doc_id].text for r in good)
    from tests.llm.test_documents import lines_by_brute_force

    want = {i: t for i, t, _ in lines_by_brute_force([(r.doc_id, r.text, r.source) for r in good], 10)}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    assert {r.doc_id for r in once} <= {r.doc_id for r in lines} and len({r.doc_id for r in once}) == len(once)
    assert len({hashlib.md5(r.text.lower().encode()).digest() for r in once if r.text.strip()}) == len([r for r in once if r.text.strip()])
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in once}
    assert len(last) == len(mixed) and all(r.decoded == r.text and r.n_tokens == len(r.tokens) for r in last)
    assert sorted(r.doc_id for r in cp.run(spark, DATA).collect()) == sorted(r.doc_id for r in last)


def test_every_operator_is_registered_once():
    import __spark_entry__ as e

    ops = sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op"))
    assert ops == list(range(1, 11)) and "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert json.dumps(sorted(e.oracle_sql()))
