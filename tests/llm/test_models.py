import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwick.llm import langid, quality_model, toxicity, vptree
from tarnwick.llm.models import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.01"


def test_discriminant_equals_dense_formula():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (200, 14)), rng.normal(1, 2, (300, 14))]
    y = np.r_[np.zeros(200, int), np.ones(300, int)]
    model = quality_model.fit_discriminant(x, y, heat=1.0)
    z = (x - model.scale[0]) / model.scale[1]
    gap = np.zeros(len(x))
    for sign, g in ((1, model.high), (-1, model.low)):
        cov = g.factor @ g.factor.T
        d = z - g.mean
        gap += sign * (g.log_prior - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(gap, -60, 60))))
    assert quality_model.fit_discriminant(x[:5], np.ones(5, int)).score(x[:2]).tolist() == pytest.approx([5.5 / 6] * 2)


def held_out_accuracy(rows, labels):
    rows = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([r.predicted == labels[r.doc_id] for r in rows])


def test_quality_and_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.collect()
    q = quality_model.fit_quality(docs, labels)
    assert held_out_accuracy(quality_model.score_quality(docs, q).collect(), {r.doc_id: r.quality for r in known}) >= 0.95
    t = toxicity.fit_toxicity(docs, labels)
    assert held_out_accuracy(toxicity.score_toxicity(docs, t).collect(), {r.doc_id: r.toxic for r in known}) >= 0.9
    for score, model in ((quality_model.score_quality, q), (toxicity.score_toxicity, t)):
        rows = score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert score(no_docs, model).count() == 0
    assert quality_model.keep_good(odd_docs, q).columns == odd_docs.columns


def test_models_from_no_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.score_quality(odd_docs, quality_model.fit_quality(odd_docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(odd_docs, toxicity.fit_toxicity(odd_docs, none)).collect()} == {0.5}


def test_toxic_features():
    learned = {"lowei-": 3.0}
    calm, rude, hidden, foreign = (dict(zip(toxicity.FEATURES, toxicity.features(t, learned), strict=True)) for t in ("a calm text", "you IDIOT you", "what an 1d10t you are", "Der loweient kam"))
    assert calm["fixed_rate"] == 0 < rude["fixed_rate"] and rude["near_second_person"] == 0.5 and rude["capitals"] > 0.4
    assert hidden["obfuscated_hits"] > 0 and foreign["learned_top"] == 3.0


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert (((BoostedTrees().fit(x, y).raw(x)) > 0) == y).mean() > 0.97
    iso = Isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(iso(np.array([0, 2.5, 9]))) == sorted(iso(np.array([0, 2.5, 9]))) and iso(np.array([2.5]))[0] == pytest.approx(0.5)


def plain_kneser_ney(text_symbols):
    """Probability of a symbol after two others, straight from the definitions."""
    c3 = Counter(zip(text_symbols, text_symbols[1:], text_symbols[2:], strict=False))
    c2, c1 = Counter(), Counter()
    for _, b, c in c3:
        c2[b, c] += 1
    for _, c in c2:
        c1[c] += 1

    def d(counts):
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    d3, d2 = d(c3), d(c2)

    def p1(c):
        return 0.98 * c1[c] / sum(c1.values()) + 0.02 / (len(c1) + 1)

    def p2(b, c):
        total = sum(n for (x, _), n in c2.items() if x == b)
        return p1(c) if not total else max(c2[b, c] - d2, 0) / total + d2 * sum(x == b for x, _ in c2) / total * p1(c)

    def p3(a, b, c):
        total = sum(n for (x, y, _), n in c3.items() if (x, y) == (a, b))
        return p2(b, c) if not total else max(c3[a, b, c] - d3, 0) / total + d3 * sum((x, y) == (a, b) for x, y, _ in c3) / total * p2(b, c)

    return p3


def test_kneser_ney_equals_definition():
    flat, starts = langid.symbols_of(["the cat and the hat then a theory of catching", "Été 漢"])
    assert flat[0] == 0 and flat[starts[1] - 1] == 0 and starts[-1] == len(flat)
    keys = langid.trigrams(flat[: starts[1]])
    uniq, n = np.unique(keys, return_counts=True)
    model, plain = langid.KneserNey(uniq, n), plain_kneser_ney(flat[: starts[1]].tolist())
    letters = sorted(set(flat[2 : starts[1]].tolist())) + [0x6F22]
    for a in (0, *map(ord, "thcz"), 0x6F22):
        for b in (0, *map(ord, "heaz"), 0x6F22):
            probs = np.exp(-model.surprise(np.array([a << 42 | b << 21 | c for c in letters])))
            assert probs == pytest.approx([plain(a, b, c) for c in letters], rel=1e-4)
            assert probs.sum() == pytest.approx(1.0, abs=1e-4)


def test_languages_on_held_out_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs, model).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.98
    odd = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 14)] == ["und"] * 4 and odd[5].lang_pred == "en" and odd[0].rejected
    assert langid.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit_languages(no_docs)).collect()} == {"und"}
    texts = [r.text for r in odd_docs.collect()]
    h, n = model.entropies(texts)
    for k, t in enumerate(texts):
        alone, m = model.entropies([t])
        assert m[0] == n[k] and np.allclose(alone[0], h[k], atol=1e-6)


def test_languages_of_other_scripts(spark):
    """Languages that share a script but no spelling are told apart by letters at full width."""
    some = {
        "ru": "это был большой город у реки где люди жили и работали каждый день без отдыха и ждали весны",
        "uk": "це було велике місто біля річки де люди жили й працювали щодня без відпочинку і чекали весни її",
        "el": "ήταν μια μεγάλη πόλη κοντά στο ποτάμι όπου οι άνθρωποι ζούσαν και δούλευαν κάθε μέρα",
        "ja": "大きな町が川のそばにあり人々は毎日そこで働きながら春を待っていました",
        "zh": "河边有一座很大的城市人们每天在那里生活和工作等待着春天的到来没有休息",
    }
    rows = []
    for k, (lang, text) in enumerate(some.items()):
        parts = text.split() if " " in text else [text[i : i + 6] for i in range(0, len(text) - 5, 3)]
        for i in range(120):
            rows.append((1000 * k + i, " ".join(parts[(i * 7 + j * (1 + i % 5)) % len(parts)] for j in range(8)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit_languages(docs)).collect()
    want = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.held_out)


def test_nearest_equals_brute_force_when_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:400] = v[100]
    v *= rng.random((700, 1)).astype(np.float32) + 0.5
    v[100:400] = v[100]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(9000, None, "x"), (9020, [0.0] * 8, "x"), (9040, [math.nan] + [1.0] * 7, "x"), (9060, [None] + [1.0] * 7, "x"), (None, [1.0] * 8, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in vptree.nearest(table, relax=1.0, shard_rows=200, query_rows=15).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = v.astype(np.float64)
    for q in range(0, 700, 20):
        score = [(-sum(float(a) * float(b) for a, b in zip(x[q], x[j], strict=True)), j) for j in range(700) if j != q]
        want = [j for _, j in sorted(score)[:20]]
        assert [got[q][k][0] for k in range(1, 21)] == want
    assert set(got) == set(range(0, 700, 20))
    few = table.where("vec_id < 4")
    assert vptree.nearest(few).count() == 3
    assert vptree.nearest(table.where("vec_id < 0")).count() == 0


def test_recall_of_the_production_setting(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    found = {}
    for r in vptree.nearest(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(rows), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(found[rows[q].vec_id] & {rows[j].vec_id for j in np.argsort(-s)[:20]}) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_ties_go_to_smaller_ids(spark):
    """Thirty copies each of seven vectors: a cut inside a group of copies keeps its smaller ids."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(7, 16))
    rows = [(i, [float(x) for x in base[i % 7] * (1 if i % 14 < 7 else 0.5)]) for i in rng.permutation(420).tolist()]
    table = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in vptree.nearest(table, relax=1.0, shard_rows=90, query_rows=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    vectors = dict(rows)
    for q in range(0, 420, 20):
        score = {i: sum(a * b for a, b in zip(vectors[q], v, strict=True)) for i, v in vectors.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [v for _, v in sorted(got[q])] == want


def test_nearest_ties_between_different_vectors(spark):
    """All inner products of one-hot vectors are zero: the smaller ids are nearest, as factor one is exact."""
    rows = [(i, [float(i == d) for d in range(64)]) for i in range(64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard_rows in (8192, 16):
        got: dict[int, list] = {}
        for r in vptree.nearest(table, relax=1.0, shard_rows=shard_rows, query_rows=2).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {0, 20, 40, 60}
        for q, found in got.items():
            assert [(v, s) for _, v, s in sorted(found)] == [(i, 0.0) for i in range(64) if i != q][:20]


def test_nearest_of_repeated_ids_and_huge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (2, [3.0, 1.0]), (3, [1e200, -1e200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(table, k=3, relax=1.0).collect())
    assert got == sorted([(0, 1, 3, 1e200), (0, 2, 2, 3.0), (0, 3, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)])


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall_on_clustered_and_uniform_vectors(spark, kind):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16)) * 3
    x = (centres[rng.integers(0, 40, 4000)] if kind == "clustered" else 0) + rng.normal(size=(4000, 16))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, set] = {}
    for r in vptree.nearest(table, shard_rows=250).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(found[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(found) == 200 and np.mean(hits) >= 0.95


def test_toxic_features_of_any_length_and_script():
    """Capitals as str.isupper counts them at every length; obfuscated words of any length in linear time."""
    import time

    for text in ("SHOUT now", "ШУМ шум " * 3, "ШУМ шум " * 1000, "ΑΒΓ αβγ Łódź ÇA", "日本 ǅ ǈ", ""):
        assert toxicity.capitals(text) == sum(map(str.isupper, text))
    at = toxicity.FEATURES.index("obfuscated")
    assert toxicity.features("you i.d.i.o.t you", {})[at] == toxicity.features("you i.d.i.o.t you", {"x": 1.0})[at] > 0
    began = time.perf_counter()
    for word in ("a" + "1" * 1_000_000, "1" * 1_000_000 + "a", "a." * 500_000, "a" * 1_000_000, "!" * 1_000_000):
        toxicity.features(word, {})
    assert time.perf_counter() - began < 10
    assert toxicity.features("a.b" * 100_000, {})[at] > 0


def test_language_models_keep_every_trigram(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "".join(map(chr, rng.integers(0x4E00, 0x9F00, 90_000))), "zh") for k in range(14)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    taught = [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    want = np.unique(np.concatenate([langid.trigrams(langid.symbols_of([t])[0]) for t in taught]))
    assert len(want) > 500_000 and (model.models[0].triples.get(want, -1.0) > 0).all()
