"""The three exact searches against plain versions that compare everything with everything."""

import math
import re

import numpy as np
import pytest

from tarnwick.llm import block_topk, hard_negatives, regions, treaps

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def whole(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    most = min(math.isqrt((2**63 - 2**11) // max(len(v), 1)), 2**31 - 1)
    return tuple(math.floor(max(-most, min(most, float(np.float32(x)) * scale))) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_top_k(rows, k, every):
    have = {(r[0], whole(r[1])) for r in rows if r[0] is not None and whole(r[1]) is not None}
    out = []
    for i, q in have:
        if i % every == 0:
            best = sorted(((-dot(q, v), j) for j, v in have if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def plain_negatives(rows, every, positives=5, negatives=10):
    have = {(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], whole(r[1])) for r in rows if r[0] is not None and r[2] is not None and whole(r[1]) is not None}
    out = []
    for i, label, q in have:
        if i % every:
            continue
        best = sorted((-dot(q, v), j) for j, other, v in have if j != i and other == label)[:positives]
        for s, p in best:
            window = sorted((-dot(q, v), j) for j, other, v in have if j != i and other != label and 30 * -s <= 100 * dot(q, v) <= 90 * -s)
            out += [(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(window[:negatives])]
    return sorted(out)


def clusters(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, width))
    labels = rng.integers(0, 6, n)
    return [(i, [float(np.float32(x)) for x in centres[c] + rng.normal(0, spread, width)], int(c), "s", 1) for i, c in enumerate(labels.tolist())]


def odd_rows():
    rows = clusters(300, 5, 4)
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 0.125], i % 3, None, None) for i in range(200)]  # one very common vector
    rows += [(2000 + i, [0.0] * 5, i % 2, None, None) for i in range(30)]
    rows += [rows[0], rows[40], (60, rows[61][1], 1, "x", 2), (3000, None, 1, None, None), (3001, [None, 1.0, 0.0, 0.0, 0.0], 1, None, None),
             (3002, [float("nan"), 1.0, 0.0, 0.0, 0.0], 1, None, None), (3003, [float("inf"), 1.0, 0.0, 0.0, 0.0], 1, None, None), (None, [1.0] * 5, 1, None, None), (3100, [1.0] * 5, None, None, None)]
    return rows


@pytest.mark.parametrize("region_rows,query_rows,block_rows", [(8192, 4096, 64), (40, 7, 4)])
def test_top_k_equals_comparing_all(spark, region_rows, query_rows, block_rows):
    rows = odd_rows()
    got = block_topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), every=20, region_rows=region_rows, query_rows=query_rows, block_rows=block_rows)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain_top_k(rows, 5, 20)


@pytest.mark.parametrize("region_rows,query_rows,leaf", [(8192, 4096, 32), (40, 7, 3)])
def test_hard_negatives_equal_comparing_all(spark, region_rows, query_rows, leaf):
    rows = odd_rows()
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=20, region_rows=region_rows, query_rows=query_rows, leaf=leaf)
    want = plain_negatives(rows, 20)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_searches_of_huge_few_and_no_vectors(spark):
    huge = [(i, [3e38 * (-1) ** (i // 10), 1e6 * i, 1e9], i % 2, None, None) for i in range(40)]
    table = spark.createDataFrame(huge, SCHEMA)
    assert sorted(map(tuple, block_topk.exact_top_k(table, every=10).collect())) == plain_top_k(huge, 5, 10)
    assert sorted(map(tuple, hard_negatives.hard_negatives(table, every=10).collect())) == plain_negatives(huge, 10)
    for rows in ([], [(50, [1.0, 2.0], 1, None, None)], [(50, None, 1, None, None)]):
        few = spark.createDataFrame(rows, SCHEMA)
        assert block_topk.exact_top_k(few).count() == 0 == hard_negatives.hard_negatives(few).count()
        assert block_topk.exact_top_k(few).columns == ["query_id", "rank", "vec_id", "score"]
    empty = [(0, [], 1, None, None), (1, [], 1, None, None), (2, [], 2, None, None)]
    bare = spark.createDataFrame(empty, SCHEMA)
    assert sorted(map(tuple, block_topk.exact_top_k(bare).collect())) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(bare).collect())) == plain_negatives(empty, 100) != []
    with pytest.raises(ValueError):
        block_topk.exact_top_k(spark.createDataFrame([(0, [1.0], 1, None, None), (1, [1.0, 2.0], 1, None, None)], SCHEMA))


def test_blocks_and_node_pairs_are_pruned():
    rows = clusters(4000, 8, 9, spread=0.03)
    x, labels = np.array([whole(r[1]) for r in rows]), np.array([r[2] for r in rows])
    blocks = block_topk.Blocks(x, [[r[0]] for r in rows])
    q = x[:50]
    row, who, score, _, met = blocks.search(q, 6, np.full(50, regions.LEAST))
    assert met < 0.5 * 50 * len(blocks.lo)
    assert score.reshape(50, 6).tolist() == [sorted((r @ x.T).tolist(), reverse=True)[:6] for r in q]
    held = hard_negatives.Candidates(x, [[r[0]] for r in rows], labels)
    anchors = hard_negatives.Tree(q, labels[:50], 8)
    leaves = sum(n[2] < 0 for n in held.nodes), sum(n[2] < 0 for n in anchors.nodes)
    _, _, _, pairs = held.search(anchors, 6, np.full((50, 1), regions.LEAST), np.full((50, 1), regions.MOST), True)
    assert pairs < 0.5 * leaves[0] * leaves[1]
    least, most = anchors.intervals(0, held, [0])
    assert least[0] <= (q @ x.T).min() and (q @ x.T).max() <= most[0]


def plain_ranked(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parsed = [(d, words(t)) for d, t in docs]
    big_n, big_l = sum(bool(w) for _, w in parsed), sum(len(w) for _, w in parsed)
    df = {}
    for _, w in parsed:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in {*items}:
        scored = []
        for place, (d, w) in enumerate(parsed):
            if not w:
                continue
            m = 50 + (50 * len(w) * big_n) // big_l
            s = 0
            for t in set(words(text)):
                if tf := w.count(t):
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, place))
        out += [(item, n + 1, None if none else d, -s) for n, (s, none, d, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_postings,item_rows,known_bytes", [(10**6, 256, 1 << 26), (150, 2, 1 << 26), (150, 2, 0)])
def test_ranked_search_equals_scoring_all(spark, odd_docs, shard_postings, item_rows, known_bytes):
    rng = np.random.default_rng(6)
    some = "alpha Beta gamma-delta x1 漢字 é ÉA the the the of of stone".split()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs += [(100 + i, " ".join(rng.choice(some, int(rng.integers(1, 40))))) for i in range(150)]
    docs += [(500 + i, "the same stone of alpha") for i in range(60)] + [(None, "the same stone of alpha"), (500, "alpha beta"), (900, "rare")]
    items = [(1, "Alpha beta BETA!"), (2, "the of stone"), (3, None), (4, ""), (5, "nowhere to be found 漢字"), (5, "x1 delta"), (6, "rare"), (6, "rare"), (None, "stone é")]
    table = spark.createDataFrame([(d, t, None, "s", 7, 1.0, None, None) for d, t in docs], odd_docs.schema)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    got = treaps.ranked_search(table, asked, k=20, shard_postings=shard_postings, item_rows=item_rows, known_bytes=known_bytes)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_ranked(docs, items, 20)


def test_ranked_search_of_nothing(spark, no_docs):
    asked = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert treaps.ranked_search(no_docs, asked).count() == 0
    assert treaps.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), asked.where("item_id > 1")).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_treaps_are_heaps_and_prune():
    rng = np.random.default_rng(3)
    n = 5000
    names = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(n)]
    made = treaps.Treaps(list(range(n)), np.arange(n), np.full(n, 100), names, [rng.integers(1, 9, 6) for _ in range(n)])
    for child, side in ((made.left, -1), (made.right, 1)):
        at = np.flatnonzero(child >= 0)
        assert (made.impact[at] >= made.impact[child[at]]).all() and (np.sign(made.doc[child[at]] - made.doc[at]) == side).all()
    *_, scored = made.search([np.array([1, 2])], [np.array([5000, 10])], 10, np.array([1]))
    assert scored < n / 2


def test_terms_of_long_texts_come_in_slices(monkeypatch):
    monkeypatch.setattr(treaps, "SLICE", 10)
    text = "Ünï Straße, a1b2 — ∑x! " * 9 + "z" * 40
    want = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.replace("S", "s"))
    assert [t.decode() for some in treaps.terms(text) for t in some] == want
    assert list(treaps.terms("")) == []
