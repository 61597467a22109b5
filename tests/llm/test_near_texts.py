import importlib
import random

import numpy as np
import pytest

from tarnwick.llm import near_texts


def plain_shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def planted(copies=60):
    """Texts, copies with some words changed (similarity 0.5 to 0.99), and chains of copies."""
    r = random.Random(3)
    texts = []
    for k in range(copies):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 120, 900]))]
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base) if k % 3 == 0 else texts[-1].split() if k % 3 == 1 else texts[0].split()
            for _ in range(max(1, int(len(base) * r.choice([0.002, 0.01, 0.02, 0.03])))):
                base[r.randrange(len(base))] = f"x{r.randrange(5000)}"
            texts.append(" ".join(base))
    return texts


def test_the_stage_keeps_one_of_each_group_of_similar_texts(spark):
    texts = planted()
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    want = sorted(set(root))
    assert len(want) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == want


def test_different_texts_with_one_id_or_none_stay(spark, odd_docs, no_docs):
    rows = [(1, "a text of some few words"), (1, "another one of quite other words"), (2, "A text  of some few words"), (None, "no id but words of its own"),
            (None, "a text of some few words"), (3, ""), (4, None), (1, "a text of some few words")]
    kept = near_texts.keep_one_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, rows[3][1]), (1, rows[0][1]), (1, rows[1][1]), (3, "")]
    out = near_texts.keep_one_text(odd_docs)
    assert out.columns == odd_docs.columns and out.where("doc_id is null").count() == 1
    assert near_texts.keep_one_text(no_docs).count() == 0


def mixed(groups=40, each=6, seed=8):
    """Texts of groups whose similarity is about the threshold, in one large bucket by a shared beginning."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for g in range(groups):
        own = list(base)
        for at in r.sample(range(150), 2 + g % 5):
            own[at] = f"g{g}x{at}"
        for _ in range(each):
            copy = list(own)
            copy[r.randrange(150)] = f"y{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def roots_by_all_pairs(texts, threshold=0.8):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and jaccard(sets[i], sets[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds,block,shingles", [(2, 2048, 1 << 21), (1, 2048, 1 << 21), (1, 7, 1 << 21), (1, 2048, 2000)])
def test_large_mixed_buckets_lose_no_link(spark, monkeypatch, rounds, block, shingles):
    """All pairs that a bucket leaves unlinked are met, in blocks by rows or by shingles."""
    texts = mixed()
    nodes = [np.int64(np.uint64(near_texts.node_of(t.encode())).view(np.int64)).item() for t in texts]
    rows = []
    for node, t in zip(nodes, texts, strict=True):
        s = near_texts.shingle_set(t.encode())
        least = near_texts.least_hashes(s)
        sketch = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).view(np.int8).tolist()
        rows.append((node, len(s), [1, 2], sketch, s.astype(np.uint32).view(np.int32).tolist()))
    table = spark.createDataFrame(rows, "node long, n int, bands array<long>, sketch array<tinyint>, s array<int>").cache()
    plain = near_texts._all_left
    monkeypatch.setattr(near_texts, "_all_left", lambda *a: plain(*a, block=block, shingles=shingles))
    monkeypatch.setattr(near_texts, "_shared", lambda dealt, threshold: near_texts.materialize(dealt, "shared"))
    found = {r.node: r.root for r in near_texts.links(table.drop("s"), lambda wanted: table.select("node", "s").join(wanted, "node", "left_semi"), rounds=rounds).collect()}
    want = roots_by_all_pairs(texts)
    groups = {}
    for node, r in zip(nodes, want, strict=True):
        groups.setdefault(r, set()).add(node)
    got = {}
    for node in nodes:
        got.setdefault(found.get(node, node), set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values())) and 1 < len(groups) < len(texts) / 2


def test_sets_of_two_blocks_link_as_those_of_one():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 10**6, 200)) for _ in range(8)]
    sets = [np.unique(np.r_[base[k % 8][rng.random(len(base[k % 8])) < 0.93], rng.integers(0, 10**6, 4)]).astype(np.uint32) for k in range(64)]
    root = np.arange(64) // 3

    def joined(links):
        up = root.copy()
        for i, j in links:
            up[up == up[j]] = up[i]
        return [min(np.flatnonzero(up == u)) for u in up]

    plain = [(i, j) for i in range(64) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    whole = near_texts.links_of_sets(sets, root, np.ones(64, bool), 0.8)
    assert joined(whole) == joined(plain) and len(whole) < len(plain)
    left, split = np.arange(64) < 20, []
    split += near_texts.links_of_sets(sets, root, left, 0.8)
    for at in (np.flatnonzero(left), np.flatnonzero(~left)):
        split += [(at[i], at[j]) for i, j in near_texts.links_of_sets([sets[k] for k in at], root[at], np.ones(len(at), bool), 0.8)]
    assert joined(split) == joined(plain)


def test_rows_that_need_their_sets_are_those_of_likely_pairs_of_the_band():
    rng = np.random.default_rng(2)
    sketch = np.repeat(rng.integers(0, 256, (10, 128), dtype=np.uint8), 6, axis=0)
    sketch[rng.random(sketch.shape) < 0.1] = 7
    keys = rng.integers(0, 3, (60, 4))
    keys[:, 2] = 5  # all share the bucket of band 2
    n, root = rng.integers(80, 120, 60), np.arange(60) // 4
    likely = lambda i, j: root[i] != root[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and (sketch[i] == sketch[j]).sum() >= near_texts._least_alike(0.8) and list(keys[i] == keys[j]).index(True) == 2
    left = np.arange(60) < 25
    for l, pairs in ((np.ones(60, bool), [(i, j) for i in range(60) for j in range(i)]), (left, [(i, j) for i in range(25) for j in range(25, 60)])):
        want = {k for i, j in pairs if likely(i, j) for k in (i, j)}
        assert set(np.flatnonzero(near_texts.likely_rows(n, root, l, sketch, keys, 2, 0.8)).tolist()) == want and want


def test_simhash_fingerprints_join_copies_by_themselves(spark, monkeypatch):
    """Texts within two bits are compared without any bucket of signatures, and only similar ones are joined."""
    from tarnwick.llm import simhash

    r = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(1500)]
        texts += [" ".join(base), " ".join(base[:-1] + ["changed"])]
    bits = [simhash.fingerprint_bytes(t.encode()) for t in texts]
    close = [k for k in range(0, 24, 2) if (bits[k] ^ bits[k + 1]).bit_count() <= 2]
    assert close
    monkeypatch.setattr(near_texts, "_shared", lambda dealt, threshold: near_texts.materialize(dealt.limit(0), "shared"))
    kept = near_texts.keep_one_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [k for k in range(24) if k - 1 not in close]
