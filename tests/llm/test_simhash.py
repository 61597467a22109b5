import random
import re

import numpy as np
import xxhash

from tarnwick.llm import simhash
from tarnwick.llm.graph import connected_components


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, radius=2):
    """{key: value} to the least key reachable, all pairs looked at."""
    keys = sorted(prints)
    root = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return root


def test_against_brute_force(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    roots = plain_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.fingerprint % (1 << 64) == prints[r.doc_id]
        assert r.component_id == roots[r.doc_id]


def test_links_of_planted_fingerprints(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:12]:
        for _ in range(6):
            values.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
            values.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    walk = base[20]
    for k in range(30):
        walk ^= 3 << (2 * k)
        values.add(walk)
    roots = plain_components({v: v for v in values})
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for bucket_rows in (4096, 2):
        found = {signed[x.node]: signed[x.root] for x in connected_components(simhash.links(df, bucket_rows=bucket_rows)).collect()}
        classes = {}
        for v in values:
            classes.setdefault(found.get(v, v), set()).add(v)
        wanted = {}
        for v in values:
            wanted.setdefault(roots[v], set()).add(v)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_sliced_pairs_find_each_pair_once():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 10, 300, dtype=np.uint64)
    bucket = np.sort(rng.integers(0, 3, 300))
    got = sorted((int(a), int(b)) for i, j in simhash.sliced_pairs(values, bucket, 2, step=100) for a, b in zip(i, j, strict=True))
    want = [(a, b) for a in range(300) for b in range(a + 1, 300) if bucket[a] == bucket[b] and int(values[a] ^ values[b]).bit_count() <= 2]
    assert got == want
