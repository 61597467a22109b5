import re
from collections import Counter, defaultdict
from itertools import pairwise

import pytest

from tarnwick.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts(spark, odd_docs, no_docs):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = quality_rules.judge(odd_docs).collect()
    assert len(rows) == len(texts)
    want = {i: plain_measures(t) for i, t in texts}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert quality_rules.judge(no_docs).count() == 0
    assert quality_rules.keep_fit(odd_docs).columns == odd_docs.columns


def test_votes_single_out_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality_rules.judge(docs).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) >= 0.98 * len(rows)


def test_a_rule_that_misfires_loses_weight():
    rules = quality_rules.RULES[:2] + (quality_rules.Rule("coin", "false", "false", 0.5),)
    patterns = {(1, 1, 0): 450, (1, 1, 1): 450, (0, 0, 0): 50, (0, 0, 1): 50, (0, 1, 1): 3}
    model = quality_rules.fit_votes(patterns, rules)
    assert model.log_odds((1, 1, 0)) > 0 > model.log_odds((0, 0, 1))
    assert abs(model.log_odds((2, 2, 0)) - model.log_odds((2, 2, 1))) < 0.5


def plain_posteriors(votes, rules, prior, fit, unfit):
    """The posterior of each document from the definition, one document after another."""
    out = []
    for v in votes:
        f, u = prior, 1 - prior
        for r in range(len(rules)):
            f, u = f * fit[r][v[r]], u * unfit[r][v[r]]
        out.append(f / (f + u))
    return out


def test_estimates_are_a_fixed_point_over_single_documents():
    """One step over documents instead of pattern counts gives the fitted model back, and no estimate leaves (0, 1)."""
    import random

    r = random.Random(5)
    rules = quality_rules.RULES[:4]
    votes = []
    for _ in range(3000):
        good = r.random() < 0.8
        votes.append(tuple(r.choices((0, 1, 2), (0.01, 0.8, 0.19) if good else (0.6, 0.2, 0.2))[0] for _ in rules))
    model = quality_rules.fit_votes(dict(Counter(votes)), rules, rounds=2000, tolerance=1e-14)
    post = plain_posteriors(votes, rules, model.prior, model.fit, model.unfit)
    mass = sum(post)
    assert model.prior == pytest.approx((mass + 1) / 3002, abs=1e-5) and 0.75 < model.prior < 0.85
    for k, rule in enumerate(rules):
        a = rule.false_alarms
        for share, own, expected, trust in ((post, model.fit[k], (a, 0.8 - a, 0.2), 1.0), ([1 - x for x in post], model.unfit[k], (0.3, 0.4, 0.3), 0.5)):
            n = sum(share)
            want = [1 + trust * n * expected[v] + sum(x for x, w in zip(share, votes, strict=True) if w[k] == v) for v in range(3)]
            assert own == pytest.approx([x / sum(want) for x in want], abs=1e-5)
        assert 0 < model.fit[k][0] < 0.1 and model.fit[k][1] > model.unfit[k][1]


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [k for k in names if k not in full]
        level = left / sum(w[k] for k in open_) if open_ else 0
        over = [k for k in open_ if level * w[k] > most * sizes[k]]
        if not over:
            return full | {k: level * w[k] for k in open_}
        for k in over:
            full[k] = most * sizes[k]
            left -= full[k]


def test_mix_meets_targets(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = mixing.mix(docs).collect()
        sizes = defaultdict(int)
        for r in docs.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        targets = plain_targets(dict(sizes))
        taken = defaultdict(int)
        for r in rows:
            assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
            assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
            taken[r.source] += r.taken
        assert all(abs(taken[k] - targets[k]) <= 1 for k in targets)
        assert len(rows) == docs.count()
        places = [r.position for r in rows if r.position is not None]
        assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert mixing.mix(no_docs).count() == 0


def test_schedule_inverse(spark):
    from pyspark.sql import functions as F

    for schedule in mixing.SCHEDULES:
        pieces = mixing.integrated(schedule)
        for x in (0.0, 0.1, 0.37, 0.5, 0.8, 1.0):
            t = spark.range(1).select(mixing.inverse_demand(F.lit(x), schedule)).first()[0]
            t0, t1, w0, w1, before = next(p for p in pieces if p[0] <= t <= p[1])
            done = before + (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
            assert done == pytest.approx(x, abs=1e-9)


def asked_until(schedule, t):
    """Share of a schedule's integral up to ``t``, by small steps."""
    def weight(x):
        return next(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in pairwise(schedule) if x <= b[0])

    steps = [(k + 0.5) / 2000 for k in range(2000)]
    return sum(weight(x) for x in steps if x <= t) / sum(map(weight, steps))


def test_supply_follows_every_schedule(spark):
    """Up to any time, the passes that stand before it give each source's integrated demand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    names = sorted({r.source for r in rows})
    most = max(r.size for r in rows)
    for name in names:
        mine = [r for r in rows if r.source == name and r.taken]
        schedule = mixing.SCHEDULES[names.index(name) % 3]
        passes = []
        for r in mine:
            first = min(r.size, r.taken)
            passes += [(r.position, first)] + ([(r.position_2, r.taken - first)] if r.taken > first else [])
        assert all((r.position_2 is None) == (r.taken <= r.size) for r in mine)
        target = mine[0].target
        for t in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
            given = sum(n for p, n in passes if p < t)
            assert abs(given - target * asked_until(schedule, t)) <= most + 0.001 * target + 1


def test_apply_mix(spark, odd_docs, no_docs):
    """Rows come once for each pass of which half or more is taken, also with shared and missing ids."""
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want: Counter = Counter()
        for r in mixing.mix(docs).collect():
            first, second = min(r.size, r.taken), max(0, r.taken - r.size)
            want[r.doc_id, r.size] += 1 if r.size == 0 else (2 * first >= r.size) + (2 * second >= r.size)
        out = mixing.apply_mix(docs)
        got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in out.collect())
        assert got == +want and out.columns == docs.columns
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(r.doc_id, r.text) for r in out.collect()} <= texts
    assert mixing.apply_mix(no_docs).count() == 0


def test_the_mix_comes_in_training_order(spark):
    """The order is that of the exact positions, but for what interpolation inside a cell may move."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    at = {r.doc_id: [p for p in (r.position, r.position_2) if p is not None] for r in mixing.mix(docs).collect()}
    seen, places = Counter(), []
    for r in mixing.apply_mix(docs).collect():
        if at[r.doc_id]:
            places.append(at[r.doc_id][min(seen[r.doc_id], len(at[r.doc_id]) - 1)])
            seen[r.doc_id] += 1
    moved = [abs(a - b) for a, b in zip(places, sorted(places), strict=True)]
    assert sum(moved) / len(moved) < 0.06 and max(moved) < 0.3


def test_a_long_text_of_repeats_is_counted_in_full(spark):
    phrase = "one two three four five six "
    fresh = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, phrase * 40_000), (2, phrase * 2 + fresh), (3, fresh + " " + phrase + fresh[::-1] + " " + phrase)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs).collect()}
    assert got == {1: 240_000, 2: 12, 3: 12}
