"""Each stage of the corpus pipeline against a plain version, and on odd tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarnwick.llm import mixing, packing, quality_model, quality_rules
from tarnwick.llm.statistics import describe

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_near_dedup(rows):
    """Smallest id of each component of texts linked at a Jaccard similarity of 0.8 or more, by all pairs."""
    texts = sorted({t for _, t, _ in rows}, key=lambda t: t or "")
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, t, s in rows:
        group[find(texts.index(t))].append((i is None, i or 0, t or "", (i, t, s)))
    return Counter(min(x, key=lambda y: y[:3])[3] for x in group.values())


def test_every_stage_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, SF)
    fit = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert rows_of(kept) == Counter({r: n for r, n in rows_of(docs).items() if r[0] in fit})

    good = stages["quality_classifier"](spark, kept, SF)
    model = quality_model.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r: n for r, n in rows_of(kept).items() if model.score(np.array([describe(r[1])]))[0] >= 0.3}
    assert rows_of(good) == Counter(want)

    one = stages["simhash_near_dedup"](spark, good, SF)
    assert rows_of(one) == plain_near_dedup(list(rows_of(good).elements()))

    mixed = stages["mixing"](spark, one, SF)
    texts = {r[0]: r for r in rows_of(one)}
    passes = Counter()
    for r in mixing.mix(one).collect():
        first, second = min(r.size, r.taken), max(0, r.taken - r.size)
        passes[texts[r.doc_id]] += (2 * first >= r.size) + (2 * second >= r.size)
    assert rows_of(mixed) == +passes

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    pieces = Counter()
    for r, n in rows_of(mixed).items():
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 1]
        for p, lo in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[lo : lo + 4096], "<u4")
            pieces[r[0], p, lo, len(part), zlib.crc32(part.tobytes())] += n
    packed = pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(1, "A text of some words that say nothing much at all to anybody.", 5), (1, "Other words that stand under the same id, and these are quite different.", 6), (None, "A text without an id that has words enough to be kept by rules.", 7)], "doc_id long, text string, taken long")
    for table in (odd_docs, no_docs, extra):
        table = table if "source" in table.columns else table.selectExpr("*", "'s' as source", "1 as position", "2 as node", "3 as posterior", "4 as kept", "5 as size")
        docs = table
        for name, stage in pipeline.STAGES[:-1]:
            own, docs = stage(spark, table, SF), stage(spark, docs, SF)
            assert own.schema.names == docs.schema.names == table.schema.names, name
            assert own.count() <= 2 * table.count() and docs.count() <= 2 * table.count(), name
            if name != "mixing":
                assert not rows_of(docs) - rows_of(table) and not rows_of(own) - rows_of(table), name
        assert pipeline.STAGES[-1][1](spark, table, SF).count() >= table.count()
    assert pipeline.STAGES[0][1](spark, extra.selectExpr("*", "'s' as source"), SF).count() == 3
    assert pipeline.STAGES[2][1](spark, extra.selectExpr("*", "'s' as source"), SF).count() == 3


def test_two_texts_of_shared_ids_keep_a_copy_each(spark):
    a, b = "one text of some ten words that stands here alone", "quite another text with other words that nobody has seen"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in pipeline.STAGES[2][1](spark, docs, SF).collect()]
    assert sorted(kept) == [(1, a), (2, b)]
