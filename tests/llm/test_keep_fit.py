from collections import Counter

from tarnwick.llm import quality_rules
from tests.llm.conftest import prose


def test_a_verdict_goes_to_its_own_text(spark):
    rows = [(i, prose(i, 80)) for i in range(40)]
    rows += [(None, prose(50, 90)), (None, "same " * 40), (1, "### " * 40), (2, prose(51, 70)), (3, "few words"), (4, None), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = {(r.doc_id, r.n_words): r.kept for r in quality_rules.judge(docs).collect()}
    assert verdicts[None, 90] and verdicts[2, 70] and not verdicts[1, 40] and not verdicts[None, 40]
    got = quality_rules.keep_fit(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r for r in rows if verdicts[r[0], len((r[1] or "").split())])
