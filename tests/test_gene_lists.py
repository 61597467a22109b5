from tarnwick.operators import ontology


def test_a_large_group_is_glued_range_by_range(spark):
    genes = spark.range(20_000).selectExpr("id as gene", "'all' as term").union(spark.range(0, 20_000, 7).selectExpr("id", "'some'")).union(spark.sql("select 5L, 'one'"))
    listed = ontology.gene_lists(genes, spark.range(20_000).select("id").toDF("gene"), ["term"], "items")
    got = {r.term: r["items"] for r in listed.collect()}
    want = {"all": range(20_000), "some": range(0, 20_000, 7), "one": [5]}
    assert got == {k: ",".join(sorted(map(str, v))) for k, v in want.items()}
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in plan and plan.count("collect_list") == 2
