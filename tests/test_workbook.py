"""Workbooks and logical tables: round trips, odd cells, headers."""

import zipfile

import pytest

from tarnwick.sources import readers, workbook, writers


def test_cells_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b&\x01_x0041_ \"q\"", 2.5, True), (2, None, None, None), (3, "  é\n漢 ", 1e300, False), (4, "", -0.125, True)], "i int, s string, d double, b boolean")
    empty = df.where("i > 9")
    names = workbook.write_workbook({"All: of [it]": df, "all_ of _it_": df.select("s"), "n" * 40: empty, "N" * 40: df.select("d")}, f"{tmp_path}/x.xlsx", note="nothing here")
    assert names == ["All_ of _it_", "all_ of _it__2", "n" * 31, "N" * 29 + "_2"]
    assert workbook.sheet_names((tmp_path / "x.xlsx").read_bytes()) == names
    got = workbook.read_workbook(spark, f"{tmp_path}/x.xlsx", names[0])
    assert got.dtypes == [(c, "string") for c in "isdb"]
    assert [tuple(r) for r in got.collect()] == [("1", "a<b&\x01_x0041_ \"q\"", "2.5", "True"), ("2", None, None, None), ("3", "  é\n漢 ", "1e+300", "False"), ("4", None, "-0.125", "True")]
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/x.xlsx", sheet=0).select("i", "d").collect()] == [(1, 2.5), (2, None), (3, 1e300), (4, -0.125)]
    assert [tuple(r) for r in workbook.read_workbook(spark, f"{tmp_path}/x.xlsx", 2).collect()] == [("nothing here",)]
    with pytest.raises(ValueError, match="no sheet"):
        workbook.read_workbook(spark, f"{tmp_path}/x.xlsx", "other")


def test_skips_comments_and_dropped_rows(spark, tmp_path):
    rows = [("Table 2",), (None,), ("# a remark", "x"), ("gene", "value", "value", None), ("units", "min", "min", "-"), ("A", "1 # odd", "2", "3"), (None, None, None, None), ("B", "NA", "4", None)]
    df = spark.createDataFrame([(i, *(tuple(r) + (None,) * 4)[:4]) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string").orderBy("i").drop("i")
    workbook.write_workbook({"Table 2": df}, f"{tmp_path}/t.xlsx")
    got = readers.read_sheet(spark, f"{tmp_path}/t.xlsx", "Table 2", skip=2, comment="#", drop=1)
    assert got.columns == ["gene", "value", "value.1", "Unnamed: 3"]
    assert [tuple(r) for r in got.collect()] == [("A", "1 ", None, None), ("B", None, "4", None)]


def test_shared_strings_gaps_and_kinds(spark, tmp_path):
    """Parts as spreadsheet programs write them: shared and rich strings, gaps, formulas, errors, absolute targets."""
    main = f'xmlns="{workbook.MAIN}"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{workbook.LINKS}"><sheets><sheet name="S" sheetId="7" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}"><Relationship Id="rId9" Type="w" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>third</t></is></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><f>1+1</f><v>2.0</v></c><c r="C4" t="e"><v>#DIV/0!</v></c></row><row r="5"><c r="C5" t="str"><v>formula</v></c></row></sheetData></worksheet>')
    got = workbook.read_workbook(spark, f"{tmp_path}/s.xlsx", "S")
    assert got.columns == ["name", "Unnamed: 1", "third"] and [tuple(r) for r in got.collect()] == [("rich", "2", None), (None, None, "formula")]


def test_many_workbooks_and_limits(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    for n in (1, 2):
        workbook.write_workbook({"S": df}, f"{tmp_path}/many/{n}.xlsx")
    assert workbook.read_workbook(spark, f"{tmp_path}/many").count() == 2
    workbook.write_workbook({"S": df.withColumnRenamed("s", "t")}, f"{tmp_path}/many/3.xlsx")
    with pytest.raises(Exception, match="instead of"):
        workbook.read_workbook(spark, f"{tmp_path}/many").collect()
    with pytest.raises(ValueError, match="rows"):
        workbook.write_workbook({"S": spark.range(5).toDF("i")}, f"{tmp_path}/no.xlsx", most=4)
    assert not (tmp_path / "no.xlsx").exists()


def test_ontology_report(spark, tmp_path):
    full = spark.createDataFrame([("t1", "BP"), ("t2", "MF"), ("t3", "BP")], "term string, namespace string")
    slim = full.where("namespace = 'MF'")
    sheets = workbook.ontology_sheets(full, slim, "GO full", "GO slim")
    assert {k: v.count() for k, v in sheets.items()} == {"GO full": 3, "GO slim": 1, "BP": 2, "MF": 1, "Slim MF": 1}
    empty = workbook.ontology_sheets(full.where("term = ''"), slim.where("term = ''"), "GO full", "GO slim")
    workbook.write_workbook(empty, f"{tmp_path}/o.xlsx", note="no significant terms")
    assert [tuple(r) for r in readers.read_sheet(spark, f"{tmp_path}/o.xlsx").collect()] == [("no significant terms",)]


def test_logical_names_index_and_series(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1, 2, 3), ("g2", 4, 5, 6)], "Gene_id string, a int, b int, c int").toDF("Gene_id", "x", "y", "x")
    writers.write_parquet(df, f"{tmp_path}/t", index=["Gene_id"])
    got = readers.read_parquet(spark, f"{tmp_path}/t")
    assert got.names == ("Gene_id", "x", "y", "x") and got.frame().columns == ["Gene_id", "x", "y", "x"] and got.index == ("Gene_id",) and not got.series
    assert sorted(map(tuple, got.df.select(*got.columns("x")).collect())) == [(1, 3), (4, 6)] and got.values().columns == ["x", "y", "x__dup1"]
    # What is read and written again keeps its form.
    writers.write_parquet(got.frame(), f"{tmp_path}/u", index=list(got.index))
    assert readers.read_parquet(spark, f"{tmp_path}/u").names == got.names
    one = df.select("Gene_id", "y")
    writers.write_parquet(one, f"{tmp_path}/s", index=["Gene_id"], series=True)
    writers.write_parquet(one, f"{tmp_path}/n", index=["Gene_id"], series=True, named=False)
    assert [(r.series, r.series_name) for r in (readers.read_parquet(spark, f"{tmp_path}/{p}") for p in "sn")] == [(True, "y"), (True, None)]
    one.write.parquet(f"{tmp_path}/plain")
    assert readers.read_parquet(spark, f"{tmp_path}/plain").names == ("Gene_id", "y")
    with pytest.raises(ValueError):
        writers.write_parquet(df.select("Gene_id", "y"), f"{tmp_path}/e", series=True)
    with pytest.raises(ValueError):
        writers.write_parquet(one, f"{tmp_path}/e", index=["nope"])
