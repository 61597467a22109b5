from pathlib import Path

from tarnwick.llm import licenses


def test_full_texts_are_known_however_wrapped(spark):
    rows, want = [], {}
    for path in sorted(licenses.FOLDER.glob("*.txt")):
        text = path.read_text("utf-8")
        for k, t in enumerate((text, text.replace("\n\n", "\n \n"), "Copyright Jane Doe\n" + text)):
            rows.append((f"{path.stem}/{k}", t))
            want[rows[-1][0]] = path.stem.removesuffix(".spdx")
    rows += [(f"mit/{k}", line + "\n\n" + licenses.TEXTS[0][1]) for k, line in enumerate(("Copyright Jane Doe", "Copyright by the Example Authors", "Copyright (c) 2020 A B"))]
    rows.append(("more", licenses.TEXTS[0][1] + "\nand more"))
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: got[k] for k in want} == want
    assert got["mit/0"] == got["mit/2"] == "MIT" and got["more"] is None
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(want.values())
    assert Path(licenses.FOLDER / "SPDX_IDS").exists()


def test_ordinary_notices_are_found(spark):
    want = {
        'Licensed under the Apache License, Version 2.0 (the "License");': ["Apache-2.0"],
        " * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0-or-later"],
        "// SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"],
        "# This file is licensed under the LGPL v2.1": ["LGPL-2.1"],
        "Released under the BSD 3-Clause License.": ["BSD-3-Clause"],
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */": ["MPL-2.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": ["CC-BY-SA-3.0"],
        "All files in this folder are released under the terms of the GNU Affero General Public License, version 3 or later.": ["AGPL-3.0-or-later"],
        "we talked about a licence yesterday": [],
    }
    docs = spark.createDataFrame([(i, f"before\n{t}\nafter") for i, t in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.notices for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_planted_texts_in_spark_and_sql(spark, tmp_path):
    """Whole licence texts among the documents: Spark and SQL find the same ones."""
    import duckdb

    planted = [(i, f"Copyright (c) 20{i:02d} Holder {i}\n\n" + text) for i, (_, text) in enumerate(licenses.TEXTS)]
    docs = spark.createDataFrame([*planted, (100, "a line\rCopyright (c) 2001 A\r\nprose"), (101, "prose"), (102, None)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.digest, r.license_id, ",".join(r.notices)) for r in licenses.scan_licenses(docs).collect())
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(licenses.scan_sql()).fetchall(), key=lambda r: r[0]) == rows
    assert [r[2] for r in rows[: len(planted)]] == [name for name, _ in licenses.TEXTS]


def test_a_table_of_known_texts(spark):
    table = spark.createDataFrame([("Own-1.0", "You may do as you like."), ("Own-2.0", "You may not.")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "  YOU may, do -- as you like\n"), (2, "You may not"), (3, "You may")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, table).collect()} == {1: "Own-1.0", 2: "Own-2.0", 3: None}


def test_line_ends_take_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "\r" * 1_000_000), (2, "licen\r" * 100_000), (3, "x" * 1_000_000), (4, "copyright " * 100_000)], "doc_id long, text string")
    began = time.perf_counter()
    assert licenses.scan_licenses(docs).count() == 4 and len(licenses.scan_licenses(docs).collect()) == 4
    assert time.perf_counter() - began < 60
