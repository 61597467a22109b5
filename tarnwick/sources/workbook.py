"""Workbooks of zipped XML (xlsx), read and written without any engine for them.

A sheet's cells come as text; numbers keep their shortest form. A workbook is packed as a whole,
so it is one row of a ``binaryFile`` scan and one task; a folder of workbooks is read in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Longest name of a sheet, characters that it can't hold, and most rows and characters of a cell. Fixed values.
NAME_LENGTH, NOT_IN_NAMES, MOST_ROWS, MOST_CHARS = 31, r"[\[\]:*?/\\]", 1_048_576, 32_767
#: What is no character in XML, written as _xHHHH_ in workbooks.
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _text(node: ElementTree.Element) -> str:
    """The runs of a string, without the readings of phonetic guides."""
    found = []
    for child in node:
        tag = child.tag.rpartition("}")[2]
        if tag == "t":
            found.append(child.text or "")
        elif tag == "r":
            found += [t.text or "" for t in child.iter(f"{{{MAIN}}}t")]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(found))


def column_number(ref: str) -> int:
    """0 for A, 25 for Z, 26 for AA: the column of a reference such as AB12."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(text: str) -> str:
    """The shortest form of a number: 3 for 3.0, and what a double prints for others."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]


def sheet_rows(data: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of one sheet, by name or place, blank rows in between included; a missing cell is None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"))
        names = [s.get("name") for s in sheets]
        if isinstance(sheet, str) and sheet not in names or isinstance(sheet, int) and not 0 <= sheet < len(names):
            raise ValueError(f"no sheet {sheet!r}; there are {names}")
        link = sheets[names.index(sheet) if isinstance(sheet, str) else sheet].get(f"{{{LINKS}}}id")
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.iter(f"{{{PACKAGE}}}Relationship") if r.get("Id") == link)
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{{{MAIN}}}si":
                        shared.append(_text(node))
                        node.clear()
        at = 0
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                number = int(row.get("r", at + 1))
                while at < number - 1:
                    at += 1
                    yield []
                cells: list[str | None] = []
                for place, c in enumerate(row.iter(f"{{{MAIN}}}c")):
                    col = column_number(c.get("r")) if c.get("r") else place
                    cells += [None] * (col + 1 - len(cells))
                    kind, value = c.get("t", "n"), c.find(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        cells[col] = _text(c.find(f"{{{MAIN}}}is"))
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        cells[col] = shared[int(value.text)]
                    elif kind == "n":
                        cells[col] = _number(value.text)
                    elif kind == "b":
                        cells[col] = "True" if value.text == "1" else "False"
                    elif kind != "e":  # an error stands for no value
                        cells[col] = value.text
                at += 1
                yield cells
                row.clear()


def laid_out(rows: Iterator[list[str | None]], width: int, skip: set[int] | int = 0, comment: str | None = None, drop: int = 0, null: tuple[str, ...] = ("", "NA", "NaN", "nan", "null", "N/A", "#N/A")) -> tuple[list[str], Iterator[list[str | None]]]:
    """Header and rows of a sheet of ``width`` columns.

    ``skip`` first rows, or rows of these numbers, go; so do blank rows, and what follows a
    ``comment`` sign in a row, with rows that begin with it. ``drop`` rows after the header go.
    Equal names get .1, .2; a column without a name is Unnamed: n.
    """
    skipped = set(range(skip)) if isinstance(skip, int) else skip

    def kept():
        for i, row in enumerate(rows):
            if i in skipped:
                continue
            if comment:
                for j, cell in enumerate(row):
                    if cell is not None and comment in cell:
                        before = cell.split(comment)[0]
                        row = row[:j] + ([before] if before else [])
                        break
            if any(c is not None for c in row):
                yield row

    rest = kept()
    head, names, seen = next(rest, []), [], {}
    for i, name in enumerate((head + [None] * width)[: max(width, len(head))]):
        name = f"Unnamed: {i}" if name is None else name
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)

    def body():
        for n, row in enumerate(rest):
            if n >= drop:
                if len(row) > len(names):
                    raise ValueError(f"a row of {len(row)} cells below {len(names)} names")
                row = (row + [None] * len(names))[: len(names)]
                yield [None if c is None or c in null else c for c in row]

    return names, body()


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0, skip: int | set[int] = 0, comment: str | None = None, drop: int = 0) -> DataFrame:
    """One sheet of every workbook under ``path`` as text columns, from any file system that Spark reads.

    The header, and the number of columns, is that of the first file by name; files with another
    one raise. Rows keep the order that they have in their file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    first = files.orderBy("path").limit(1).select("content").collect()
    if not first:
        raise FileNotFoundError(f"no workbook at {path}")
    content = bytes(first[0].content)
    names, _ = laid_out(sheet_rows(content, sheet), max(map(len, sheet_rows(content, sheet)), default=0), skip, comment, drop)

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                own, body = laid_out(sheet_rows(bytes(content), sheet), len(names), skip, comment, drop)
                if own != names:
                    raise ValueError(f"a workbook with the columns {own} instead of {names}")
                part = []
                for row in body:
                    part.append(row)
                    if len(part) == 5000:
                        yield pd.DataFrame(part, columns=range(len(names)), dtype=object)
                        part = []
                yield pd.DataFrame(part, columns=range(len(names)), dtype=object)

    schema = ", ".join(f"`{str(i)}` string" for i in range(len(names)))
    return files.select("content").mapInPandas(rows, schema).toDF(*names)


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers or doubles where all their values are such; one pass over the rows."""
    if not df.columns:
        return df
    flat = df.toDF(*[str(i) for i in range(len(df.columns))])
    counts = [F.count(f).alias(f"{k}{c}") for c in flat.columns for k, f in (("n", F.col(c)), ("l", F.col(c).try_cast("long")), ("d", F.col(c).try_cast("double")))]
    s = flat.agg(*counts).first()
    kind = lambda c: "long" if s[f"n{c}"] and s[f"l{c}"] == s[f"n{c}"] else "double" if s[f"n{c}"] and s[f"d{c}"] == s[f"n{c}"] else "string"
    return flat.select(*[F.col(c).try_cast(kind(c)).alias(c) for c in flat.columns]).toDF(*df.columns)


def safe_names(names: list[str]) -> list[str]:
    """Names that sheets can have: at most 31 characters, none of them barred, no two alike but for case."""
    out: list[str] = []
    for name in names:
        base = re.sub(NOT_IN_NAMES, "_", str(name))[:NAME_LENGTH].strip("'") or "Sheet"
        chosen, n = base, 1
        while chosen.lower() in {x.lower() for x in out}:
            n += 1
            chosen = base[: NAME_LENGTH - len(str(n)) - 1] + f"_{n}"
        out.append(chosen)
    return out


def _cell(ref: str, value) -> str:
    import datetime
    import math
    from decimal import Decimal

    if value is None or isinstance(value, float) and not math.isfinite(value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float | Decimal):
        return f'<c r="{ref}"><v>{value}</v></c>'
    text = value.isoformat() if isinstance(value, datetime.date) else str(value)
    if len(text) > MOST_CHARS:
        raise ValueError(f"a cell of {len(text)} characters; a workbook holds {MOST_CHARS}")
    text = CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook_bytes(sheets: dict[str, tuple[list[str], Iterator]]) -> bytes:
    """A workbook of sheets (columns, rows), in their order, under names that are safe already."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>')
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write((head + f'<worksheet xmlns="{MAIN}"><sheetData>').encode())
                for r, row in enumerate(_rows_of(columns, rows), 1):
                    cells = "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row))
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _rows_of(columns: list[str], rows: Iterator) -> Iterator:
    yield columns
    yield from rows


def write_workbook(sheets: dict[str, DataFrame], path: str, note: str = "no rows", most: int = MOST_ROWS - 1) -> list[str]:
    """Write frames as the sheets of one workbook, on any file system that Spark writes; returns their names.

    A workbook is one file, so it is made on the driver, row by row; a frame of more than ``most``
    rows raises before anything is written. A frame without rows becomes a sheet with the one
    column ``note``. Names are made safe (``safe_names``); equal column names stay as they are.
    """
    if not sheets:
        raise ValueError("a workbook needs a sheet")
    names = safe_names(list(sheets))
    laid = {}
    for name, (title, df) in zip(names, sheets.items(), strict=True):
        if (n := df.limit(most + 1).count()) > most:
            raise ValueError(f"sheet {title!r} has over {most} rows")
        laid[name] = (df.columns, df.toLocalIterator()) if n else (["note"], iter([(note,)]))
    spark = next(iter(sheets.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(at, True)
    try:
        stream.write(workbook_bytes(laid))
    finally:
        stream.close()
    return names


def ontology_sheets(full: DataFrame, slim: DataFrame, full_label: str, slim_label: str, by: str = "namespace") -> dict[str, DataFrame]:
    """The sheets of an enrichment report: full and slim terms, then one for each namespace of either that has any."""
    out = {full_label: full, slim_label: slim}
    for prefix, df in (("", full), ("Slim ", slim)):
        if by in df.columns:
            for name in sorted(r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().collect()):
                out[f"{prefix}{name}"] = df.where(F.col(by) == name)
    return out
