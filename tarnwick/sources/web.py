"""Clients of the two enrichment services: requests with retries, parsing, and the cache before both.

``post`` takes (url, fields) and returns the response's text, or raises; responses are reports of
bounded size, so they are parsed on the driver.
"""

from __future__ import annotations

import csv
import json
import time
from collections.abc import Callable
from html.parser import HTMLParser
from io import StringIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from tarnwick.operators.ontology import web_enrichment
from tarnwick.sources.readers import cached

# Addresses, parameters and retry rules of the services. Fixed values.
STRING_URL, STRING_SPECIES, STRING_SEPARATOR, STRING_TRIES, STRING_DELAY = "https://string-db.org/api", "4896", "%0d", 5, 10
STRING_REFUSAL = "Something went wrong!"
REVIGO_URL, REVIGO_TAXON, REVIGO_MEASURE, REVIGO_TRIES, REVIGO_DELAY = "http://revigo.irb.hr/Revigo", "284812", "SIMREL", 3, 30

Post = Callable[[str, dict], str]


def post_form(url: str, fields: dict) -> str:
    from urllib.parse import urlencode
    from urllib.request import urlopen

    with urlopen(url, urlencode(fields).encode(), timeout=60) as r:
        return r.read().decode()


def retried(post: Post, url: str, fields: dict, tries: int, delay: float, refusal: str | None = None) -> str:
    """The response's text; OSErrors and texts that hold ``refusal`` are tried again, then raise ValueError."""
    for k in range(tries):
        try:
            text = post(url, fields)
            if refusal and refusal in text:
                raise OSError(refusal)
            return text
        except OSError as error:
            if k == tries - 1:
                raise ValueError(f"{url} failed {tries} times: {error}") from error
            time.sleep(delay)
    raise ValueError("no try allowed")


def parse_rows(text: str, kind: str) -> list[dict]:
    """Records of an xml, tsv, tsv-no-header or json response; columns without a header are numbered."""
    if kind == "xml":
        return [{field.tag: field.text for field in record} for record in ElementTree.fromstring(text)]
    if kind == "json":
        return json.loads(text)
    rows = list(csv.reader(StringIO(text), delimiter="\t"))
    if kind == "tsv":
        return [dict(zip(rows[0], r, strict=True)) for r in rows[1:]]
    if kind == "tsv-no-header":
        return [{str(i): v for i, v in enumerate(r)} for r in rows]
    raise ValueError(f"unknown format {kind}")


class _Tables(HTMLParser):
    """Cells of the first table of a page."""

    def __init__(self):
        super().__init__()
        self.rows, self.open, self.done = [], False, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr" and not self.done:
            self.rows.append([])
        self.open = tag in ("td", "th") and not self.done
        if self.open:
            self.rows[-1].append("")

    def handle_endtag(self, tag):
        self.done = self.done or tag == "table"
        self.open = self.open and tag not in ("td", "th")

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1] += data.strip()


def parse_page(text: str) -> list[dict]:
    """Records of a page's first table, named by its first row; empty cells are None."""
    page = _Tables()
    page.feed(text)
    head, *rows = [r for r in page.rows if r]
    return [dict(zip(head, [c or None for c in r], strict=True)) for r in rows]


def string_enrichment(spark: SparkSession, study: list[str], background: list[str], cache_dir: str, post: Post = post_form, delay: float = STRING_DELAY) -> DataFrame | None:
    """Functional enrichment of a study against a background in the columns of ``web_enrichment``; None if the service gives none.

    The cache is asked first, by the sorted genes of both sets. Failing to name the background
    raises; a failing enrichment is None and is not kept.
    """
    parts = ["string", ",".join(sorted(study)), ",".join(sorted(background))]
    raw = "category string, term string, number_of_genes int, number_of_genes_in_background int, preferredNames string, p_value double, fdr double, description string"
    names = [f.split()[0] for f in raw.split(", ")]

    def ask(method: str, fields: dict) -> list[dict]:
        return parse_rows(retried(post, f"{STRING_URL}/xml/{method}", fields | {"species": STRING_SPECIES}, STRING_TRIES, delay, STRING_REFUSAL), "xml")

    def fetch(_):
        ids = [r["stringId"] for r in ask("get_string_ids", {"identifiers": STRING_SEPARATOR.join(background), "limit": 1, "echo_query": 1})]
        try:
            rows = ask("enrichment", {"identifiers": STRING_SEPARATOR.join(study), "background_string_identifiers": STRING_SEPARATOR.join(ids)})
            number = {"number_of_genes": int, "number_of_genes_in_background": int, "p_value": float, "fdr": float}
            return [tuple(number.get(c, str)(r[c]) for c in names) for r in rows] or None
        except (ValueError, KeyError, ElementTree.ParseError):
            return None

    found = cached(spark, cache_dir, parts, fetch, raw)
    return None if found is None else web_enrichment(found, len(study), len(background))


def revigo(spark: SparkSession, terms: list[tuple[str, float]], cache_dir: str, cutoff: float = 0.7, post: Post = post_form, delay: float = REVIGO_DELAY) -> DataFrame:
    """The service's summary of (term, p), each term with the name of its representative; raises if it fails.

    A term without a representative stands for itself; a representative is the number of a GO term.
    """
    parts = ["revigo", str(cutoff), ",".join(f"{t}:{p}" for t, p in terms)]
    fields = {"cutoff": str(cutoff), "valueType": "pvalue", "speciesTaxon": REVIGO_TAXON, "measure": REVIGO_MEASURE, "goList": "\n".join(f"{t}\t{p}" for t, p in terms)}

    def fetch(_):
        rows = parse_page(retried(post, REVIGO_URL, fields, REVIGO_TRIES, delay))
        names = {r["Term ID"]: r["Name"] for r in rows}
        own = [r["Name"] if r["Representative"] is None else names[f"GO:{int(float(r['Representative'])):07d}"] for r in rows]
        return [(r["Term ID"], r["Name"], float(r["Dispensability"]) if r["Dispensability"] else None, r["Eliminated"], name) for r, name in zip(rows, own, strict=True)]

    return cached(spark, cache_dir, parts, fetch, "term_id string, name string, Dispensability double, Eliminated string, Representative string")
