"""Ranked lexical search over inverted treaps.

Documents are dealt to shards by a hash. In a shard every term has a treap over its postings:
a search tree by doc_id and a heap by impact, so the root of a subtree has its greatest impact.
A query walks the treaps of its terms together over intervals of documents: the sum of the roots
bounds every score in an interval; an interval below the k-th score is dropped, another is split
at the document of its strongest root, which is scored, until it is so short that its documents
are scored together.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import each, materialize

#: Bytes of terms are kept, A-Z as a-z; all others become spaces. Every byte of a character beyond
#: ASCII is 128 or more, so this splits UTF-8 text as the pattern of the terms does.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SLICE = 1 << 20


def terms(text: str | bytes):
    """Lists of the terms of a text in order, a slice of the text at a time."""
    data = (text.encode() if isinstance(text, str) else text).translate(FOLD)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + SLICE)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def _counted(known: dict[bytes, int] | None):
    """Batches of (doc_id, text) to (doc_id, n, terms, tfs): terms by number, or all as text without ``known``."""

    def go(batches):
        for batch in batches:
            n, names, tfs = [], [], []
            for text in each(batch.column("text").cast(pa.binary())):
                total, count = 0, {}
                for some in terms(text or b""):
                    total += len(some)
                    for t in some:
                        if known is None or t in known:
                            count[t] = count.get(t, 0) + 1
                n.append(total)
                names.append([t.decode() for t in count] if known is None else [known[t] for t in count])
                tfs.append(list(count.values()))
            kind = pa.string() if known is None else pa.int32()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.list_(kind)), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "names", "tfs"])

    return go


def _asked(batches):
    for batch in batches:
        found = [sorted({t.decode() for some in terms(text or b"") for t in some}) for text in each(batch.column("text").cast(pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])


def heap_children(impact: list[int], tie: list[int], lo: int, hi: int, left: np.ndarray, right: np.ndarray) -> int:
    """Link the postings lo..hi, in the order of their documents, into a treap by impact; its root."""
    spine: list[int] = []
    for i in range(lo, hi):
        last, mine = -1, impact[i]
        while spine and (impact[spine[-1]] < mine or (impact[spine[-1]] == mine and tie[spine[-1]] < tie[i])):
            last = spine.pop()
        left[i] = last
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return spine[0]


class Treaps:
    """The treaps of one shard: postings by (term, document), children, roots and documents."""

    def __init__(self, doc_id: list, row: np.ndarray, m: np.ndarray, names: list[np.ndarray], tfs: list[np.ndarray]):
        null = np.array([d is None for d in doc_id], dtype=bool)
        ids = np.array([0 if d is None else d for d in doc_id], dtype=np.int64)
        order = np.lexsort((row, ids, null))
        self.ids, self.null, self.row = ids[order], null[order], row[order]
        counts = np.array([len(names[i]) for i in order.tolist()], dtype=np.int64)
        pos = np.repeat(np.arange(len(order)), counts)
        name = np.concatenate([names[i] for i in order.tolist()]) if len(order) else np.zeros(0, np.int64)
        tf = np.concatenate([tfs[i] for i in order.tolist()]) if len(order) else np.zeros(0, np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m[order], counts))
        by = np.lexsort((pos, name))
        self.name, starts = np.unique(name[by], return_index=True)
        self.start = np.r_[starts, len(by)].astype(np.int64)
        self.doc, self.impact = pos[by].astype(np.int32), impact[by]
        self.left, self.right = np.full(len(by), -1, np.int32), np.full(len(by), -1, np.int32)
        as_list, tie = self.impact.tolist(), np.random.default_rng(1).permutation(len(by)).tolist()
        self.root = np.array([heap_children(as_list, tie, int(a), int(b), self.left, self.right) for a, b in zip(self.start, self.start[1:], strict=False)], dtype=np.int64)

    def _within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int = 48) -> np.ndarray:
        """Roots of the treaps cut to [lo, hi): walk down while the node's document lies outside.

        After ``steps`` a node may still lie outside; its impact bounds what is below it all the same.
        """
        for _ in range(steps):
            doc = self.doc[node]
            out = (node >= 0) & ((doc >= hi) | (doc < lo))
            if not out.any():
                break
            node = np.where(out, np.where(doc >= hi, self.left[node], self.right[node]), node)
        return node

    def search(self, names: list[np.ndarray], weights: list[np.ndarray], k: int, floor: np.ndarray, short: int = 64, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, document, score) of the first ``k`` documents of each query with a score above
        0 that reaches its ``floor``; each query's k-th score or floor; and the number of documents scored."""
        most = max((len(x) for x in names), default=0)
        slot, w = np.full((len(names), most), -1, np.int64), np.zeros((len(names), most), np.int64)
        for i, (x, y) in enumerate(zip(names, weights, strict=True)):
            at = np.minimum(np.searchsorted(self.name, x), max(len(self.name) - 1, 0))
            there = (self.name[at] == x) & (y > 0) if len(self.name) else np.zeros(len(x), bool)
            slot[i, : int(there.sum())], w[i, : int(there.sum())] = at[there], y[there]
        docs = len(self.ids)
        keys = np.repeat(np.arange(len(self.name)), np.diff(self.start)) * docs + self.doc
        floor = np.maximum(floor.astype(np.int64), 1)
        best = (np.zeros(0, np.int64),) * 3
        scored = 0
        # Open intervals: query, first and last document, a node for each term, bound.
        q = np.flatnonzero((slot >= 0).any(axis=1))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), docs)
        node = np.where(slot[q] >= 0, self.root[slot[q]], -1) if len(q) else np.zeros((0, most), np.int64)
        total = lambda q, node: (w[q] * np.where(node >= 0, self.impact[node], 0)).sum(axis=1)
        bound = total(q, node) if len(q) else np.zeros(0, np.int64)
        while len(q):
            order = np.lexsort((-bound, q))
            place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            now = order[place < width]
            rest = np.ones(len(q), bool)
            rest[now] = False
            cq, clo, chi, cnode = q[now], lo[now], hi[now], node[now]
            q, lo, hi, node, bound = q[rest], lo[rest], hi[rest], node[rest], bound[rest]
            small = chi - clo <= short
            new = []
            if small.any():
                sq, slo, shi = cq[small], clo[small], chi[small]
                own = np.where(cnode[small] >= 0, slot[sq], -1)
                a = np.where(own >= 0, np.searchsorted(keys, own * docs + slo[:, None]), 0).ravel()
                b = np.where(own >= 0, np.searchsorted(keys, own * docs + shi[:, None]), 0).ravel()
                n = b - a
                posting = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                cell = np.repeat(np.arange(len(n)) // most, n)
                sums = np.zeros(len(sq) * short, np.int64)
                np.add.at(sums, cell * short + self.doc[posting] - slo[cell], self.impact[posting] * np.repeat(w[sq].ravel(), n))
                at = np.flatnonzero(sums)
                new.append((sq[at // short], slo[at // short] + at % short, sums[at]))
                scored += int((shi - slo).sum())
            if not small.all():
                wq, wlo, whi, wnode = cq[~small], clo[~small], chi[~small], cnode[~small]
                strength = np.where(wnode >= 0, self.impact[wnode], -1) * w[wq]
                top = wnode[np.arange(len(wq)), np.argmax(strength, axis=1)]
                split = self.doc[top].astype(np.int64)
                inside = (split >= wlo) & (split < whi)
                split = np.where(inside, split, (wlo + whi) // 2)
                own = np.where(wnode >= 0, slot[wq], -1)
                at = np.minimum(np.searchsorted(keys, own * docs + split[:, None]), len(keys) - 1)
                hit = (own >= 0) & (keys[at] == own * docs + split[:, None])
                new.append((wq, split, (w[wq] * np.where(hit, self.impact[at], 0)).sum(axis=1)))
                scored += len(wq)
                nq, nlo, nhi = np.r_[wq, wq], np.r_[wlo, split + 1], np.r_[split, whi]
                nnode = self._within(np.r_[wnode, wnode], nlo[:, None], nhi[:, None])
                q, lo, hi, node, bound = np.r_[q, nq], np.r_[lo, nlo], np.r_[hi, nhi], np.r_[node, nnode], np.r_[bound, total(nq, nnode)]
            found = [np.concatenate(x) for x in zip(*new, strict=True)]
            fits = found[2] >= floor[found[0]]
            row, doc, score = (np.r_[x, y[fits]] for x, y in zip(best, found, strict=True))
            order = np.lexsort((doc, -score, row))
            kept = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
            best = row[kept], doc[kept], score[kept]
            full = np.bincount(best[0], minlength=len(names)) >= k
            last = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(last, best[0], best[2])
            floor = np.where(full, np.maximum(floor, np.where(full, last, 0)), floor)
            keep = (bound >= floor[q]) & (lo < hi)
            q, lo, hi, node, bound = q[keep], lo[keep], hi[keep], node[keep], bound[keep]
        return *best, floor, scored


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, shard_postings: int = 200_000, item_rows: int = 256, known_bytes: int = 64 << 20,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item; exact.

    Terms are the maximal runs of characters other than ASCII ones that are neither digits nor
    letters, A-Z lower-cased; whole texts are read. N counts the documents with a term, L their
    terms, n a document's terms. A term in df documents weighs w = floor(1000 ln((2N+2)/(2df+1)));
    one that occurs tf times in a document with m = 50 + (50nN div L) adds w ((10^9 tf) div
    (1000 tf + 20m)), once an item. Returns item_id, rank (from 1), doc_id and score, ties by
    ascending doc_id.

    Null and empty texts have no terms: such documents are found by no item and such items find
    none; empty tables give an empty one; other columns are not read. Documents without an id
    rank behind others of their score. Repeated rows of documents are documents of their own; a
    repeated row of items counts once, and two texts of one item_id are two items, each with its
    own ranks.

    The terms of the items are handed to the tasks where they fill at most ``known_bytes``; else
    all terms of the documents are joined with them. A shard has about ``shard_postings`` postings
    of such terms; one task sees one stored shard and about ``item_rows`` items. Items meet one
    shard first, whose k-th score then bounds their search in all others.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    empty = f"item_id {kind}, rank int, doc_id long, score long"
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    asked = asked.select("item_id", F.xxhash64("text").alias("same"), "text")
    found = asked.select(F.struct("item_id", "same").alias("item_id"), "text").mapInArrow(_asked, f"item_id struct<item_id:{kind},same:bigint>, terms array<string>")
    asked = materialize(found.select("item_id.*", "terms"), "items")
    vocabulary = materialize(asked.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    size = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + 64).alias("bytes")).first()
    if not size["n"]:
        return spark.createDataFrame([], empty)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    row = F.monotonically_increasing_id()  # fixed by writing it
    if size["bytes"] <= known_bytes:
        names = {r["term"]: i for i, r in enumerate(vocabulary.orderBy("term").toLocalIterator())}
        numbers = {t.encode(): i for t, i in names.items()}
        parsed = materialize(texts.mapInArrow(_counted(numbers), "doc_id long, n long, names array<int>, tfs array<long>").withColumn("row", row), "terms")
        numbered = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "name": pa.array(names.values(), pa.int32())}))
    else:
        every = materialize(texts.mapInArrow(_counted(None), "doc_id long, n long, names array<string>, tfs array<long>").withColumn("row", row), "terms")
        numbered = materialize(vocabulary.withColumn("name", row), "numbered")
        pairs = every.select("row", F.explode(F.arrays_zip("names", "tfs")).alias("p")).select("row", F.col("p.names").alias("term"), F.col("p.tfs").alias("tf"))
        lists = pairs.join(numbered, "term").groupBy("row").agg(F.collect_list(F.struct("name", "tf")).alias("l"))
        lists = lists.select("row", F.col("l.name").alias("names"), F.col("l.tf").alias("tfs"))
        parsed = materialize(every.select("doc_id", "n", "row").join(lists, "row", "left"), "numbered_terms")
    whole = parsed.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L"), F.sum(F.greatest(F.size("names"), F.lit(0))).alias("postings")).first()
    if not whole["postings"]:
        return spark.createDataFrame([], empty)
    shards = -(-whole["postings"] // shard_postings)

    # An item's terms with their weights.
    df = parsed.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * whole["N"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = numbered.join(df, "name").select("term", F.col("name").cast("long").alias("name"), weight.alias("weight"))
    terms_of = asked.select("item_id", "same", F.explode("terms").alias("term")).join(weighed, "term")
    terms_of = terms_of.groupBy("item_id", "same").agg(F.array_sort(F.collect_list(F.struct("name", "weight"))).alias("t"))
    blocks = -(-asked.count() // item_rows)
    own = F.pmod(F.xxhash64("item_id", "same", F.lit("shard")), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("item_id", "same", F.lit("block")), F.lit(blocks)).cast("int")
    queries = terms_of.select("item_id", "same", F.col("t.name").alias("names"), F.col("t.weight").alias("weights"), own.alias("own"), block.alias("b"), F.lit(1).cast("long").alias("floor"))
    queries = materialize(queries, "queries")

    m = F.lit(50).cast("long") + F.expr(f"cast((50 * cast(n as decimal(38,0)) * {whole['N']}) div {whole['L']} as bigint)")
    dealt = parsed.where(F.size("names") > 0).select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("s"), "doc_id", "row", m.alias("m"), F.col("names").cast("array<bigint>").alias("names"), "tfs")

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = lambda c: [x.values.to_numpy() for x in group.column(c)]
        made = Treaps(group.column("doc_id").to_pylist(), group.column("row").to_numpy(), group.column("m").to_numpy(), lists("names"), lists("tfs"))
        return pa.table({"s": pa.array([key[0].as_py()], pa.int32()), "made": pa.array([pickle.dumps(made)], pa.binary())})

    index = materialize(dealt.groupBy("s").applyInArrow(build, "s int, made binary"), "treaps")
    index = index.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = f"item_id {kind}, same long, doc_id long, row long, score long, floor long"

    def meet(some: pa.Table, stored: pa.Table) -> pa.Table:
        if some.num_rows and stored.num_rows:
            made = pickle.loads(stored.column("made")[0].as_py())
            lists = lambda c: [x.values.to_numpy() for x in some.column(c)]
            q, doc, score, floor, _ = made.search(lists("names"), lists("weights"), k, some.column("floor").to_numpy())
        else:
            made, q, doc, score, floor = None, *(np.zeros(0, np.int64),) * 4
        ids = pa.array(made.ids[doc], pa.int64(), mask=made.null[doc]) if made is not None else pa.array([], pa.int64())
        at = pa.array(q)
        return pa.table({"item_id": some.column("item_id").take(at), "same": some.column("same").take(at), "doc_id": ids, "row": made.row[doc] if made is not None else doc, "score": score, "floor": floor[q]})

    def search(routed: DataFrame) -> DataFrame:
        return routed.groupBy("s", "b").cogroup(index.groupBy("s", "b")).applyInArrow(meet, schema)

    first = materialize(search(queries.withColumn("s", F.col("own"))), "first")
    known = first.groupBy("same", "item_id").agg(F.max("floor").alias("known"))
    q, f = queries.alias("q"), known.alias("f")
    bounded = q.join(f, (F.col("q.same") == F.col("f.same")) & F.col("q.item_id").eqNullSafe(F.col("f.item_id")), "left")
    bounded = bounded.select("q.item_id", "q.same", "q.names", "q.weights", "q.own", "q.b", F.coalesce("f.known", "q.floor").alias("floor"))
    others = bounded.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(int(shards - 1))))).where("s <> own")
    both = first.unionByName(search(others))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"]
    rank = F.row_number().over(Window.partitionBy("item_id", "same").orderBy(*order))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search_sql(k: int = 50) -> str:
    """The same rows for DuckDB, by scoring all documents."""
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with d as (select row_number() over () as row, doc_id, {found} as t from documents where text is not null),
s as (select count(*) as n_docs, sum(len(t)) as n_terms from d where len(t) > 0),
p as (select row, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from (select row, doc_id, len(t) as n, unnest(t) as term from d) group by row, term),
f as (select term, count(*) as df from p group by term),
i as (select distinct item_id, unnest({found}) as term from benchmark where text is not null),
w as (select item_id, term, cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1))) as bigint) as w from i join f using (term), s),
c as (select item_id, row, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as score from w join p using (term), s group by item_id, row),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, cast(score as bigint) as score from c where score > 0)
select item_id, rank, doc_id, score from r where rank <= {k}"""
