"""Near copies by SimHash and the Jaccard similarity of word shingles, for the pipeline's stage.

SimHash fingerprints as op1 has them come first: texts whose fingerprints differ in at most two bits
are compared by their whole sets. Similar texts may be further apart than that, so the others are
found as follows.

A text is the set of its shingles of five words. MinHash signatures of 128 places are cut into 32
bands of four; texts that agree in a whole band share a bucket; a pair of similarity 0.8 shares no
bucket with a chance of 5 in 10^8. A bucket's texts meet leaders of it first, which joins the many
copies of one text; then all of its texts that nothing has joined yet meet each other, block by
block: first by their signatures, and those that these call likely by their whole sets, which alone
decide a link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm import simhash
from tarnwick.llm.common import TMP, discard, each, materialize, shuffle_partitions
from tarnwick.llm.graph import connected_components

BANDS, ROWS, SEED = 32, 4, 42
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def normal(text: bytes) -> bytes:
    """ASCII lower case, words of ASCII white space with single spaces between."""
    return b" ".join(text.lower().split())


def node_of(text: bytes) -> int:
    """A 64-bit name of a text; texts of equal words have equal names."""
    return xxhash.xxh64_intdigest(normal(text), SEED)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    ids = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(ws)}
    h = np.fromiter(map(ids.__getitem__, ws), dtype=np.uint64, count=len(ws))
    n, k = max(1, len(ws) - width + 1), min(width, len(ws))
    out = np.full(n, k, dtype=np.uint64)
    for place in range(k):
        out += _mixed(h[place : place + n] * _ODD[place])
    return np.unique(_mixed(out))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set."""
    low, least = shingles.astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(low), 4096):
        least = np.minimum(least, (low[lo : lo + 4096, None] * _MUL + _ADD).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The buckets of a signature: one 64-bit key per band, different between bands."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys


def _node(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([node_of(t or b"") for t in each(texts.cast(pa.binary()))], dtype=np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(kind)))


def _signed(texts: pa.Array) -> pa.Array:
    """(n, bands, sketch, fingerprint) of each text: the size of its set of shingles, its buckets, a byte of each place of its signature and its SimHash."""
    sizes, keys, sketches, prints = [], [], [], []
    for t in each(texts.cast(pa.binary())):
        s = shingle_set(t or b"")
        sizes.append(len(s))
        least = least_hashes(s)
        keys.append(bands(least) if len(s) else s)
        sketches.append((least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8))
        prints.append(simhash.fingerprint_bytes(t or b""))
    hashed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _lists(keys), _lists(sketches, np.int8), hashed], ["n", "bands", "sketch", "fingerprint"])


def _shingles(texts: pa.Array) -> pa.Array:
    return _lists([shingle_set(t or b"").astype(np.uint32) for t in each(texts.cast(pa.binary()))], np.int32)


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the column of either node as xa and xb."""
    at = {k: table.select(F.col("node").alias(k), F.col(column).alias("x" + k)) for k in ("a", "b")}
    return pairs.join(at["b"], "b").join(at["a"], "a")


def _least_alike(threshold: float) -> int:
    """Places in which the signatures of sets of this similarity agree, but for a chance of under 10^-8."""
    return math.ceil(BANDS * ROWS * threshold - 5.6 * math.sqrt(BANDS * ROWS * threshold * (1 - threshold)))


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    alike = F.size(F.filter(F.zip_with("xa", "xb", lambda x, y: x == y), lambda x: x))
    return materialize(_both(pairs, nodes, "sketch").where(alike >= _least_alike(threshold)).select("a", "b"), "likely")


def _similar(likely: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``threshold`` or more.

    Sets are compared by 32 bits of their hashes, which at 10,000 words call 0.02 shingles equal that are not.
    """
    both = F.size(F.array_intersect("xa", "xb"))
    found = materialize(_both(likely, sets, "s").where(both >= threshold * (F.size("xa") + F.size("xb") - both)).select("a", "b"), "links")
    discard(likely)
    return found


def likely_rows(n: np.ndarray, root: np.ndarray, left: np.ndarray, sketch: np.ndarray, keys: np.ndarray, band: int, threshold: float, step: int = 128) -> np.ndarray:
    """Which rows of a meeting are in a pair that only their sets can decide, and that is this band's to decide.

    Such a pair has no link yet, sizes in the ratio ``threshold`` and signatures that agree often
    enough. A pair that shares several bands belongs to the first. Rows that are ``left`` meet all
    others, or those that are not, if some are not.
    """
    least, inner = _least_alike(threshold), bool(left.all())
    own, other, out = np.flatnonzero(left), np.arange(len(n)) if inner else np.flatnonzero(~left), np.zeros(len(n), dtype=bool)
    for lo in range(0, len(own), step):
        i = own[lo : lo + step]
        fits = (root[i][:, None] != root[other][None]) & (np.minimum(n[i][:, None], n[other][None]) >= threshold * np.maximum(n[i][:, None], n[other][None]))
        r, c = np.nonzero(fits)
        for at in range(0, len(r), 1 << 15):
            x, y = i[r[at : at + (1 << 15)]], other[c[at : at + (1 << 15)]]
            good = (sketch[x] == sketch[y]).sum(axis=1) >= least
            x, y = x[good], y[good]
            mine = (keys[x] == keys[y]).argmax(axis=1) == band
            out[x[mine]] = out[y[mine]] = True
    return out


def links_of_sets(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Rows (i, j) whose sets have a Jaccard similarity of ``threshold`` or more, enough to join all that are linked.

    A row's intersections with all others come from one pass over their shingles, and rows that
    are joined already are not compared.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    starts, inner = np.r_[0, np.cumsum(sizes)[:-1]], bool(left.all())
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int32)
    _, group = np.unique(root, return_inverse=True)
    out = []
    for i in np.flatnonzero(left):
        open_ = (group != group[i]) & (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i]))
        open_ &= np.arange(len(sets)) > i if inner else ~left
        if not open_.any():
            continue
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[mine] = 0
        for j in np.flatnonzero(open_ & (both >= threshold * (sizes + sizes[i] - both))):
            if group[j] != group[i]:
                out.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return out


def _shared(dealt: DataFrame, threshold: float, large: int = 64) -> DataFrame:
    """The rows (node, n, band, bucket) whose bucket has others.

    A bucket of over ``large`` rows is cut by size: sets as similar as ``threshold`` have sizes in
    that ratio, so each goes to its own class of sizes and to the next, and meets the other in one.
    """
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = materialize(dealt.join(counts, "bucket"), "buckets")
    kind = F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold)) + 1e-9).cast("long")
    cut = rows.where(F.col("c") > large).withColumn("kind", F.explode(F.array(kind, kind + 1)))
    cut = cut.select("node", "n", "band", F.xxhash64("bucket", "kind").alias("bucket"))
    some = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    out = materialize(rows.where(F.col("c") <= large).select("node", "n", "band", "bucket").unionByName(cut.join(some, "bucket").select("node", "n", "band", "bucket")), "shared")
    discard(rows)
    return out


def _meetings(placed: DataFrame, block: int, shingles: int) -> DataFrame:
    """The rows of buckets of several roots, once for every meeting (bucket, i, j) of two blocks.

    A block has about ``block`` rows and ``shingles`` shingles at most. Rows of the root that most
    of a bucket have need not meet each other, so their blocks meet those of the other rows only. A
    bucket of two met its leader in the first round and is left out.
    """
    per = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    per = per.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "w", F.col("root").alias("most"))).alias("m"), F.count(F.lit(1)).alias("p")).where("p > 1 and c > 2")
    rows = placed.join(per.select("bucket", "c", "w", F.col("m.c").alias("mc"), F.col("m.w").alias("mw"), "m.most"), "bucket")
    blocks_of = lambda c, w: F.greatest(F.ceil(c / F.lit(block)), F.ceil(w / F.lit(shingles))).cast("int")
    few, many = blocks_of(F.col("c") - F.col("mc"), F.col("w") - F.col("mw")), blocks_of(F.col("mc"), F.col("mw"))
    h = F.xxhash64("node", F.lit("block"))
    # A bucket that fits in one block is one meeting of that block with itself.
    whole = blocks_of(F.col("c"), F.col("w")) == 1
    own = F.when(whole, 0).when(F.col("root") != F.col("most"), F.pmod(h, few)).otherwise(few + F.pmod(h, many)).cast("int")
    rows = rows.withColumns({"few": F.when(whole, 1).otherwise(few), "blocks": F.when(whole, 1).otherwise(few + many), "k": own})
    as_left = F.when(F.col("k") < F.col("few"), F.transform(F.sequence("k", F.col("blocks") - 1), lambda j: F.struct(F.col("k").alias("i"), j.alias("j"), F.lit(True).alias("left"))))
    as_right = F.when((F.col("k") > 0) & (F.col("few") > 0), F.transform(F.sequence(F.lit(0), F.least(F.col("k"), F.col("few")) - 1), lambda i: F.struct(i.alias("i"), F.col("k").alias("j"), F.lit(False).alias("left"))))
    none = F.array().cast("array<struct<i:int,j:int,left:boolean>>")
    return rows.select("bucket", "band", "node", "n", "root", F.explode(F.concat(F.coalesce(as_left, none), F.coalesce(as_right, none))).alias("e")).select("bucket", "e.*", "band", "node", "n", "root")


def _joined(edges: list[DataFrame]) -> DataFrame:
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    return connected_components(found)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _each_meeting(t: pa.Table):
    """The rows of every meeting (bucket, i, j) of a table."""
    b, i, j = (t.column(c).to_numpy() for c in ("bucket", "i", "j"))
    order = np.lexsort((j, i, b))
    opens = np.flatnonzero(np.r_[True, (np.diff(b[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])
    for lo, hi in zip(opens, np.r_[opens[1:], len(order)], strict=True):
        yield order[lo:hi]


def _grid(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def _all_left(placed: DataFrame, known: DataFrame, sets: DataFrame, threshold: float, block: int = 2048, shingles: int = 1 << 21) -> DataFrame:
    """The links (a, b) that join all linked pairs of ``placed`` (bucket, band, node, n, root) that no link joins yet.

    Every meeting of two blocks of a bucket is a group: its signatures say which of its rows need
    their sets, and the sets of those rows alone are sent to it, to be compared with each other. No
    pair is a row of a plan, none is left out.
    """
    met = _meetings(placed, block, shingles).join(known, "node").select("bucket", "i", "j", "left", "band", "node", "n", "root", "sketch", "bands")

    def likely(t: pa.Table) -> pa.Table:
        sketch, keys = _grid(t.column("sketch"), np.int8), _grid(t.column("bands"), np.int32)
        n, root, left, band = (t.column(c).to_numpy() for c in ("n", "root", "left", "band"))
        keep = np.zeros(t.num_rows, dtype=bool)
        for at in _each_meeting(t):
            keep[at] = likely_rows(n[at], root[at], left[at], sketch[at], keys[at], int(band[at[0]]), threshold)
        return t.select(["bucket", "i", "j", "left", "node", "root"]).filter(pa.array(keep))

    # Small buckets share a group; a meeting of blocks of a large one is a group of its own.
    group = F.xxhash64(F.pmod(F.col("bucket"), F.lit(64 * shuffle_partitions(placed.sparkSession))), "i", "j")
    asked = materialize(met.groupBy(group).applyInArrow(likely, "bucket long, i int, j int, left boolean, node long, root long"), "likely_rows")

    def decide(t: pa.Table) -> pa.Table:
        node, root, left = (t.column(c).to_numpy() for c in ("node", "root", "left"))
        lists, a, b = t.column("s").combine_chunks(), [], []
        for at in _each_meeting(t):
            own = [lists[int(r)].values.to_numpy().view(np.uint32) for r in at]
            for i, j in links_of_sets(own, root[at], left[at], threshold):
                a.append(int(node[at[i]]))
                b.append(int(node[at[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = asked.join(sets, "node").select("bucket", "i", "j", "left", "node", "root", "s").groupBy(group).applyInArrow(decide, "a long, b long")
    out = materialize(found, "links")
    discard(asked)
    return out


def fingerprint_pairs(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) that join all nodes (node, fingerprint) whose SimHash fingerprints differ in at most ``radius`` bits.

    Nodes of one fingerprint meet the least of them, and those stand for their fingerprints.
    """
    prints = materialize(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(prints, "fingerprint").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    at = {k: prints.select(F.col("fingerprint").alias(k), F.col("least").alias("x" + k)) for k in ("a", "b")}
    near = simhash.links(prints.select("fingerprint"), radius).distinct().join(at["a"], "a").join(at["b"], "b")
    near = near.select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b"))
    out = materialize(same.unionByName(near), "fingerprint_pairs")
    discard(prints)
    return out


def links(nodes: DataFrame, sets_of, threshold: float = 0.8, rounds: int = 2, first: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes (node, n, bands, sketch) that similar pairs link to another.

    Pairs (a, b) of ``first``, such as those of ``fingerprint_pairs``, are compared before all others.

    In the first round each bucket's nodes meet the bucket's least by a hash of the node, the same
    leader in all buckets of the same copies; in each further round every bucket has another leader
    by a hash of its own, so that a node meets as many new ones as it has buckets. After ``rounds``
    all pairs of a bucket that no link joins are compared (``_all_left``), whatever the bucket's
    size; the rounds only leave it less to do. ``sets_of`` gives the shingles (node, s) of a table of
    nodes; it is asked for those that share a bucket.
    """
    level = _shared(nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket")), threshold)
    # 31 bits of a band tell which bands two signatures share but for a chance of 10^-8.
    short = F.transform("bands", lambda b: b.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("bands")
    met = level.select("node")
    if first is not None:
        met = met.union(first.select("a")).union(first.select("b"))
    known = materialize(nodes.select("node", "sketch", short).join(met.distinct(), "node", "left_semi"), "sketches")
    sets = materialize(sets_of(known.select("node")), "shingles")
    edges = [] if first is None else [_similar(_likely(first, known, threshold), sets, threshold)]
    fits = (F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n"))

    now = level.withColumn("root", F.col("node"))
    for k in range(rounds):
        rank = F.xxhash64("node", "bucket", F.lit(k)) if k else F.xxhash64("node")
        first = F.min(F.struct(rank.alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("r"))).alias("l")
        met = now.join(now.groupBy("bucket").agg(first).select("bucket", "l.*"), "bucket").where((F.col("root") != F.col("r")) & fits)
        pairs = materialize(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a <> b").distinct(), "pairs")
        edges.append(_similar(_likely(pairs, known, threshold), sets, threshold))
        discard(pairs)
        roots = _joined(edges)
        placed = materialize(_rooted(now.drop("root"), roots), "placed")
        going = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi and c > 2")
        before, now = now, materialize(placed.join(going.select("bucket"), "bucket"), "unlinked")
        discard(placed)
        if k:
            discard(before)
    edges.append(_all_left(now, known, sets, threshold))
    roots = _joined(edges)
    for table in (level, now, known, sets, *edges):
        discard(table)
    return roots


def keep_one_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each group of texts that similarities of ``threshold`` or more link.

    It is the row with the group's smallest id (a null id comes last), of texts of equal words under
    one id the one of the least hash; all columns stay. Rows go by text, never by id alone, so two different texts with
    one id both stay. Texts of equal words are one node; wordless and null texts are equal. An
    empty table gives an empty table.

    Texts are shuffled once, by node, each task sending one row of a node however many it has.
    The table of different texts is shuffled again, for the sets of those that share a bucket and
    to leave out the copies, only where these are too many to broadcast by the session's setting.
    """
    row = F.col(TMP + "row")
    named = docs.select(F.struct(*docs.columns).alias(TMP + "row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.arrow_udf(_node, "long")(F.col(text_col)).alias("node"))
    order = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last(), "h")
    one = named.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "h")
    signed = F.arrow_udf(_signed, "struct<n: int, bands: array<long>, sketch: array<tinyint>, fingerprint: long>")(row[text_col])
    texts = materialize(one.withColumn("t", signed).select(TMP + "row", "node", "id", "t.*"), "texts")

    def sets_of(wanted: DataFrame) -> DataFrame:
        asked = texts.select("node", row[text_col].alias("text")).join(wanted, "node", "left_semi")
        return asked.select("node", F.arrow_udf(_shingles, "array<int>")("text").alias("s"))

    near = fingerprint_pairs(texts.select("node", "fingerprint"))
    roots = links(texts.select("node", "n", "bands", "sketch"), sets_of, threshold, first=near)
    discard(near)
    involved = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(texts.select("node", "id").join(involved, "node"), "members")
    lowest = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("l"))
    dropped = members.join(lowest, "root").where(F.col("node") != F.col("l.node")).select("node")
    return texts.select(TMP + "row", "node").join(materialize(dropped, "dropped"), "node", "left_anti").select(TMP + "row.*")
