"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of lengths reaches the driver (at most one row per length up to the
capacity). There the program over configurations (multisets of lengths that fit one sequence) is
solved by multiplicative weights, priced by a knapsack dynamic program, and rounded to whole
sequences; the last tenth of the pieces goes by best fit into the gaps. The plan, a list of
configurations with multiplicities, is then laid over the pieces by their rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import TMP, each, materialize, ranked_within

#: How this vocabulary cuts a normalised text into pre-tokens; fixed by the tokenizer file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with other characters than these go through the library whole.
PLAIN = "[^\t-\r\x20-\x7e¡-įı-ɏ]"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next free one."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class ChunkEncoder:
    """Token ids of whole texts, with a bounded memory of chunks between white space.

    The vocabulary file never joins characters across white space, nor letters with punctuation,
    and lower-cases all, so a text of plain Latin letters is the concatenation of its lower-cased
    chunks' ids, each taken from the library's model when it is first met. All other texts, texts
    that hold an added token of the file such as ``<|endoftext|>`` (which the library gives its own
    id), and all texts where the file has other rules, are encoded by the library in one piece. The memory
    has two generations of ``remember`` chunks each; chunks in use move to the younger one.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_chunk = named == ["NFC", "Replace", "Lowercase"] and cuts == [PRETOKEN, None]
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.odd = re.compile("|".join([PLAIN, *(f"(?i:{x})" for x in added)])).search
        self.ended = re.compile(r"([^\W\d_]+)([^\w\s']+)").fullmatch
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remember = remember

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, chunk: str) -> bytes:
        ids = self.young.get(chunk)
        if ids is not None:
            return ids
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self._piece(chunk)
            elif ended := self.ended(chunk):
                ids = self._learn(ended[1]) + self._piece(ended[2])
            else:
                ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self.young[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, without an end mark."""
        if not text:
            return b""
        if not self.by_chunk or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.young) > self.remember:
            self.old, self.young = self.young, {}
        chunks = text.lower().split()
        ids = list(map(self.young.get, chunks))
        if None in ids:
            for k, x in enumerate(ids):
                if x is None:
                    ids[k] = self._learn(chunks[k])
        return b"".join(ids)


@cache
def _encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, so that its memory outlives a task."""
    return ChunkEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its text's ids and then ``end_id``; null and empty texts are just ``end_id``.
    Documents longer than ``capacity`` are cut at its multiples. Every row is cut by itself, so
    repeated rows and ids give repeated pieces; an empty table gives none.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encoder = _encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                ids = encoder.encode(text) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row = (doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part))
                    for column, x in zip(out, row, strict=False):
                        column.append(x)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<u4").astype(np.int64))
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(out[5], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def _priced(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest worth of lengths (ascending, each as often as wanted) that fit, for every room up to ``capacity``."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        m = fits[room]
        best[room] = max(best[room - 1], (worth[:m] + best[room - sizes[:m]]).max()) if m else best[room - 1]
    return best


def _column(sizes: np.ndarray, worth: np.ndarray, best: np.ndarray, quota: np.ndarray, slack: float, rng: np.random.Generator) -> dict[int, int] | None:
    """A random configuration {place in sizes: times} within its quota and at most ``slack`` below the best worth."""
    room, found, spare = len(best) - 1, {}, quota.copy()
    while room and (m := int(np.searchsorted(sizes, room, side="right"))):
        loss = np.maximum(best[room] - worth[:m] - best[room - sizes[:m]], 0)
        odds = np.cumsum(np.where(loss <= slack + 1e-12, spare[:m] * sizes[:m], 0))
        if odds[-1] <= 0:
            break
        j = int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))
        slack -= loss[j]
        found[j] = found.get(j, 0) + 1
        spare[j] -= 1
        room -= int(sizes[j])
    return found if found and best[room] <= slack + 1e-12 else None


@dataclass
class Program:
    """A solution: configurations with copies, the pieces that no column covers, and a bound.

    ``bound`` is the greatest dual value met: no packing has fewer sequences.
    """

    columns: dict[tuple[tuple[int, int], ...], int]
    left: dict[int, int]
    bound: float
    rounds: int


def solve_program(histogram: dict[int, int], capacity: int, rounds: int = 600, width: float = 0.5, rate: float = 0.01, within: float = 0.002, rest: float = 0.1, misses: int = 100, seed: int = 7) -> Program:
    """The configuration program by multiplicative weights, all lengths priced in every round.

    A length's weight is its size, the dual of an unconstrained packing, times exp(rate * the share
    that is not covered yet). One knapsack program prices all lengths; then columns are drawn among
    the configurations within ``within`` of the best worth (relaxed by a quarter after a round that
    places less than 0.2 %), each for as many copies as keep every length's cover of this round
    within ``width`` of its count: the bounded width of the method. Copies are rounded down to whole
    sequences as they are taken, at least one, so the solution is whole and covers nothing twice.
    It ends when at most ``rest`` of the pieces are left. Columns number at most a few per length.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in sizes], dtype=np.int64)
    left, total, rng = counts.copy(), int(counts.sum()), np.random.default_rng(seed)
    base = sizes / capacity * (1 + 0.1 * sizes / capacity)
    columns: Counter = Counter()
    bound, done = -(-sum(int(k) * n for k, n in zip(sizes, counts.tolist(), strict=True)) // capacity), 0
    while left.sum() > rest * total and done < rounds:
        done += 1
        live = np.flatnonzero(left)
        here, share = sizes[live], left[live] / counts[live]
        worth = base[live] * np.exp(rate * (share - share.mean()))
        best = _priced(here, worth, capacity)
        if len(live) == len(sizes):
            bound = max(bound, float(counts @ worth) / best[-1])
        quota = np.minimum(left[live], np.maximum(1, counts[live] * width).astype(np.int64))
        before, missed = left.sum(), 0
        while missed < misses and quota.any():
            found = _column(here, worth, best, quota, within * best[-1], rng)
            if found is None:
                missed += 1
                continue
            copies = int(min(quota[j] // a for j, a in found.items()))
            for j, a in found.items():
                quota[j] -= a * copies
                left[live[j]] -= a * copies
            columns[tuple(sorted((int(here[j]), a) for j, a in found.items()))] += copies
        if before - left.sum() < 0.002 * total:
            within *= 1.25
    return Program(dict(columns), {int(k): int(n) for k, n in zip(sizes, left, strict=True) if n}, bound, done)


def plan_packing(histogram: dict[int, int], capacity: int = 4096, rest: float = 0.1) -> list[tuple[int, list[tuple[int, int]]]]:
    """Configurations [(copies, [(length, times), ...]), ...] that use the histogram up exactly.

    Pieces of the whole capacity stand alone, the configuration program places all but ``rest`` of
    the others, and these go by best fit, longest first, into the gaps and into new sequences.
    """
    histogram = {int(k): int(n) for k, n in histogram.items() if n > 0}
    whole = histogram.pop(capacity, 0)
    plan = [(whole, [(capacity, 1)])] if whole else []
    program = solve_program(histogram, capacity, rest=rest)
    return plan + best_fit(program.left, [(n, items) for items, n in program.columns.items()], capacity)


def best_fit(left: dict[int, int], bins, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of {length: n}, longest first, into ``bins`` [(copies, items), ...] and new ones.

    Equal bins are one entry with their number: a length fills the tightest entry's bins one after
    another, as best fit does, which makes at most three entries of one. So time and memory go by
    the numbers of configurations and lengths, not by the number of pieces.
    """
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, copies: int, items: tuple[tuple[int, int], ...]) -> None:
        if copies and room:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((copies, items))
        elif copies:
            out.append((copies, list(items)))

    for copies, items in bins:
        put(capacity - sum(k * a for k, a in items), copies, tuple(items))
    for size, n in sorted(left.items(), reverse=True):
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                copies, items = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, copies, items = capacity, n, ()
            each = room // size
            full = min(copies, n // each)
            put(room - each * size, full, (*items, (size, each)))
            copies, n = copies - full, n - full * each
            if copies and n:
                put(room - n * size, 1, (*items, (size, n)))
                copies, n = copies - 1, 0
            if items:
                put(room, copies, items)
    for room in rooms:
        out += [(copies, list(items)) for copies, items in open_bins[room]]
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset; the pieces
    of a sequence lie without gaps from 0. Null and empty texts are one end token. Repeated rows
    are packed once each; which of several pieces of equal doc_id, number and length gets which
    place is open. An empty table gives an empty table.
    """
    pieces = materialize(token_pieces(docs, path or tokenizer_path(), capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    entries, base = [], 0
    for copies, items in plan:
        offset = 0
        for size, times in sorted(items, reverse=True):
            entries.append((size, copies * times, times, base, offset))
            offset += size * times
        base += copies
    entries.sort()
    table = np.array(entries, dtype=np.int64).reshape(-1, 5)
    running = np.cumsum(table[:, 1]) - table[:, 1]
    opens = np.r_[True, table[1:, 0] != table[:-1, 0]][: len(table)]
    first = running - np.maximum.accumulate(np.where(opens, running, 0)) if len(table) else running
    keys = (table[:, 0] << 48) + first

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        e = np.searchsorted(keys, (size << 48) + r, side="right") - 1
        r = r - first[e]
        sequence = table[e, 3] + r // table[e, 2]
        offset = table[e, 4] + r % table[e, 2] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    rank = TMP + "rank"
    ranked = ranked_within(pieces, ["length"], [F.col("doc_id"), F.col("piece")], [F.col("doc_id"), F.col("piece")], rank, sum(histogram.values()))
    placed = ranked.withColumn(TMP + "at", place("length", rank))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col(TMP + "at.sequence_id"), F.col(TMP + "at.offset"))
