"""Language identification by interpolated Kneser-Ney character models.

Each language has an order-three model over lower-cased letters of all scripts at full width: an
n-gram is its code points of 21 bits each in one 64-bit number. Models are sorted arrays of hashed
n-grams with their probabilities and back-off weights. A text goes to the language of lowest
cross-entropy per symbol; the margin to the second, scaled by the text's length, is calibrated to
the probability of being right, below which the choice counts as rejected.

N-grams are counted in Spark over all texts, and a model keeps every trigram of its language that
they hold, 12 bytes each; an alphabetic language has some ten thousand.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc_mod
from tarnwick.llm.models import Isotonic

BITS = 21
MASK = (1 << BITS) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CACHE_BITS = 18


@cache
def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for all but letters, else the letter's lower-case code point."""
    table = np.zeros(0x110000, dtype=np.int32)
    for cp in range(0x110000):
        if (ch := chr(cp)).isalpha():
            table[cp] = ord(ch.lower()[0])
    return table


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts one after another, and where each begins (one more at the end).

    Runs of other characters become one 0; each text begins and ends with 0.
    """
    coded = [np.frombuffer(("\n" + (t or "") + "\n").encode("utf-32-le", "replace"), dtype="<u4") for t in texts]
    ends = np.cumsum([len(c) for c in coded])
    flat = symbol_table()[np.concatenate(coded)] if coded else np.zeros(0, dtype=np.int32)
    keep = flat != 0
    keep[1:] |= flat[:-1] != 0
    starts = np.r_[0, ends].astype(np.int64)
    keep[starts[:-1]] = True
    at = np.r_[0, np.cumsum(keep)]
    return flat[keep], at[starts]


def trigrams(flat: np.ndarray) -> np.ndarray:
    s = flat.astype(np.int64)
    return s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]


class _Sorted:
    """A map from whole numbers to floats as sorted arrays of hashes and values; the hash is one to one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys.astype(np.uint64) * _ODD
        order = np.argsort(hashed)
        self.hashes, self.values = hashed[order], values[order].astype(np.float32)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), default)
        hashed = keys.astype(np.uint64) * _ODD
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, self.values[at], default)


class KneserNey:
    """An interpolated Kneser-Ney model of order three from trigram counts.

    A fiftieth of the lowest order is for symbols: one part for each that was seen and one for the
    rest, so no text is impossible.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        pairs, two = np.unique(keys & (MASK << BITS | MASK), return_counts=True)  # different symbols before each pair
        letters, one = np.unique(pairs & MASK, return_counts=True)  # different symbols before each symbol
        self.unseen = 0.02 / (len(letters) + 1)
        p1 = 0.98 * one / max(1, one.sum()) + self.unseen
        d2 = self._discount(two)
        before, of = np.unique(pairs >> BITS, return_inverse=True)
        total2 = np.bincount(of, two, len(before))
        spare2 = d2 * np.bincount(of, minlength=len(before)) / np.maximum(total2, 1)
        p2 = np.maximum(two - d2, 0) / total2[of] + spare2[of] * p1[np.searchsorted(letters, pairs & MASK)]
        d3 = self._discount(counts)
        context, of3 = np.unique(keys >> BITS, return_inverse=True)
        total3 = np.bincount(of3, counts, len(context))
        spare3 = d3 * np.bincount(of3, minlength=len(context)) / np.maximum(total3, 1)
        p3 = np.maximum(counts - d3, 0) / total3[of3] + spare3[of3] * p2[np.searchsorted(pairs, keys & (MASK << BITS | MASK))]
        self.singles, self.spare_singles = _Sorted(letters, p1), _Sorted(before, spare2)
        self.pairs, self.spare_pairs, self.triples = _Sorted(pairs, p2), _Sorted(context, spare3), _Sorted(keys, p3)

    @staticmethod
    def _discount(counts: np.ndarray) -> float:
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def surprise(self, keys: np.ndarray) -> np.ndarray:
        """Minus log probability of each trigram's last symbol after its first two."""
        p = self.triples.get(keys, -1.0)
        new = np.flatnonzero(p < 0)
        if len(new):
            keys = keys[new]
            pair = keys & (MASK << BITS | MASK)
            lower = self.pairs.get(pair, -1.0)
            single = self.spare_singles.get(pair >> BITS, 1.0) * self.singles.get(pair & MASK, self.unseen)
            p[new] = self.spare_pairs.get(keys >> BITS, 1.0) * np.where(lower >= 0, lower, single)
        return -np.log(p)


class LanguageModel:
    """The models of all languages, with the calibration of their margins."""

    def __init__(self, names: list[str], models: list[KneserNey], calibrate: Isotonic | None = None, reject_below: float = 0.5):
        self.names, self.models, self.calibrate, self.reject_below = names, models, calibrate, reject_below
        self._known: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_known": None, "_table": None}

    def _surprise(self, keys: np.ndarray) -> np.ndarray:
        """(trigrams, languages); a table of places by hash remembers trigrams for the next texts."""
        if self._known is None:
            self._known = np.full(1 << _CACHE_BITS, -1, dtype=np.int64)
            self._table = np.zeros((1 << _CACHE_BITS, len(self.models)), dtype=np.float32)
        at = (keys.astype(np.uint64) * _ODD >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        out = self._table[at]
        miss = np.flatnonzero(self._known[at] != keys)
        if len(miss):
            new, of = np.unique(keys[miss], return_inverse=True)
            got = np.stack([m.surprise(new) for m in self.models], axis=1).astype(np.float32)
            out[miss] = got[of]
            # Of several trigrams of one place the last is remembered, the same for key and row.
            places, first = np.unique((new.astype(np.uint64) * _ODD >> np.uint64(64 - _CACHE_BITS)).astype(np.int64), return_index=True)
            self._known[places], self._table[places] = new[first], got[first]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean surprise per symbol (texts, languages) and the number of predicted symbols.

        Texts without a letter get number 0.
        """
        out, many = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") < 1 << 19):
                size += len(texts[end] or "")
                end += 1
            flat, starts = symbols_of(texts[at:end])
            sizes = np.diff(starts)
            letters = np.add.reduceat(flat != 0, starts[:-1])
            if len(flat) > 2 and self.models:
                got = self._surprise(trigrams(flat)).astype(np.float64)
                run = np.vstack([np.zeros(got.shape[1]), np.cumsum(got, axis=0)])
                lo = np.minimum(starts[:-1], len(run) - 1)
                hi = np.maximum(np.minimum(starts[1:] - 2, len(run) - 1), lo)
                out[at:end] = (run[hi] - run[lo]) / np.maximum(1, hi - lo)[:, None]
            many[at:end] = np.where(letters > 0, sizes - 2, 0)
            at = end
        return out, many

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score per text; ``und`` and 0 without letters or languages.

        Equal cross-entropies go to the language that comes first by name.
        """
        h, n = self.entropies(texts)
        if not self.models:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = h.argmin(axis=1)
        score = np.ones(len(texts))
        if self.calibrate is not None:
            score = self.calibrate(margin(h, n))
        return ["und" if not m else self.names[b] for m, b in zip(n.tolist(), best.tolist(), strict=True)], np.where(n > 0, score, 0.0)


def margin(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gap of the two lowest cross-entropies, times the root of the length."""
    if h.shape[1] < 2:
        return np.full(len(h), 10.0)
    low = np.sort(h, axis=1)[:, :2]
    return (low[:, 1] - low[:, 0]) * np.sqrt(np.maximum(n, 0))


def fit_languages(docs: DataFrame, folds: int = 3, held_out: int = 1, calibrate_on: int = 4000, reject_below: float = 0.5,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count the trigrams of every text of known language outside the held-out fold, and fit.

    One text in twenty, by a hash of its id, is the calibration fold: at most ``calibrate_on`` of
    these, in the order of a hash, are judged by models counted on the other nineteen, and their
    margins calibrate the scores. The models that are returned count all texts. Null languages,
    null texts and rows without an id teach nothing, repeated rows teach each time; a table that
    teaches nothing gives a model that knows no language.
    """
    doc = F.col(id_col)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(crc_mod(doc, folds) != held_out, F.lit(False)))
    aside = F.pmod(F.xxhash64(doc, F.lit("aside")), F.lit(20)) == 0
    known = known.select(doc.alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), aside.alias("aside"))
    keep_pairs = 2_000_000

    def count(batches):
        seen: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def rows(of, keys, n):
            return pa.RecordBatch.from_pydict({"lang": pa.array([of[0]] * len(keys), pa.string()), "aside": pa.array([of[1]] * len(keys), pa.bool_()), "key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            by: dict[tuple[str, bool], list[str]] = {}
            for lang, text, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault((lang, far), []).append(text)
            for of, texts in by.items():
                lo = 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 19):
                        size += len(texts[hi])
                        hi += 1
                    flat, _ = symbols_of(texts[lo:hi])
                    lo = hi
                    if len(flat) > 2:
                        parts = seen.setdefault(of, [])
                        parts.append(np.unique(trigrams(flat), return_counts=True))
                        if sum(len(k) for k, _ in parts[1:]) > max(1 << 19, len(parts[0][0])):
                            parts[:] = [merged(parts)]
                            if len(parts[0][0]) > keep_pairs:
                                yield rows(of, *parts[0])
                                del seen[of]
        for of, parts in seen.items():
            yield rows(of, *merged(parts))

    counts = known.select("lang", "text", "aside").mapInArrow(count, "lang string, aside boolean, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("aside"), F.col("n")).otherwise(0)).alias("part"))
    got = counts.select("lang", "key", "n", "part").orderBy("lang", "key").toArrow()
    langs, keys, n, part = (got.column(c).to_numpy() for c in ("lang", "key", "n", "part"))
    names = sorted(set(langs.tolist()))
    mine = [langs == name for name in names]
    model = LanguageModel(names, [KneserNey(keys[m], n[m]) for m in mine], None, reject_below)
    if not names:
        return model
    others = LanguageModel(names, [KneserNey(keys[m & (part > 0)], part[m & (part > 0)]) for m in mine])

    @F.arrow_udf("struct<m: double, best: string>")
    def judged(texts: pa.Array) -> pa.Array:
        listed = texts.to_pylist()
        h, many = others.entropies(listed)
        return pa.StructArray.from_arrays([pa.array(np.where(many > 0, margin(h, many), -1.0)), pa.array([names[b] for b in h.argmin(axis=1)], pa.string())], ["m", "best"])

    some = known.where("aside").select("doc_id", "lang").orderBy(F.xxhash64("doc_id", F.lit("calibrate")), "doc_id").limit(calibrate_on)
    chosen = known.where("aside").join(F.broadcast(some.select(F.col("doc_id").alias("chosen")).distinct()), F.col("doc_id") == F.col("chosen"))
    rows = chosen.select("lang", judged("text").alias("j")).where("j.m >= 0").select("j.m", (F.col("j.best") == F.col("lang")).cast("double").alias("ok")).toArrow()
    if rows.num_rows:
        model.calibrate = Isotonic(rows.column("m").to_numpy(), rows.column("ok").to_numpy())
    return model


def identify(docs: DataFrame, model: LanguageModel, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Otherwise
    lang_pred is the nearest language even where the calibrated score falls below the model's
    limit and ``rejected`` is true. Repeated rows get equal answers; an empty table gives an empty table.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["lang", "score"])

    doc = F.col(id_col)
    found = docs.select(doc.alias("doc_id"), F.coalesce(crc_mod(doc, folds) == held_out, F.lit(False)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), (F.col("p.score") < model.reject_below).alias("rejected"))
