"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

The features are densities of a fixed and of a learned lexicon, how near hits stand to the second
person, capitals, punctuation and obfuscation. Half of a bounded labelled sample teaches the
lexicon (words and word beginnings that toxic texts have and others lack), the other half the
trees; the scores of trees on folds that they have not seen calibrate the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import crc_mod, each
from tarnwick.llm.labelled import labelled_sample
from tarnwick.llm.models import BoostedTrees, Isotonic

#: Insults and slights. Fixed values.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers pathetic worthless trash garbage scum clown disgusting "
    "ugly filthy vile imbecile jerk creep freak coward liar pig rat vermin hate kill die shut crap damn hell bastard".split()
)
#: Words that address the reader, in a few languages. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split())
#: Signs that stand in for letters. Fixed values.
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FEATURES = ("fixed_rate", "fixed_hits", "learned_rate", "learned_hits", "learned_top", "near_second_person", "second_person", "capitals", "punctuation", "obfuscated", "obfuscated_hits", "log_words")
_STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")
#: Words of letters and stand-ins with a letter right behind one of these; possessive, so linear in a word of any length.
_MIXED = re.compile(r"(?<!\S)[a-z]*+[0-9@$*!._-]++[a-z][a-z0-9@$*!._-]*+(?=[,;:?\"')\]]*+(?!\S))")
_CAPITALS = bytes(range(65, 91))


@cache
def _capital_points() -> np.ndarray:
    """True for the code points that are upper case."""
    return np.fromiter((chr(cp).isupper() for cp in range(0x110000)), dtype=bool, count=0x110000)


def capitals(text: str) -> int:
    """Upper-case characters, of any script; of ASCII texts these are the letters A-Z."""
    if text.isascii():
        return len(text) - len(text.encode().translate(None, _CAPITALS))
    return int(_capital_points()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")].sum())


def keys_of(word: str) -> list[str]:
    """What the learned lexicon may know a word by: itself and its beginnings."""
    return [word, *(word[:k] + "-" for k in _STEMS if len(word) > k)]


def learn_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, most: int = 2000, least: int = 3) -> dict[str, float]:
    """The ``most`` keys with the greatest cautious log-odds of being in a toxic text."""
    found = []
    for key, n in toxic.items():
        if n < least:
            continue
        low = max(0.1, n - 1.5 * math.sqrt(n))
        weight = math.log(low / max(1, n_toxic)) - math.log((clean.get(key, 0) + 0.5) / max(1, n_clean))
        if weight > 1.5:
            found.append((-weight, key))
    return {key: -w for w, key in sorted(found)[:most]}


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """Dense features of one whole text, in the order of FEATURES; null counts as empty."""
    text = text or ""
    low = text.lower()
    ws = _WORD.findall(low)
    n = max(1, len(ws))
    fixed = [i for i, w in enumerate(ws) if w in LEXICON]
    second = [i for i, w in enumerate(ws) if w in SECOND_PERSON]
    weights: dict[str, float] = {}
    if learned:
        for w in set(ws):
            best = max([learned.get(k, 0.0) for k in keys_of(w)])
            if best:
                weights[w] = best
    hits = [i for i, w in enumerate(ws) if w in weights] if weights else []
    near = 0.0
    if second and (fixed or hits):
        at = np.array(second)
        for i in {*fixed, *hits}:
            k = int(np.searchsorted(at, i))
            gap = min(abs(int(at[j]) - i) for j in (k - 1, k) if 0 <= j < len(at))
            near += 1 / (1 + gap)
    masked = [m for m in _MIXED.findall(low) if len(m) > 2]
    plain = [m.strip("!.-_*").translate(_PLAIN) for m in masked]
    bad = sum(m in LEXICON or any(k in learned for k in keys_of(m)) for m in plain if m)
    letters = max(1, sum(map(len, ws)))
    return [
        1000 * len(fixed) / n, math.log1p(len(fixed)), 1000 * sum(weights[ws[i]] for i in hits) / n, math.log1p(len(hits)), max(weights.values(), default=0.0),
        near, 1000 * len(second) / n, capitals(text) / letters, sum(map(text.count, "!?.,;:")) / n, 1000 * len(masked) / n, math.log1p(bad), math.log1p(len(ws)),
    ]


class ToxicityModel:
    """A learned lexicon, boosted trees over FEATURES and the calibration of their scores."""

    def __init__(self, learned: dict[str, float], trees: BoostedTrees | None, calibrate: Isotonic | None, prior: float):
        self.learned, self.trees, self.calibrate, self.prior = learned, trees, calibrate, prior

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.learned) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        if self.trees is None:
            return np.full(len(x), self.prior)
        return self.calibrate(self.trees.raw(x))


def fit_trees(x: np.ndarray, y: np.ndarray, fold: np.ndarray, learned: dict[str, float], folds: int = 4) -> ToxicityModel:
    """Boost on all rows, and calibrate on scores of trees that did not see the row."""
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(learned, None, None, prior)
    out = np.zeros(len(y))
    for k in range(folds):
        test = fold % folds == k
        if test.any() and not test.all():
            out[test] = BoostedTrees().fit(x[~test], y[~test]).raw(x[test])
    return ToxicityModel(learned, BoostedTrees().fit(x, y), Isotonic(out, y), prior)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 10_000, folds: int = 5, held_out: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold.

    Null texts count as empty, rows without an id or a label of 0 or 1 teach nothing, a repeated
    row teaches as often as it occurs, and ties in the sample's order go to the smaller id.
    Without labels, or with one class only, the model is that share of toxic rows.
    """
    sample = labelled_sample(docs, labels, label, per_class, folds, held_out, id_col, text_col)

    def count(batches):
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({k for w in set(_WORD.findall((text or "").lower())) for k in keys_of(w)})
                seen[y][""] += 1
        keys = sorted({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "clean": pa.array([seen[0][k] for k in keys], pa.int64()), "toxic": pa.array([seen[1][k] for k in keys], pa.int64())})

    teach = sample.where("fold < 5").select("text", "y").mapInArrow(count, "key string, clean long, toxic long")
    counted = teach.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("key = '' or toxic >= 3 and toxic > 0.2 * clean").toArrow().to_pydict()
    toxic, clean = dict(zip(counted["key"], counted["toxic"], strict=True)), dict(zip(counted["key"], counted["clean"], strict=True))
    n_toxic, n_clean = toxic.pop("", 0), clean.pop("", 0)
    learned = learn_lexicon(toxic, clean, n_toxic, n_clean)

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, learned) for t in each(texts)], pa.list_(pa.float64()))

    got = sample.where("fold >= 5").select("doc_id", "y", "fold", measured("text").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, got.column("y").to_numpy().astype(float), got.column("fold").to_numpy(), learned)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, folds: int = 5, held_out: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts are scored by their (zero) features like any other; repeated rows get
    equal scores; an empty table gives an empty table; a null id is held out of nothing.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(each(texts)))

    doc = F.col(id_col)
    scored = docs.select(doc.alias("doc_id"), F.coalesce(crc_mod(doc, folds) == held_out, F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
