"""Quality rules combined by weak supervision, with DataFrame operations only.

Each rule votes that a document is fit (1), votes that it is not (0), or abstains. The votes of
all documents are counted by pattern, expectation-maximisation over those counts estimates the
prior and how often each rule gives each vote for fit and for unfit documents, and the posterior
probability of being fit decides instead of a demand that all rules pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import TMP, let, materialize

SPLIT = "[ \\x09-\\x0D]+"
#: Frequent function words of a few languages. Fixed values.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with be at by this from "
    "de la le les des et du en que el los las del se un una por con para "
    "der die und den das von zu mit sich ist im dem nicht ein eine auf"
).split()


def _repeat_words(ws: Column, width: int = 5) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the same text.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Texts whose windows all
    differ, nearly all texts, stop after one hash-set pass; the others sort their windows once, so
    that a text of nothing but repeats costs n log n as well.
    """
    windows = F.size(ws) - (width - 1)
    hashed = F.transform(ws, lambda w: F.xxhash64(w))

    def of_windows(hw: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hw) - width), lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(width)]))

    def of_hashes(h: Column) -> Column:
        def repeated(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                return ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def covered(starts: Column) -> Column:
            zero = F.named_struct(F.lit("n"), F.lit(0).cast("long"), F.lit("last"), F.lit(-width))
            return F.aggregate(
                starts,
                zero,
                lambda a, i: F.named_struct(F.lit("n"), a["n"] + F.least(F.lit(width), i - a["last"]), F.lit("last"), i),
                lambda a: a["n"],
            )

        placed = F.sort_array(F.transform(h, lambda x, i: F.named_struct(F.lit("h"), x, F.lit("i"), i)))
        many = let(let(placed, repeated), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(many)

    counted = let(let(hashed, of_windows), of_hashes)
    return F.when(windows < 2, F.lit(0).cast("long")).otherwise(counted)


def base_measures(text: Column) -> Column:
    """A struct of the base counts of one whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))

    def counted(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeat_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
        )

    def lined(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    worded = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    return F.struct(
        let(F.filter(F.split(t, SPLIT), lambda w: w != ""), counted).alias("w"),
        let(worded, lined).alias("l"),
        F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace(t, "[^!?]+", "")).cast("long").alias("n_marks"),
        F.char_length(F.regexp_replace(t, "[^0-9]+", "")).cast("long").alias("n_digits"),
    )


@dataclass(frozen=True)
class Rule:
    """A vote for a document: fit where ``fit`` holds, unfit where ``unfit`` holds, else none.

    ``false_alarms`` is the share of fit documents that it is expected to call unfit.
    """

    name: str
    unfit: str
    fit: str
    false_alarms: float = 0.05


#: Rates are per word, so that a rule says the same of a short and of a long text.
RULES = (
    Rule("symbols", "n_symbols > 0.15 * n_words", "n_symbols <= 0.03 * n_words", 0.003),
    Rule("capitals", "n_upper > 0.4 * word_chars", "n_upper <= 0.15 * word_chars", 0.003),
    Rule("marks", "n_marks > 0.2 * n_words", "n_marks <= 0.05 * n_words", 0.003),
    Rule("repeats", "n_repeat_words > 0.12 * n_words", "n_repeat_words <= 0.04 * n_words"),
    Rule("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("digits", "n_digits > 0.2 * word_chars", "n_digits <= 0.05 * word_chars"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 11 * n_words"),
    Rule("function_words", "n_words >= 40 and n_function_words < 0.02 * n_words", "n_function_words >= 0.08 * n_words"),
)


@dataclass
class VoteModel:
    """Prior of fitness and, per rule, the probabilities of (unfit, fit, no) votes by class."""

    prior: float = 0.85
    fit: list[list[float]] = field(default_factory=list)
    unfit: list[list[float]] = field(default_factory=list)
    rounds: int = 0

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(f[v] / u[v]) for f, u, v in zip(self.fit, self.unfit, pattern, strict=True))


def fit_votes(patterns: dict[tuple[int, ...], int], rules: tuple[Rule, ...] = RULES, rounds: int = 200, tolerance: float = 1e-9, trust: tuple[float, float] = (1.0, 0.5)) -> VoteModel:
    """Expectation-maximisation over pattern counts; a vote is 0 unfit, 1 fit, 2 none.

    Each rule's votes have a Dirichlet prior for either class. Its mean for fit documents is
    (false_alarms, 0.8 - false_alarms, 0.2), which also settles which class is the fit one, and for
    unfit ones (0.3, 0.4, 0.3); its weight is ``trust`` times the documents of the class, so that it
    says the same of a small and of a large corpus, and one pseudo-vote more of each kind. The
    estimates are the posterior modes; nothing else bounds them.
    """
    total = sum(patterns.values())
    prior_fit = [(r.false_alarms, 0.8 - r.false_alarms, 0.2) for r in rules]
    prior_unfit = (0.3, 0.4, 0.3)
    model = VoteModel(fit=[list(x) for x in prior_fit], unfit=[list(prior_unfit) for _ in rules])
    last = -math.inf
    for model.rounds in range(1, rounds + 1 if total else 1):
        weight, likelihood = {}, 0.0
        for p, n in patterns.items():
            x = model.log_odds(p)
            weight[p] = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
            log_unfit = math.log(1 - model.prior) + sum(math.log(u[v]) for u, v in zip(model.unfit, p, strict=True))
            likelihood += n * (log_unfit + max(x, 0.0) + math.log1p(math.exp(-abs(x))))
        if abs(likelihood - last) < tolerance * total:
            break
        last = likelihood
        fit_total = sum(weight[p] * n for p, n in patterns.items())
        model.prior = (fit_total + 1) / (total + 2)
        for r in range(len(rules)):
            good = [1 + trust[0] * fit_total * x for x in prior_fit[r]]
            bad = [1 + trust[1] * (total - fit_total) * x for x in prior_unfit]
            for p, n in patterns.items():
                good[p[r]] += weight[p] * n
                bad[p[r]] += (1 - weight[p]) * n
            model.fit[r], model.unfit[r] = [x / sum(good) for x in good], [x / sum(bad) for x in bad]
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, label: str = "rules", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Base counts, votes, posterior and verdict of every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, posterior and one vote_<rule> per rule (null: none). base_failed holds for fewer than 10
    words or over 20 % repeated words; such rows are never kept, and their votes take part in the
    estimate like all others. Null, empty and wordless texts have all counts zero and fail.
    Repeated rows count as often as they occur; an empty table gives an empty table. Named columns
    in ``keep`` go along and come last.
    """
    measures = materialize(docs.select(F.col(id_col).alias("doc_id"), base_measures(F.col(text_col)).alias("m"), *keep), label)
    along = measures.columns[2:]
    counts = measures.select("doc_id", *along, "m.w.*", "m.l.*", *["m." + c for c in ("n_symbols", "n_upper", "n_marks", "n_digits")])
    votes = [F.when(F.expr("n_words = 0"), 2).when(F.expr(r.unfit), 0).when(F.expr(r.fit), 1).otherwise(2).alias("v_" + r.name) for r in rules]
    voted = counts.select("*", *votes)
    names = ["v_" + r.name for r in rules]
    patterns = {tuple(r[n] for n in names): r["count"] for r in voted.groupBy(*names).count().collect()}
    model = fit_votes(patterns, rules)
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, f, u in zip(names, model.fit, model.unfit, strict=True):
        step = [math.log(f[v] / u[v]) for v in range(3)]
        odds = odds + F.when(F.col(name) == 0, step[0]).when(F.col(name) == 1, step[1]).otherwise(step[2])
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    posterior = 1 / (1 + F.exp(-odds))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                        (~failed & (posterior >= threshold)).alias("kept"), posterior.alias("posterior"),
                        *[F.when(F.col(n) < 2, F.col(n)).alias(n.replace("v_", "vote_", 1)) for n in names], *along)


def keep_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept by ``judge``; all columns stay.

    Each row is judged and kept by itself: rows that share an id, or have none, get the verdict of
    their own text, and repeated rows stay or go together. The rows are written once beside their
    counts, so that no text is shuffled. An empty table gives an empty table.
    """
    return judge(docs, id_col, text_col, keep=(F.struct(*docs.columns).alias(TMP + "row"),)).where("kept").select(TMP + "row.*")
