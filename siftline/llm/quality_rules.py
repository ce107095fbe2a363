"""Quality rules: learned decision lists over statistics of a text, all in Spark's own expressions.

Sequential covering on labelled statistics: a rule grows by the threshold of highest information gain on two thirds of the
rows, is pruned from its end on the last third, and joins the list if it is precise enough there; the rows it covers leave,
and the next rule is learned from the rest. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

WINDOW = 5
#: Labelled rows that the rules are learned from, at most: those of the smallest hashes of doc_id.
SAMPLE = 6000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols_a_word", "dup_lines_a_word", "repeated_share", "capitals_share", "marks_a_word", "digits_a_word")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words inside windows (their hashes in order) that occur twice or more."""
    rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
        marked = F.transform(s, lambda x, k: F.when(((k > 0) & same(x, k - 1)) | same(x, k + 1), x["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    return let(rows, lambda s: F.aggregate(positions(s), start, step)["n"])


def _repeat_words(words: Column) -> Column:
    """words: a bound variable or an attribute, not an expression."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))))


def _occurrences(text: Column, kind: str) -> Column:
    """How many characters of a class a text has."""
    return (F.size(F.split(text, kind, -1)) - 1).cast("long")


def statistics(text: Column) -> Column:
    """A struct of BASE and the other counts that rules use. It is one expression, whose parts are bound by let: filters
    may be pushed below it without its parts being computed for each use.

    A null text has no words. Windows are told apart by 64-bit hashes of their words.
    """

    def of(t: Column, words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            _occurrences(t, "[#*$%&|<>]").alias("n_symbols"),
            let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long")).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _occurrences(t, "[A-Z]").alias("n_capitals"),
            _occurrences(t, "[!?]").alias("n_marks"),
            _occurrences(t, "[0-9]").alias("n_digits"),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), lambda words: of(t, words)))


def features(s: Column) -> dict[str, Column]:
    """The numbers that rules compare, from a struct of statistics."""
    c = lambda n: s[n].cast("double")
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    values = (c("n_words"), c("word_chars") / words, c("n_symbols") / words, c("n_dup_lines") / words, c("n_repeat_words") / words, c("n_capitals") / chars, c("n_marks") / words, c("n_digits") / words)
    return dict(zip(FEATURES, values))


@dataclass(frozen=True)
class Rule:
    """feature, whether it must be at least the threshold (else at most), threshold; all must hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, least, at in self.terms:
            out &= x[name] >= at if least else x[name] <= at
        return out

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, least, at in self.terms:
            out = out & (values[name] >= at if least else values[name] <= at)
        return out

    def __str__(self):
        return " and ".join(f"{n} {'>=' if least else '<='} {at:.6g}" for n, least, at in self.terms)


def _best_term(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold of the highest gain p * (log2(p/(p+n)) - log2(P/(P+N))), halfway between neighbouring values."""
    P, N = int(bad.sum()), int((~bad).sum())
    best, found = 1e-9, None
    for name in x:
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        for least in (True, False):
            p = P - b[cuts] if least else b[cuts]
            n = (len(v) - 1 - cuts - p) if least else cuts + 1 - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(P / (P + N))), 0)
            if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > best:
                best, found = float(gain[k]), (name, least, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best, found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_terms: int = 4, least_covered: int = 3) -> list[Rule]:
    """Rules that cover bad rows. x: features, in an order that is independent of the labels; every third row prunes.

    Without rows of either class there are no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prune = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~prune).any() and (~bad & left & ~prune).any():
        inside, terms = left & ~prune, []
        while len(terms) < most_terms and (bad & inside).any() and (~bad & inside).any():
            _, term = _best_term({k: v[inside] for k, v in x.items()}, bad[inside])
            if term is None:
                break
            terms.append(term)
            inside = inside & Rule((term,)).covers(x)
        if not terms:
            break

        def worth(r: Rule) -> float:
            c = r.covers(x) & left & prune
            p, n = int((bad & c).sum()), int((~bad & c).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((Rule(tuple(terms[:k])) for k in range(len(terms), 0, -1)), key=worth)
        c = rule.covers(x) & left
        held = c & prune
        if c.sum() < least_covered or bad[c].mean() < precision or held.any() and bad[held].mean() < precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def decision_list(rules: list[Rule], values: dict[str, Column]) -> Column:
    """False for the first rule that holds, true if none does."""
    out = None
    for r in rules:
        out = F.when(r.column(values), F.lit(False)) if out is None else out.when(r.column(values), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learned_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> list[Rule]:
    """Rules from docs' statistics and labels (doc_id, quality; the lowest of several; null: not labelled).

    The sample bounds what is broadcast and what the driver gets; it doesn't depend on how the tables are dealt.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.min("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("_doc"), "_doc").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_doc")).select("doc_id", "_quality", statistics(F.col("text")).alias("s"))
    row = F.struct(*(v.alias(k) for k, v in features(F.col("s")).items()))
    got = rows.select("doc_id", "_quality", row.alias("x")).groupBy("doc_id", "_quality").agg(F.max("x").alias("x")).select("doc_id", "_quality", "x.*").collect()  # of repeated ids one, so a row for each label
    got = sorted(got, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 & (2**64 - 1), r["doc_id"]))
    x = {k: np.array([r[k] for r in got], float) for k in FEATURES}
    return learn(x, np.array([r["_quality"] == 0 for r in got], bool), **options)


def judgement(text: Column, rules: list[Rule]) -> Column:
    """A struct of BASE, base_failed and kept."""

    def of(s: Column) -> Column:
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        return F.struct(*(s[n].alias(n) for n in BASE), failed.alias("base_failed"), (~failed & decision_list(rules, features(s))).alias("kept"))

    return let(statistics(text), of)


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns as they are, that neither the base rules nor the learned list reject.

    Null and empty texts have no words and are rejected; very long texts are judged whole; repeated rows have one verdict
    and stay or go together; other columns may have any names; an empty table, or labels of one kind, give no learned rules.
    """
    return docs.where(judgement(F.col("text"), learned_rules(docs, labels, **options))["kept"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base statistics, base verdict and the verdict with the learned list."""
    docs = table(spark, sf_dir, "documents")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", judgement(F.col("text"), rules).alias("j")).select("doc_id", "j.*")
