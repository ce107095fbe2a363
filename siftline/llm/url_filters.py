"""URL filters: gradient-boosted trees on lexical features, behind a list of allow and block rules.

URLs that a rule decides are the labelled ones. How often each host suffix is blocked is counted over all of them. Trees
are grown on a bounded sample, by histograms of the features, each tree fitting the gradient of the logistic loss by Newton
steps; they judge the URLs that no rule fits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import land, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled URLs that the trees are grown on, at most: those of the smallest hashes.
SAMPLE = 20_000
#: Labelled URLs of a suffix whose rate counts, at least, and how many URLs of the mean rate are added to them.
LEAST, SMOOTH = 5, 20.0
#: Parts of the rows of one suffix, joined with its rate by tasks of their own.
SALTS = 16
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "hyphens", "has_fragment", "secure", "extension", "longest_part", "vowel_ratio", "suffix_rate", "suffix_seen")


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? or #, A-Z lower-cased; empty without ://, and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host, then path from the first /) that fits, or null. Rules are a short list of the caller's."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    """The host's last label and last two labels."""
    parts = host.rsplit(".", 2)
    return parts[-1], ".".join(parts[-2:])


def lexical(url: str | None) -> tuple[list[float], str]:
    """Features but the suffix statistics, and the host."""
    url = url or ""
    _, found, rest = url.partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", rest, re.S) if found else re.match(r"()()()()", "")
    host, path, query, fragment = (m[k] or "" for k in (1, 2, 3, 4))
    host = host.lower()
    parts = re.split(r"[^a-z]+", url.lower())
    digits = sum(map(str.isdigit, url))
    letters = sum(map(str.isalpha, host))
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / max(1, len(url)), sum(map(str.isdigit, host)) / max(1, len(host)), _entropy(url), _entropy(host),
        query.count("&") + (len(query) > 1), url.count("-"), bool(fragment), url[:6].lower() == "https:", "." in path.rsplit("/", 1)[-1], max(map(len, parts)), sum(map(host.count, "aeiou")) / max(1, letters),
    ], host


@dataclass
class Model:
    """Trees as arrays: at each node a feature, a threshold (x <= it goes left) and either child or, in leaves, a value."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    rates: dict[str, tuple[float, int]] = field(default_factory=dict)
    prior: float = 0.0

    def features(self, urls, known=None) -> np.ndarray:
        """known: suffix_rate and suffix_seen of each URL, unless the model's own rates are to be used."""
        rows = []
        for k, url in enumerate(urls):
            x, host = lexical(url)
            rate, seen = known[k] if known is not None else next((self.rates[s] for s in reversed(suffixes(host)) if s in self.rates), (self.prior, 0))
            rows.append([*x, rate, seen > 0])
        return np.array(rows, float).reshape(-1, len(FEATURES))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of block."""
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = np.flatnonzero(inner)
                node = at[go]
                at[go] = np.where(x[go, feature[node]] <= threshold[node], left[node], right[node])
            out += value[at]
        return out

    def blocks(self, urls, known=None) -> np.ndarray:
        return self.scores(self.features(urls, known)) > 0


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int, ridge: float = 1.0) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, level: int) -> int:
        k = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, -1, -1, -rate * G / (H + ridge)])
        if level == depth or len(rows) < 2 * least:
            return k
        best, found = 1e-6, None
        for f in range(x.shape[1]):
            size = len(cuts[f]) + 1
            if size < 2:
                continue
            b = bins[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = np.where((nl >= least) & (len(rows) - nl >= least), gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge), 0)
            if gain.max() > best:
                best, found = float(gain.max()), (f, int(gain.argmax()))
        if found:
            f, cut = found
            goes = bins[rows, f] <= cut
            nodes[k][:2] = f, cuts[f][cut]
            nodes[k][2] = node(rows[goes], level + 1)
            nodes[k][3] = node(rows[~goes], level + 1)
        return k

    node(np.arange(len(x)), 0)
    feature, threshold, left, right, value = zip(*nodes)
    return np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float)


def train(urls: list[str], blocked: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = LEAST, smooth: float = SMOOTH, known=None) -> Model | None:
    """A model from labelled URLs; None if either label is missing. known: as in Model.features."""
    blocked = np.asarray(blocked, float)
    if not len(blocked) or blocked.min() == blocked.max():
        return None
    prior = blocked.mean()
    sums: dict[str, list[float]] = {}
    for url, y in zip(urls, blocked) if known is None else ():
        for s in set(suffixes(lexical(url)[1])):
            c = sums.setdefault(s, [0.0, 0])
            c[0] += y
            c[1] += 1
    model = Model(math.log(prior / (1 - prior)), rates={s: ((y + smooth * prior) / (n + smooth), n) for s, (y, n) in sums.items() if n >= least}, prior=prior)
    x = model.features(urls, known)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    score = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, binned, cuts, p - blocked, p * (1 - p), depth, rate, least)
        model.trees.append(tree)
        score += Model(trees=[tree]).scores(x)
    return model


def suffix_rates(labelled: DataFrame, prior: float) -> DataFrame:
    """suffix, rate of each suffix of at least LEAST of the labelled (url, blocked) rows: all of them, each URL once."""
    host = host_of(F.col("url"))
    both = F.array_distinct(F.array(*(F.substring_index(host, ".", -k) for k in (1, 2))))
    counted = labelled.select("blocked", F.explode(both).alias("suffix")).groupBy("suffix").agg(F.sum("blocked").alias("y"), F.count(F.lit(1)).alias("n"))
    rate = (F.col("y") + F.lit(SMOOTH * prior)) / (F.col("n") + F.lit(SMOOTH))
    return land(counted.where(F.col("n") >= LEAST).select("suffix", rate.alias("rate")), "url-suffixes")


def with_rates(rows: DataFrame, rates: DataFrame, url: str) -> DataFrame:
    """rows with _rate: that of the URL's last two host labels, else of the last one, else null."""
    host = host_of(F.col(url))
    x = rows.withColumn("_salt", F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int"))
    for k in (1, 2):
        x = x.withColumn(f"_s{k}", F.substring_index(host, ".", -k))
        salted = rates.select(F.col("suffix").alias(f"_s{k}"), F.col("rate").alias(f"_r{k}"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        x = x.join(salted, [f"_s{k}", "_salt"], "left")
    return x.withColumn("_rate", F.coalesce("_r2", "_r1")).select(*rows.columns, "_rate")


def learned(labelled: DataFrame, rates: DataFrame, prior: float, sample: int = SAMPLE, **options) -> Model | None:
    """A model from labelled (url, blocked; each URL once), of which the URLs of the smallest hashes are used to fit it, sample at
    most. Others don't leave their tasks."""
    n = labelled.count()
    share = min(1_000_000, -(-1_100_000 * sample // max(1, n)))  # of a million; one in ten more than needed
    some = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < share).select("url", "blocked", F.xxhash64("url").alias("h")).limit(2 * sample)
    rows = sorted(sorted(with_rates(some, rates, "url").collect(), key=lambda r: (r["h"] % 1_000_000, r["url"]))[:sample], key=lambda r: r["url"])
    return train([r["url"] for r in rows], np.array([r["blocked"] for r in rows]), known=[known(r["_rate"], prior) for r in rows], **options)


def known(rate: float | None, prior: float) -> tuple[float, bool]:
    """suffix_rate and suffix_seen."""
    return (prior, False) if rate is None or rate != rate else (rate, True)


def judge(pages: DataFrame, columns: list[str], rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """columns of pages, host, path, rule and verdict of every row's url; columns of these four names are replaced.

    A null url or one without :// has an empty host and path; no rule fits it, and the trees judge it as they do any
    other. Without labels of both kinds, what no rule decides is allowed. Repeated rows stay, though a URL counts once in
    what is learned; URLs may be of any length; other columns may have any names; an empty table gives no rows.
    """
    sc = pages.sparkSession.sparkContext
    columns = [c for c in columns if c.lower() not in ("host", "path", "rule", "verdict")]
    kept = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None)
    x = pages.select(kept.alias("row"), F.col("url").cast("string").alias("url"))
    x = x.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocking = [r for v, r in rules if v == "block"]
    blocked = F.col("rule").isin(blocking) if blocking else F.lit(False)
    labelled = x.where(F.col("rule").isNotNull() & F.col("url").isNotNull()).groupBy("url").agg(F.max(blocked.cast("int")).alias("blocked"))
    labelled = land(labelled, "url-labels")
    prior = labelled.agg(F.avg("blocked")).first()[0] or 0.0
    rates = suffix_rates(labelled, prior)
    model = sc.broadcast(learned(labelled, rates, prior, sample))

    @F.pandas_udf("boolean")
    def by_trees(open_, urls, rate):
        import pandas as pd

        m, out = model.value, np.zeros(len(urls), bool)
        at = np.flatnonzero(open_)
        if m and len(at):
            out[at] = m.blocks([urls.iloc[k] for k in at], [known(rate.iloc[k], prior) for k in at])
        return pd.Series(out, index=urls.index)

    x = with_rates(x, rates, "url")
    free = F.col("rule").isNull()  # rows that a rule decides go to the trees empty
    verdict = F.when(~free, F.when(blocked, "block").otherwise("allow")).when(by_trees(free, F.when(free, F.col("url")), "_rate"), "block").otherwise("allow")
    return x.withColumn("verdict", verdict).select(*(F.col(f"row.`{c}`").alias(c) for c in columns), "host", "path", "rule", "verdict")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs."""
    return judge(table(spark, sf_dir, "pages"), ["page_id"])
