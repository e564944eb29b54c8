"""Quality classifier as a sparse rule ensemble (operator 5).

Small trees are grown on statistics of labelled texts; every path from a root is a conjunctive rule; a
lasso logistic regression keeps few of them; the rules and their weights are compiled into one Spark
column, so scoring is an ordinary projection without Python.

The fit reads a bounded sample: at most ``SAMPLE`` labelled documents outside the held-out fold, those
with the smallest hash of their id.  Scoring covers every document.  A null text counts as empty and
gets a score like any other; repeated rows get equal scores; a very long text is measured whole in its row; ties
of hashes in the sample are broken by the id; an empty table gives no rows; without any labels, or with one
class alone, every score is the share of label 1 (one half if there are no labels).  Columns named ``x``, ``score``
or ``predicted`` give way to those made by ``score``; the stage ``keep_good`` passes on all columns untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import words

#: Labelled documents that the fit may use; their statistics are a few megabytes on the driver.
SAMPLE = 20_000
FOLDS = 5
#: Scores from here on predict label 1.
THRESHOLD = 0.3
FEATURES = ["n_words", "word_length", "symbols", "distinct", "capitals", "repeated_lines", "digits", "stops", "bars", "exclamations", "breaks", "links"]


def statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """The input with ``x``, a struct of ``FEATURES`` as doubles."""
    text = F.coalesce(F.col(column), F.lit(""))

    def of(w: Column, lines: Column, joined: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        signs = F.regexp_replace(joined, "[a-z\\x{80}-\\x{10FFFF}]+", "")

        def shares(s: Column) -> Column:
            count = lambda kept: F.length(F.regexp_replace(s, kept, "")).cast("double")
            chars = F.greatest(F.length(joined), F.lit(1)).cast("double")
            values = [
                F.size(w).cast("double"), chars / n, count("[^#*$%&<>]") / n, F.size(F.array_distinct(w)) / n, count("[^A-Z]") / chars,
                1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)), count("[^0-9]") / chars, count("[^.]") / n, count("[^|]") / n, count("[^!]") / n, F.size(lines) / n, count("[^/@]") / n,
            ]
            return F.struct(*[v.alias(k) for k, v in zip(FEATURES, values, strict=True)])

        return common.let(signs, shares)

    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    x = common.let(words(F.col(column)), lambda w: common.let(F.array_join(w, ""), lambda j: common.let(lines, lambda ls: of(w, ls, j))))
    return docs.withColumn("x", x)


@dataclass
class Rules:
    """Conjunctions of (feature, above, threshold) with weights; ``bias`` alone is the score without rules."""

    bias: float
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, x: Column) -> Column:
        """Probability of label 1 as a Spark column over the struct ``x``."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for f, above, at in rule:
                holds = holds & ((x[FEATURES[f]] > at) if above else (x[FEATURES[f]] <= at))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(self.rules)), bool)
        for k, rule in enumerate(self.rules):
            for f, above, at in rule:
                out[:, k] &= x[:, f] > at if above else x[:, f] <= at
        return out


def _paths(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """Rules of one regression tree on ``target``, and its fit at every row."""
    found, fit = [], np.zeros(len(x))
    todo = [(np.arange(len(x)), ())]
    while todo:
        rows, path = todo.pop()
        t = target[rows]
        fit[rows] = t.mean()
        if path:
            found.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-9, None)
        for f in range(x.shape[1]):
            size = len(cuts[f]) + 1
            n = np.bincount(bins[rows, f], minlength=size).cumsum()[:-1]
            s = np.bincount(bins[rows, f], weights=t, minlength=size).cumsum()[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (t.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - t.sum() ** 2 / len(rows), -1)
                if gain.max() > best[0]:
                    best = gain.max(), (f, int(gain.argmax()))
        if best[1]:
            f, k = best[1]
            low = bins[rows, f] <= k
            at = float(cuts[f][k])
            todo += [(rows[low], (*path, (f, False, at))), (rows[~low], (*path, (f, True, at)))]
    return found, fit


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3, steps: int = 800, seed: int = 7) -> Rules:
    """Grow trees on the running residual, then choose among their rules by lasso logistic regression."""
    if not len(y):
        return Rules(bias=0.0)
    share = float(y.mean())
    if not 0 < share < 1:
        return Rules(bias=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    base = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    seen: dict[tuple, None] = {}
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(y))[: max(20, len(y) * 2 // 3)]
        found, _ = _paths(x[rows], (y - p)[rows], cuts, bins[rows], depth, max(3, len(rows) // 400))
        seen.update(dict.fromkeys(found))
        own = Rules(0.0, found).matrix(x)
        leaf = [k for k, r in enumerate(found) if not any(len(o) == len(r) + 1 and o[:-1] == r for o in found)]
        for k in leaf:
            at = own[:, k]
            h = (p * (1 - p))[at].sum()
            margin[at] += 0.3 * np.clip((y - p)[at].sum() / (h + 1), -4, 4)
    rules = list(seen)
    a = Rules(0.0, rules).matrix(x).astype(np.float32)
    # Rules that hold for the same rows are one rule.
    _, first = np.unique(np.packbits(a.astype(bool), axis=0), axis=1, return_index=True)
    rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    scale = np.maximum(a.std(0), 0.02)
    a = a / scale
    w, bias, z, zb, t = np.zeros(a.shape[1]), base, np.zeros(a.shape[1]), base, 1.0
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(a @ z + zb))) - y
        new = z - step * (a.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = zb - step * g.mean()
        # Momentum that points uphill starts anew.
        t = 1.0 if (z - new) @ (new - w) + (zb - new_bias) * (new_bias - bias) > 0 else t
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(bias), [rules[k] for k in keep], [float(w[k] / scale[k]) for k in keep])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """Texts and labels of at most ``limit`` labelled ids outside the held-out fold, by the hash of the id."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out("doc_id", FOLDS))
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Rules:
    """Fit on the sample; what reaches the driver is ``limit`` rows of statistics (and repeats of their ids)."""
    rows = statistics(training_sample(docs, labels, label, limit)).select("doc_id", "y", "x.*").orderBy("doc_id", *FEATURES).limit(2 * limit).toPandas()
    return fit_rules(rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The input with ``score`` and ``predicted``."""
    names = [c for c in docs.columns if c not in ("x", "score", "predicted")]
    rows = statistics(docs.select(*[F.col(f"`{c}`") for c in names])).withColumn("score", model.column(F.col("x")))
    return rows.drop("x").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", common.held_out("doc_id", FOLDS).alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of quality, with their columns."""
    model = train(docs, common.table(spark, sf_dir, "labels"))
    names = docs.columns
    return score(docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), "text"), model).where("predicted = 1").select(*[F.col("row")[c].alias(c) for c in names])


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
SQL: dict[str, str] = {}
