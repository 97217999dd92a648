"""Document quality by a sparse rule ensemble over text statistics.

Statistics of every whole text are taken once and stored. On a bounded sample of
labelled rows a forest of shallow trees is grown; every path from a root to a node is a
rule, a conjunction of comparisons. A logistic model with a lasso penalty gives most
rules weight zero. The rules that are left are compiled into one Spark column
expression, so scoring runs no model and no Python.

Cases: null and empty texts have all statistics 0 and are scored like any other; rows
without a label do not train; of several labels of a document the lowest counts; with
one class only, or none, every score is the share of label 1 (0.5 if there are no
labels); repeated rows are scored alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import chunks
from .shingles import distinct, normalized, shingles

#: Labelled rows that train at most, about; a hash of the id chooses them.
SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY = 30, 3, 0.002
THRESHOLD = 0.3
SEED = 11

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "stop_share", "mark_share", "bar_share",
    "other_share", "wide_share", "line_words", "repeated_lines", "repeated_runs", "distinct_words",
)
_UPPER, _DIGIT, _STOP, _MARK, _BAR, _WIDE, _SPACE, _LINE = range(1, 9)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[33:127] = _MARK
    kind[65:91], kind[48:58], kind[97:123] = _UPPER, _DIGIT, 0
    kind[[ord(c) for c in ".,;:'\"-"]] = _STOP
    kind[ord("|")] = _BAR
    kind[[32, 9, 11, 12, 13]], kind[10], kind[128:] = _SPACE, _LINE, _WIDE
    return kind


_KINDS = _classes()


def _statistics(batches):
    for rows in chunks(batches, "text"):
        texts = [t or "" for t in rows.column("text").to_numpy(zero_copy_only=False).tolist()]
        raw = [t.encode() for t in texts]
        words = [normalized(t) for t in texts]
        runs, at = shingles(words, 5)
        sets = distinct(runs, at)
        table = np.zeros((len(texts), len(STATISTICS)))
        for i, (data, own) in enumerate(zip(raw, words)):
            size, split = len(data), own.split()
            if not size:
                continue
            n = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=9)
            lines = data.split(b"\n")
            seen = max(1, len(split))
            table[i] = (
                np.log1p(size), np.log1p(len(split)), (len(own) - len(split) + 1) / seen, n[_UPPER] / size, n[_DIGIT] / size, n[_STOP] / size,
                n[_MARK] / size, n[_BAR] / size, (n[_MARK] + n[_BAR] + n[_DIGIT]) / seen, n[_WIDE] / size, len(split) / len(lines),
                1 - len(set(lines)) / len(lines), 1 - len(sets[i]) / max(1, int(at[i + 1] - at[i])), len(set(split)) / seen,
            )
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), *[pa.array(c) for c in table.T]], ["doc_id", *STATISTICS]
        )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, whether above, bound) for each comparison."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, bound in self.tests:
            held &= F.col(name) > bound if above else F.col(name) <= bound
        return held

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if above else '<='} {b:.6g}" for n, above, b in self.tests)


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; ``column`` is the compiled score."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


_TEST = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def tree_rules(description: str) -> list[Rule]:
    """The rules of a tree, from its printed form: one for each node but the root."""
    rules, path = [], []
    for line in description.splitlines():
        found = _TEST.match(line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(found[2])], found[3] == ">", float(found[4])))]
            rules.append(Rule(_narrowed([t for _, t in path])))
    return rules


def _narrowed(tests: list[tuple[str, bool, float]]) -> tuple[tuple[str, bool, float], ...]:
    """Of several bounds on one side of a statistic the tightest."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, bound in tests:
        key = (name, above)
        best[key] = bound if key not in best else (max if above else min)(best[key], bound)
    return tuple(sorted((n, a, b) for (n, a), b in best.items()))


def fit(sample: DataFrame) -> RuleEnsemble:
    """Rules and weights from rows with the statistics and ``label`` (0 or 1)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    tally = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    zeros, ones = tally.get(0.0, 0), tally.get(1.0, 0)
    if not zeros or not ones:
        share = ones / (zeros + ones) if zeros + ones else 0.5
        return RuleEnsemble(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    inputs = sample.select("label", *STATISTICS, array_to_vector(F.array(*[F.col(s) for s in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=3, seed=SEED
    ).fit(inputs)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString)}, key=str)
    held = inputs.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    held = materialize(held, "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-6]
    return RuleEnsemble(float(lasso.intercept), tuple(weights))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``learn``, ``score`` and ``predicted`` of every row; ``learn`` (over ``doc_id``) marks rows whose labels train.

    ``labels`` has ``doc_id`` and ``quality``.
    """
    stored = materialize(statistics(docs, id_col, text_col).withColumn("learn", F.coalesce(learn, F.lit(False))), "statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("double").alias("label")
    )
    training = stored.where("learn").join(marks, "doc_id")
    share = SAMPLE_ROWS / max(1, training.count())
    sample = training.where(F.xxhash64("doc_id").bitwiseAND(F.lit(2**31 - 1)) <= int(min(1.0, share) * (2**31 - 1)))
    # one partition order for the same rows, so that a rerun grows the same trees
    sample = materialize(sample.select("doc_id", "label", *STATISTICS).coalesce(8).sortWithinPartitions("doc_id", "log_bytes"), "sample")
    score = fit(sample).column()
    return stored.select("doc_id", "learn", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
