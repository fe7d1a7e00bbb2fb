"""Quality classifier: a sparse ensemble of rules on text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, packed, whole_text
from tablog.llm.labels import SAMPLE, training_rows
from tablog.plans.durable import durable

TREES = 24
DEPTH = 3
PENALTY = 0.0005
SEED = 7

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text, all from the text alone; shares of an empty text are 0."""
    length = F.length(text)
    words = F.split(text, r"[\x20\x09-\x0D]+")
    n_words = F.size(words)

    def share(pattern: str) -> Column:
        left = F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))
        return F.when(length == 0, F.lit(0.0)).otherwise(left / length)

    return {
        "n_words": n_words.cast("double"),
        "word_length": length / n_words,
        "distinct_share": F.size(F.array_distinct(words)) / n_words,
        "upper_share": share("A-Z"),
        "digit_share": share("0-9"),
        "stop_share": share(".,;:?"),
        "shout_share": share("!"),
        "symbol_share": share(r"#$%&*|~^<>{}\[\]\\_=+@/"),
        "line_share": share(r"\n"),
    }


def measured(text_column: str) -> Column:
    """The statistics of a text column as one struct."""
    stats = statistics(whole_text(text_column))
    return F.struct(*[value.cast("double").alias(name) for name, value in stats.items()])


@dataclass(frozen=True)
class RuleModel:
    """Conjunctions of conditions with weights: a logistic model over them."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: str) -> Column:
        """The probability of label 1, from a struct column of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: tuple[Condition, ...], stats: str) -> Column:
    """The rule as a boolean column."""
    out = F.lit(True)
    for name, relation, threshold in rule:
        value = F.col(f"{stats}.{name}")
        out = out & (value <= threshold if relation == "<=" else value > threshold)
    return out


def tree_paths(node, names: list[str], path: dict | None = None) -> set[tuple[Condition, ...]]:
    """All paths from the root of a fitted tree, each as a rule without redundant conditions."""
    path = path or {}
    found = {tuple(sorted((n, r, t) for (n, r), t in path.items()))} if path else set()
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        low, high = path.get((name, "<="), threshold), path.get((name, ">"), threshold)
        found |= tree_paths(node.leftChild(), names, path | {(name, "<="): min(low, threshold)})
        found |= tree_paths(node.rightChild(), names, path | {(name, ">"): max(high, threshold)})
    return found


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
    trees: int = TREES,
    depth: int = DEPTH,
    penalty: float = PENALTY,
) -> RuleModel:
    """Learn from at most ``sample`` labelled documents that aren't held out.

    A random forest over the statistics proposes rules, every path of every
    tree; a logistic regression with an L1 penalty over the rules' truth
    values keeps few of them.  Without labels of both kinds, or with too few
    for any split, there are no rules and every score is the smoothed share of
    label 1.
    """
    names = list(statistics(F.lit("")))
    rows = training_rows(docs.select(named(id_column), named(text_column)), labels, label, id_column, sample)
    rows = durable(rows.select("_label", measured(text_column).alias("_stats")).coalesce(4))
    ones, total = rows.agg(F.coalesce(F.sum("_label"), F.lit(0.0)), F.count(F.lit(1))).first()
    share = (ones + 1) / (total + 2)
    plain = RuleModel((), (), math.log(share / (1 - share)))
    if ones in (0, total):
        return plain
    table = VectorAssembler(inputCols=names, outputCol="_features").transform(rows.select("_label", "_stats.*"))
    forest = RandomForestClassifier(
        labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=SEED,
        featureSubsetStrategy="onethird", minInstancesPerNode=5,
    ).fit(table)
    found = set().union(*[tree_paths(tree._call_java("rootNode"), names) for tree in forest.trees])
    rules = sorted(found)
    if not rules:
        return plain
    truths = rows.select("_label", F.array(*[holds(r, "_stats").cast("double") for r in rules]).alias("_truths"))
    lasso = LogisticRegression(
        labelCol="_label", featuresCol="_rules", elasticNetParam=1.0, regParam=penalty,
        standardization=False, maxIter=60,
    ).fit(truths.select("_label", array_to_vector("_truths").alias("_rules")))
    weighted = [(r, float(w)) for r, w in zip(rules, lasso.coefficients) if w]
    return RuleModel(
        tuple(r for r, _ in weighted), tuple(w for _, w in weighted), float(lasso.intercept)
    )


def score_quality(
    docs: DataFrame, model: RuleModel, text_column: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, by column expressions only.

    A null text counts as empty and is scored like any other.  Columns of
    ``docs`` named like an added one are replaced.
    """
    rows = docs.select(packed(docs, ["score", "predicted"]), measured(text_column).alias("_stats"))
    scored = rows.select("_row", model.score("_stats").alias("score"))
    return scored.select("_row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
