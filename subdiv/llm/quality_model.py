"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees propose rules (the conditions on a path from the root to a node), an
L1-regularised logistic regression weighs them, and the rules that keep a weight are
compiled into one Spark column expression.

Null and empty texts have all statistics 0 and get the score of such a text.  Repeated
rows each get their own, equal result; other columns of the input are ignored; an empty
table gives an empty result.  Without both labels in the learning rows the score is the
share of label 1, or 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.llm.quality_rules import filter_with
from subdiv.session import materialize

#: Labelled rows the rules are learned from, at most.
LEARN_ROWS = 20_000
TREES, DEPTH = 12, 3
LASSO = 0.002

STATISTICS = [
    "n_chars", "n_words", "mean_length", "distinct_words", "symbols", "letters", "digits", "upper",
    "punctuation", "lines", "distinct_lines", "exclamations", "short_words",
]


def _chars_of(text: Column, kept: str) -> Column:
    """How many characters of ``text`` are among ``kept``."""
    return F.length(text) - F.length(F.translate(text, kept, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one double per entry of STATISTICS for every document."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).alias("chars"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.split(text, "\n").alias("parts"),
        _chars_of(text, "#*$%&|<>").alias("symbol_chars"),
        _chars_of(text, lower).alias("lower_chars"),
        _chars_of(text, upper).alias("upper_chars"),
        _chars_of(text, "0123456789").alias("digit_chars"),
        _chars_of(text, ".,;:?").alias("punctuation_chars"),
        _chars_of(text, "!").alias("exclamation_chars"),
        _chars_of(text, " \t\n\r\x0b\x0c").alias("space_chars"),
    )
    n, w = F.greatest(F.col("chars"), F.lit(1)), F.greatest(F.size("words"), F.lit(1))
    return base.select(
        "doc_id",
        F.col("chars").cast("double").alias("n_chars"),
        F.size("words").cast("double").alias("n_words"),
        ((F.col("chars") - F.col("space_chars")) / w).alias("mean_length"),
        (F.size(F.array_distinct("words")) / w).alias("distinct_words"),
        (F.col("symbol_chars") / n).alias("symbols"),
        ((F.col("lower_chars") + F.col("upper_chars")) / n).alias("letters"),
        (F.col("digit_chars") / n).alias("digits"),
        (F.col("upper_chars") / n).alias("upper"),
        (F.col("punctuation_chars") / n).alias("punctuation"),
        (F.size("parts") / n).alias("lines"),
        (F.size(F.array_distinct("parts")) / F.size("parts")).alias("distinct_lines"),
        (F.col("exclamation_chars") / n).alias("exclamations"),
        (F.size(F.filter("words", lambda x: F.length(x) <= 3)) / w).alias("short_words"),
    )


@dataclass(frozen=True)
class Rule:
    """Conjunction of ``(statistic, is_at_most, edge)`` conditions."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = None
        for name, at_most, edge in self.conditions:
            c = F.col(name) <= F.lit(edge) if at_most else F.col(name) > F.lit(edge)
            out = c if out is None else out & c
        return out.cast("double")


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + rule.column() * F.lit(weight)
        return 1 / (1 + F.exp(-margin))


def tree_rules(spark: SparkSession, trees) -> list[Rule]:
    """One rule per node below each root, conditions on one statistic merged; duplicates removed."""
    found: dict[Rule, None] = {}

    def merged(path):
        tight: dict[tuple[str, bool], float] = {}
        for name, at_most, edge in path:
            have = tight.get((name, at_most))
            tight[(name, at_most)] = edge if have is None else (min if at_most else max)(have, edge)
        return Rule(tuple(sorted((n, a, e) for (n, a), e in tight.items())))

    def walk(node, path):
        if path:
            found.setdefault(merged(path))
        if node.numDescendants() > 0:
            split = node.split()
            name, edge = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*path, (name, True, edge)])
            walk(node.rightChild(), [*path, (name, False, edge)])

    for tree in trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


def learn(sample: DataFrame) -> RuleModel:
    """Fit rules and weights on a bounded sample with the columns of ``statistics`` and ``label`` 0/1."""
    spark = sample.sparkSession
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        share = min(0.99, max(0.01, counts.get(1.0, 0) / n)) if n else 0.5
        return RuleModel(float(_logit(share)))
    ready = materialize(
        sample.select(*STATISTICS, F.col("label").cast("double").alias("label"), array_to_vector(F.array(*STATISTICS)).alias("features")).coalesce(4),
        "quality-sample",
    )
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(ready)
    rules = tree_rules(spark, trees.trees)
    if not rules:
        return RuleModel(float(_logit(counts[1.0] / n)))
    weighed = ready.select("label", array_to_vector(F.array(*[r.column() for r in rules])).alias("rules"))
    lasso = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=True).fit(weighed)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def judge(stats: DataFrame, model: RuleModel) -> DataFrame:
    scored = stats.withColumn("score", model.score())
    return scored.select("doc_id", X.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learning_rows(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """Statistics and labels of LEARN_ROWS labelled documents at most, none held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("label"))
    chosen = X.bounded_sample(labels.where(F.col("label").isNotNull() & ~X.held_out(F.col("doc_id"), 3, 1)), "doc_id", LEARN_ROWS)
    if stats is None:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        stats = statistics(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id"))  # at most LEARN_ROWS ids
    return stats.join(F.broadcast(chosen), "doc_id")  # at most LEARN_ROWS rows


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-statistics")
    return judge(stats, learn(learning_rows(spark, sf_dir, stats)))


def keep_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents the rule ensemble predicts to be good."""
    model = learn(learning_rows(spark, sf_dir))
    return filter_with(docs, lambda d: judge(statistics(d), model).where("predicted = 1").select("doc_id"))
