"""Show-up model on MLlib, its scores and their calibration: P12-P15."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.features import FEATURES
from kerbline.operators.ordered import ordered_scan, prefix_sums
from kerbline.session import cut_lineage

# Trees, leaves, learning rate and seed of the model; the decision threshold;
# the probability given to permits without visits.
TREES, LEAVES, RATE, SEED = 500, 31, 0.05, 42
THRESHOLD = 0.5
DORMANT_PROBABILITY = 0.02


def fit_show_model(train: DataFrame, *, trees: int = TREES, depth: int = 5, rate: float = RATE, seed: int = SEED) -> PipelineModel:
    """Boosted trees on the feature columns; a depth of 5 gives up to 32 leaves.

    The training rows are checkpointed in the shared folder, and the trees'
    intermediate state is too, every ten iterations.
    """
    rows = cut_lineage(train.select(*[F.col(n).cast("double").alias(n) for n in FEATURES], F.col("showed_up").cast("double").alias("label")))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees_of = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, checkpointInterval=10
    )
    return PipelineModel([assembler, trees_of.fit(assembler.transform(rows))])


def with_probability(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The probability of showing up, next to the rows' own columns."""
    scored = model.transform(features.withColumns({n: F.col(n).cast("double") for n in FEATURES}))
    p = vector_to_array("probability")[1]
    return scored.select(*[F.col(c) for c in features.columns], p.alias("show_probability"))


def with_dormant(scored: DataFrame, active: DataFrame, floor: float = DORMANT_PROBABILITY) -> DataFrame:
    """Probability and yes/no per active permit; permits that were not scored get the floor probability."""
    permits = active.select("permit").distinct()
    known = scored.join(permits, "permit", "left_semi").select("permit", "show_probability")
    dormant = permits.join(scored, "permit", "left_anti").select("permit", F.lit(floor).alias("show_probability"))
    return known.unionByName(dormant).withColumn("predicted", (F.col("show_probability") >= THRESHOLD).cast("int"))


def score_permits(model: PipelineModel, prediction: DataFrame, active: DataFrame, floor: float = DORMANT_PROBABILITY) -> DataFrame:
    """Probability and yes/no per active permit; permits without features get the floor probability."""
    known = prediction.join(active.select("permit").distinct(), "permit", "left_semi")
    complete = known.na.fill(0, ["presence_rate", "presence_rate_10", "presence_rate_20", "day_of_week_rate"]).withColumn(
        "days_since_last_visit", F.coalesce(F.col("days_since_last_visit"), F.lit(-1))
    )
    return with_dormant(with_probability(model, complete), active, floor)


def expected_total(scored: DataFrame) -> DataFrame:
    """Expected number of permits that show up."""
    return scored.agg(F.sum("show_probability").alias("expected"), F.sum("predicted").alias("predicted"))


def class_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from one grouped count."""
    c = F.col
    predicted = (c("show_probability") >= THRESHOLD).cast("int")
    cells = scored.groupBy(c("showed_up").cast("int").alias("actual"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(c("actual").alias("label"), c("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(c("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), c("n").alias("called")),
    )
    hit = F.when(c("actual") == c("predicted"), c("n")).otherwise(0)
    right = cells.groupBy(c("actual").alias("label")).agg(F.sum(hit).alias("hits"))
    totals = cells.select(F.inline(sides)).groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"))
    rows = totals.join(right, "label", "left").fillna(0, ["hits"])
    precision = F.when(c("called") > 0, c("hits") / c("called")).otherwise(0.0)
    recall = F.when(c("support") > 0, c("hits") / c("support")).otherwise(0.0)
    f1 = F.when(c("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, with the number of rows of each class; NULL where one class is missing.

    The rank-sum formula: rows are counted per distinct probability, each of
    which has the average of its rows' ranks. Twice the ranks are whole numbers.
    """
    c = F.col
    known = scored.filter(c("show_probability").isNotNull() & c("showed_up").isNotNull())
    cells = known.groupBy("show_probability").agg(F.count(F.lit(1)).alias("n"), F.sum(c("showed_up").cast("bigint")).alias("hits"))
    ranked = prefix_sums(cells, ["show_probability"], ["n"])
    twice = (2 * c("before_n") + c("n") + 1).cast("decimal(38,0)") * c("hits")
    sums = ranked.agg(F.sum(twice).alias("_twice"), F.coalesce(F.sum("hits"), F.lit(0)).alias("positives"), F.coalesce(F.sum(c("n") - c("hits")), F.lit(0)).alias("negatives"))
    p, q = c("positives").cast("double"), c("negatives").cast("double")
    area = (c("_twice").cast("double") - p * (p + 1)) / (2 * p * q)
    return sums.select("positives", "negatives", F.when((c("positives") > 0) & (c("negatives") > 0), area).alias("auc"))


def feature_importance(model: PipelineModel) -> dict[str, float]:
    """Importance of each feature, largest first."""
    weights = model.stages[-1].featureImportances
    return dict(sorted(((n, float(weights[i])) for i, n in enumerate(FEATURES)), key=lambda kv: -kv[1]))


STEPS = "_range int, low double, high double, n long, hits long"
FAN_IN = 64


def _pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks pooled until their shares of hits rise strictly: the greatest convex minorant of the sums."""
    stack: list[list] = []
    for row in blocks.sort_values("low").itertuples(index=False):
        new = [row.low, row.high, int(row.n), int(row.hits)]
        # Whole numbers are compared, so equal shares are pooled whatever their size.
        while stack and stack[-1][3] * new[2] >= new[3] * stack[-1][2]:
            low, _, n, hits = stack.pop()
            new = [low, new[1], n + new[2], hits + new[3]]
        stack.append(new)
    out = pd.DataFrame(stack, columns=["low", "high", "n", "hits"])
    return out.assign(_range=int(blocks["_range"].iloc[0]) // FAN_IN)[["_range", "low", "high", "n", "hits"]]


def isotonic_steps(validation: DataFrame) -> DataFrame:
    """Isotonic fit of showed_up on the probability: steps (low, high, n, value), value rising strictly.

    Rows are counted per distinct probability. Each range of probabilities is
    pooled by itself; blocks once pooled stay together in the whole fit, so
    the blocks left over from `FAN_IN` ranges are pooled next, until one range
    is left. That one holds the fit's own steps and what its parts left over.
    """
    c = F.col
    known = validation.filter(c("show_probability").isNotNull() & c("showed_up").isNotNull())
    p = c("show_probability").cast("double")
    cells = known.groupBy(p.alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum(c("showed_up").cast("bigint")).alias("hits"))
    blocks = cut_lineage(cells.withColumn("high", c("low")).repartitionByRange("low").withColumn("_range", F.spark_partition_id()).select("_range", "low", "high", "n", "hits"))
    while True:
        one = blocks.agg(F.count_distinct("_range")).first()[0] <= 1
        blocks = cut_lineage(blocks.groupBy("_range").applyInPandas(_pooled, STEPS))
        if one:
            return blocks.select("low", "high", "n", (c("hits") / c("n")).alias("value"))


def calibrated(scored: DataFrame, steps: DataFrame) -> DataFrame:
    """The calibrated probability next to the raw one: the step's value, between two steps a straight line.

    Below the first and above the last step their values hold. Each distinct
    probability looks its step up once, in an ordered scan.
    """
    c, scale = F.col, 4096
    both = {"_next_low": c("low"), "_next_value": c("value")}
    linked = ordered_scan(steps, [], ["low"], F.floor(c("low") * scale), nexts=both)
    kept = linked.select(c("low").alias("_p"), F.lit(0).alias("_kind"), F.struct("high", "value", "_next_low", "_next_value").alias("_step"))
    asked = scored.filter(c("show_probability").isNotNull()).select(c("show_probability").cast("double").alias("_p")).distinct()
    rows = kept.unionByName(asked.select("_p", F.lit(1).alias("_kind"), F.lit(None).cast(kept.schema["_step"].dataType).alias("_step")))
    found = ordered_scan(rows, [], ["_p", "_kind"], F.floor(c("_p") * scale), lasts={"_at": c("_step")}).filter("_kind = 1")
    s, first = (lambda n: c(f"_at.{n}")), steps.agg(F.min("value")).scalar()
    line = s("value") + (s("_next_value") - s("value")) * (c("_p") - s("high")) / (s("_next_low") - s("high"))
    value = F.when(c("_at").isNull(), first).when((c("_p") <= s("high")) | s("_next_low").isNull(), s("value")).otherwise(line)
    at = found.select("_p", value.alias("calibrated"))
    return scored.join(at, scored["show_probability"].cast("double") == at["_p"], "left").drop("_p")


def calibration_curve(scored: DataFrame, bins: int = 10, column: str = "show_probability") -> DataFrame:
    """Per equal-width bin, mean predicted probability and share of positives; empty bins are left out."""
    p = F.col(column)
    bin_of = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(bin_of.alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg(F.col("showed_up").cast("double")).alias("fraction_positive"), F.count(F.lit(1)).alias("n")
    )
