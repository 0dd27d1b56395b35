"""Gates, selection of variants, human labels and judge calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

LABEL_KEY = ("task", "trajectory", "step")


def gate_failures(results: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """``failures``: one sentence for each threshold missed (a missing value misses), and ``passed``."""
    checks = []
    for sign, gates in (("below", least), ("above", most)):
        for name, bound in gates.items():
            value = F.col(name)
            wrong = value < bound if sign == "below" else value > bound
            checks.append(F.when(value.isNull(), F.lit(f"{name} is missing")).when(wrong, F.format_string(f"{name} %.4f is {sign} {bound:.4f}", value.cast("double"))))
    out = results.withColumn("failures", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
    return out.withColumn("passed", F.size("failures") == 0)


def best_variant(checks: DataFrame, group: str = "pair") -> DataFrame:
    """The first that passed, else the one with the fewest failures, then changes (``variant, passed, n_failures, n_changes, ord``)."""
    rank = F.struct((~F.col("passed")).alias("a"), F.when(F.col("passed"), 0).otherwise(F.col("n_failures")).alias("b"), F.when(F.col("passed"), 0).otherwise(F.col("n_changes")).alias("c"), F.col("ord").alias("d"))
    return checks.groupBy(group).agg(F.min_by("variant", rank).alias("variant"), F.bool_or("passed").alias("passed"))


def current_labels(labels: DataFrame) -> DataFrame:
    """The last revision of each key; a null step (the whole task) is a key too."""
    last = F.row_number().over(Window.partitionBy(*LABEL_KEY).orderBy(F.desc("seq")))
    return labels.withColumn("_n", last).where("_n = 1").drop("_n")


def label_chain(labels: DataFrame) -> DataFrame:
    """``valid``: whether each revision supersedes exactly the one before it."""
    before = F.lag("id").over(Window.partitionBy(*LABEL_KEY).orderBy("seq"))
    return labels.withColumn("valid", F.col("supersedes").eqNullSafe(before))


def human_assessment(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Per trajectory: the task's reward, the mean over labelled steps, and how many steps are labelled."""
    now = current_labels(labels)
    agg = now.groupBy("task", "trajectory").agg(
        F.max(F.when(F.col("step").isNull(), F.col("reward"))).alias("task_reward"),
        F.avg(F.when(F.col("step").isNotNull(), F.col("reward"))).alias("mean_reward"),
        F.count("step").alias("labelled"),
    )
    joined = steps.groupBy("trajectory").agg(F.count("*").alias("steps")).join(agg, "trajectory")
    return joined.select("task", "trajectory", "task_reward", "mean_reward", ratio("labelled", "steps").alias("coverage"))


def calibrate(pairs: DataFrame) -> DataFrame:
    """Agreement of a judge's rewards with a human's, over all and for each judge (null: all)."""
    p, h = F.col("predicted"), F.col("human")
    counts = {"tp": (p == 1) & (h == 1), "tn": (p == 0) & (h == 0), "fp": (p == 1) & (h == 0), "fn": (p == 0) & (h == 1)}
    t = pairs.groupingSets([[], [F.col("judge")]], F.col("judge")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    return t.select(
        "judge", "n", *counts, ratio(F.col("tp") + F.col("tn"), "n").alias("agreement"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall")
    )


def work_coverage(required: DataFrame) -> DataFrame:
    """(required steps passed + milestones reached) / all declared, null if none is: ``pair, kind, passed``."""
    return required.groupBy("pair").agg(ratio(F.count_if("passed"), F.count("passed")).alias("coverage"))


def mean_rewards(scores: DataFrame) -> DataFrame:
    """Mean reward per trajectory and dimension (null: overall)."""
    return scores.groupBy("pair", "dimension").agg(F.avg("reward").alias("mean_reward"))


def calibration_pairs(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """``judge, predicted, human`` of labelled steps (``evaluation, candidate_step, human_reward``, steps from 1).

    ``scores`` are stored scores of steps with their ``evaluation``.  A label of
    a step that nobody judged, two of one step, and rewards other than 0 and 1
    are errors.
    """
    wrong = labels.where(~F.coalesce(F.col("human_reward").isin(0, 1) & (F.col("candidate_step") > 0), F.lit(False)))
    if not wrong.isEmpty():
        raise ValueError("a label has a human_reward of 0 or 1 and a candidate_step from 1 on")
    judged = scores.where("part = 'quality' and error is null").select("evaluation", "plan_id", "subject", F.col("reward").alias("predicted"), F.col("model").alias("judge"))
    own = labels.withColumn("subject", F.concat(F.lit("step:"), F.col("candidate_step").cast("string"))).join(judged, ["evaluation", "subject"], "left")
    counts = own.agg(F.count("*").alias("n"), F.count("predicted").alias("found"), F.countDistinct("plan_id", "subject").alias("steps")).first()
    if not counts["n"]:
        raise ValueError("there are no labels")
    if counts["found"] < counts["n"]:
        raise ValueError("a labelled step wasn't judged")
    if counts["steps"] < counts["n"]:
        raise ValueError("a step is labelled twice")
    return own.select("judge", "predicted", F.col("human_reward").alias("human"))


def milestone_states(declared: DataFrame, scores: DataFrame) -> DataFrame:
    """``pair, subject, state`` of every declared milestone: reached, failed, or unjudged where no score is there."""
    own = declared.join(scores.select("pair", "subject", "reward"), ["pair", "subject"], "left")
    state = F.when(F.col("reward").isNull(), "unjudged").when(F.col("reward") == 1, "reached").otherwise("failed")
    return own.select("pair", "subject", state.alias("state"))


def dimension_means(steps: DataFrame, scores: DataFrame, dimensions) -> DataFrame:
    """``pair, dimension, mean, judged`` over the steps (``pair, step, head``) that a dimension applies to; no row where it applies to none."""
    from .policy import eligible

    out = None
    for name in dimensions:
        own = steps.where(eligible(name, F.col("head"))).join(scores.where(F.col("dimension") == name).drop("dimension"), ["pair", "step"])
        rows = own.groupBy("pair").agg(F.avg("reward").alias("mean"), F.count("*").alias("judged")).select("pair", F.lit(name).alias("dimension"), "mean", "judged")
        out = rows if out is None else out.unionByName(rows)
    return out
