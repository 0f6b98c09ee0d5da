"""Analytics over a table of finished trials (trial_id, state, score, parameter columns)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import choice_position, rank_position, step_position
from barloom.operators.scaling import quantiles
from barloom.plans.steps import on_series

# Targets and weights of the objective.
SHARPE_MIN, SHARPE_STRETCH, ACCURACY_MIN, PBO_MAX, PBO_WEIGHT, DRAWDOWN_MAX = 2.0, 3.0, 0.52, 0.20, 2.0, 0.25
EULER_GAMMA = 0.5772


@dataclass(frozen=True)
class Range:
    """Numeric parameter; ``kind`` is ``float``, ``log`` or ``int``."""

    name: str
    low: float
    high: float
    kind: str = "float"

    def position(self) -> Column:
        if self.kind == "int":
            return step_position(F.col(self.name), int(self.low), int(self.high))
        return rank_position(F.col(self.name), self.low, self.high, self.kind == "log")


@dataclass(frozen=True)
class Choice:
    name: str
    values: tuple

    def position(self) -> Column:
        return choice_position(F.col(self.name), self.values)


# -- scores ----------------------------------------------------------------------------------------


def effective_sharpe(df: DataFrame, sharpe: str = "sharpe", pbo: str = "pbo") -> DataFrame:
    """Sharpe ratio less a penalty for an overfitting proxy above its target."""
    kept = F.greatest(F.least(F.coalesce(F.col(pbo), F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    raw = F.coalesce(F.col(sharpe), F.lit(0.0))
    penalty = F.greatest(kept - PBO_MAX, F.lit(0.0)) * PBO_WEIGHT
    return df.withColumns({"pbo_kept": kept, "pbo_penalty": penalty, "effective_sharpe": raw - penalty})


def deflated_sharpe(df: DataFrame, sharpe: str = "sharpe", order: str = "trial_id") -> DataFrame:
    """Haircut for the trials completed before this one (a running count in trial order)."""
    done = F.when(F.upper("state") == "COMPLETE", 1)
    counted = on_series(df, [], (), (order,), running={"_upto": ("count", done)})
    before = F.col("_upto") - F.coalesce(done, F.lit(0))
    s = F.col(sharpe)
    peak = F.when(before > 0, F.sqrt(2.0 * F.ln(F.greatest(before, F.lit(1)).cast("double")))).otherwise(0.0)
    cut = F.sqrt(F.greatest(1.0 - EULER_GAMMA * (peak / F.greatest(F.lit(1.0), s)), F.lit(0.01)))
    return counted.withColumns({"completed_before": before, "deflated_sharpe": s * cut}).drop("_upto")


def shortfall_score(df: DataFrame, sharpe: str, accuracy: str = "accuracy") -> DataFrame:
    """Score to maximise: Sharpe and accuracy with penalties below their targets; flag for meeting both."""
    s, a = F.col(sharpe), F.col(accuracy)
    score = s + (a - 0.5) * 8.0 - F.greatest(ACCURACY_MIN - a, F.lit(0.0)) * 30.0 - F.greatest(SHARPE_MIN - s, F.lit(0.0)) * 3.0
    return df.withColumns({"score_max": score, "meets_target": (s >= SHARPE_MIN) & (a > ACCURACY_MIN)})


def loss_score(df: DataFrame, sharpe: str, accuracy: str = "accuracy", loss: str = "loss") -> DataFrame:
    """Score to minimise: loss with accuracy and Sharpe shortfalls added and a bounded bonus taken off."""
    s, a = F.col(sharpe), F.col(accuracy)
    miss = F.greatest(ACCURACY_MIN - a, F.lit(0.0)) * 12.0
    bonus = F.when(s < SHARPE_MIN, (SHARPE_MIN - s) * 0.30).otherwise(-(F.least(s, F.lit(SHARPE_STRETCH)) - SHARPE_MIN) * 0.10)
    return df.withColumn("score_min", F.col(loss) + miss + bonus)


def drawdown_guard(df: DataFrame, drawdown: str = "drawdown", limit: float = DRAWDOWN_MAX) -> DataFrame:
    d = F.col(drawdown)
    return df.where(d.isNotNull() & ~F.isnan(d) & (d <= limit))


# -- plateau ---------------------------------------------------------------------------------------


def plateau(
    trials: DataFrame,
    current: DataFrame,
    space: Sequence[Range | Choice],
    maximise: bool = True,
    radius: float = 0.30,
    max_neighbours: int = 8,
    min_neighbours: int = 4,
    grace: int = 12,
    cliff_weight: float = 0.35,
    spread_weight: float = 0.10,
) -> DataFrame:
    """How a trial's score stands among its neighbours in normalised parameter space.

    ``current`` is one row (trial_id, score, parameters).  Distances need one pass over the trials; the
    neighbours are those within ``radius``, or the nearest few when too few are.
    """
    need = max(min_neighbours, 3)
    done = trials.where(F.upper("state") == "COMPLETE")
    mine = current.select(
        F.col("trial_id").alias("_id"), F.col("score").cast("double").alias("_base"), *[p.position().alias(f"_c{i}") for i, p in enumerate(space)]
    )
    rows = done.select("trial_id", F.col("score").cast("double").alias("score"), *[p.position().alias(f"_p{i}") for i, p in enumerate(space)])
    rows = rows.crossJoin(F.broadcast(mine)).where((F.col("trial_id") != F.col("_id")) & F.col("score").isNotNull() & ~F.isnan("score"))
    sq, used = F.lit(0.0), F.lit(0)
    for i in range(len(space)):
        both = F.col(f"_p{i}").isNotNull() & F.col(f"_c{i}").isNotNull()
        d = F.col(f"_p{i}") - F.col(f"_c{i}")
        sq, used = sq + F.when(both, d * d).otherwise(0.0), used + both.cast("int")
    near = rows.withColumn("_dist", F.sqrt(F.try_divide(sq, used))).where("_dist IS NOT NULL").select("trial_id", "score", "_dist")
    inside = near.where(F.col("_dist") <= radius)
    counts = near.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_dist") <= radius).alias("_in"))
    completed = done.agg(F.count(F.lit(1)).alias("_done"))
    few = near.orderBy("_dist", "trial_id").limit(max(max_neighbours, min_neighbours, 3))
    ranged = inside.select("score").crossJoin(F.broadcast(counts)).where(F.col("_in") >= need)
    picked = ranged.select("score").unionByName(few.select("score").crossJoin(F.broadcast(counts)).where(F.col("_in") < need).select("score"))
    stats = picked.agg(
        F.count(F.lit(1)).alias("_k"), (F.max("score") if maximise else F.min("score")).alias("_best")
    ).crossJoin(quantiles(picked, ["score"], [0.25, 0.5, 0.75], ()))
    q = lambda i: F.get("score_q", F.lit(i))
    out = stats.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(completed)).crossJoin(F.broadcast(mine.select("_id", "_base")))
    reason = (
        F.when(F.col("_done") < max(grace, 3), "insufficient_completed_trials")
        .when(F.col("_all") < need, "insufficient_neighbors")
        .when(F.col("_k") < need, "insufficient_local_scores")
        .otherwise("ok")
    )
    gap = F.greatest((F.col("_base") - q(1)) if maximise else (q(1) - F.col("_base")), F.lit(0.0))
    share = F.least(F.col("_k") / float(max(max_neighbours, 1)), F.lit(1.0))
    out = out.withColumns({"reason": reason, "_iqr": F.greatest(q(2) - q(0), F.lit(0.0)), "_gap": gap, "_cover": share})
    ok = F.col("reason") == "ok"
    show = lambda c: F.when(ok, c).otherwise(0.0)
    neighbours = F.when(ok | (F.col("reason") == "insufficient_local_scores"), F.col("_k")).otherwise(0)
    penalty = (F.col("_gap") * cliff_weight + F.col("_iqr") * spread_weight) * F.col("_cover")
    return out.select(
        F.col("_id").alias("trial_id"),
        show(F.greatest(penalty, F.lit(0.0))).alias("penalty"),
        neighbours.alias("neighbor_count"),
        show(q(1)).alias("local_median"),
        show(F.col("_iqr")).alias("local_iqr"),
        show(F.col("_best")).alias("local_best"),
        show(F.col("_cover")).alias("coverage"),
        show(F.col("_gap")).alias("cliff_gap"),
        "reason",
    )


def state_counts(trials: DataFrame, maximise: bool = True) -> DataFrame:
    """Trials by state with the best complete trial."""
    s = F.upper("state")
    done = s == "COMPLETE"
    pick = F.max_by if maximise else F.min_by
    rank = F.when(done, F.struct(F.col("score"), (-F.col("trial_id") if maximise else F.col("trial_id")).alias("t")))
    named = {"complete": ("COMPLETE",), "pruned": ("PRUNED",), "failed": ("FAIL", "FAILED"), "running": ("RUNNING",), "waiting": ("WAITING",)}
    return trials.agg(
        F.count(F.lit(1)).alias("n_trials_total"),
        *[F.count_if(s.isin(*v)).alias(f"n_trials_{k}") for k, v in named.items()],
        pick("trial_id", rank).alias("best_trial"),
        pick("score", rank).alias("best_score"),
    )


def top_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest importances with their rank (feature, importance)."""
    best = [F.col("importance").desc(), F.col("feature")]
    return importances.orderBy(*best).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*best)))


def lowest(df: DataFrame, name: str, value: str) -> DataFrame:
    """The row with the smallest value as (lowest_name, lowest_value)."""
    at = F.struct(value, name)
    return df.agg(F.min_by(name, at).alias("lowest_name"), F.min(value).alias("lowest_value"))
