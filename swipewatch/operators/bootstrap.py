"""Weekly paired block bootstrap of two policies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from . import economics as E

SEED = 20260903
MIN_DRAWS = 500
STATS = ("rows", "fraud", "legit", "cost", "allowed_fraud", "allowed_fraud_exposure", "fraud_exposure", "legit_touched", "legit_blocked", "reviewed")
DELTAS = ("delta_cost", "delta_capture", "delta_exposure_capture", "delta_legitimate_block_rate", "delta_review_rate", "delta_legitimate_intervention")


def weekly_stats(evaluated: DataFrame, assumptions: E.Assumptions = E.Assumptions()) -> DataFrame:
    """Ten sums per Monday-to-Sunday week: all a resample needs."""
    cells = evaluated.groupBy(X.queue_bucket("transaction_timestamp", "WEEK").alias("week")).agg(*E.cell_sums())
    n = lambda a, l: F.col(f"n_{a}_{l}")
    x = lambda a, l: F.col(f"x_{a}_{l}")
    fraud = n("ALLOW", "fraud") + n("REVIEW", "fraud") + n("BLOCK", "fraud")
    legit = n("ALLOW", "legit") + n("REVIEW", "legit") + n("BLOCK", "legit")
    return cells.select(
        "week", (fraud + legit).alias("rows"), fraud.alias("fraud"), legit.alias("legit"), E.costs(assumptions)["simulated_total_cost"].alias("cost"),
        n("ALLOW", "fraud").alias("allowed_fraud"), X.dollars(x("ALLOW", "fraud")).alias("allowed_fraud_exposure"),
        X.dollars(x("ALLOW", "fraud") + x("REVIEW", "fraud") + x("BLOCK", "fraud")).alias("fraud_exposure"),
        (n("REVIEW", "legit") + n("BLOCK", "legit")).alias("legit_touched"), n("BLOCK", "legit").alias("legit_blocked"), (n("REVIEW", "fraud") + n("REVIEW", "legit")).alias("reviewed"))


def multiplicities(weeks: int, draws: int, seed: int) -> list[tuple[int, int, int]]:
    """(draw, week position, copies): its size depends on the calendar and the draws, not on the rows."""
    rng = np.random.default_rng(seed)
    positions = np.arange(weeks)
    counts = np.array([np.bincount(rng.choice(positions, size=weeks, replace=True), minlength=weeks) for _ in range(draws)])
    draw, week = np.nonzero(counts)
    return list(zip(draw.tolist(), week.tolist(), counts[draw, week].tolist()))


def _metrics(side: str) -> dict[str, Column]:
    c = lambda name: F.col(f"{side}_{name}")
    zero = lambda top, bottom: F.coalesce(X.ratio(top, bottom), F.lit(0.0))
    return {
        "delta_cost": c("cost"), "delta_capture": zero(c("fraud") - c("allowed_fraud"), c("fraud")),
        "delta_exposure_capture": zero(c("fraud_exposure") - c("allowed_fraud_exposure"), c("fraud_exposure")),
        "delta_legitimate_block_rate": zero(c("legit_blocked"), c("legit")), "delta_review_rate": zero(c("reviewed"), c("rows")), "delta_legitimate_intervention": zero(c("legit_touched"), c("rows"))}


def paired_weeks(champion: DataFrame, challenger: DataFrame, assumptions: E.Assumptions = E.Assumptions()) -> DataFrame:
    sides = []
    for side, evaluated in (("a", champion), ("b", challenger)):
        w = weekly_stats(evaluated, assumptions)
        sides.append(w.select("week", *[F.col(s).alias(f"{side}_{s}") for s in STATS]))
    # A few thousand weeks at most.
    place = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("week")) - 1).alias("position")
    return sides[0].join(sides[1], "week").select("*", place)


def hashed_draws(spark, weeks: int, draws: int, seed: int) -> DataFrame:
    """(draw, position, copies): each of the ``weeks`` places of a draw takes the week that the MD5 of seed, draw and place says. A place needs
    no other place, so draws are made where they are used, and any engine makes the same ones."""
    places = spark.range(draws).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(weeks - 1, 0)))).alias("place"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "place")), 1, 15), 16, 10).cast("long")
    return places.groupBy("draw", F.pmod(digest, F.lit(max(weeks, 1))).cast("int").alias("position")).agg(F.count("*").alias("copies"))


def draw_deltas(weeks: DataFrame, draws: int = 1000, seed: int = SEED, source: str = "hash") -> DataFrame:
    """Challenger minus champion per draw; both policies see the same weeks.

    ``source`` says where draws come from: ``"hash"`` or ``"generator"``, the table of a seeded generator, which gives published intervals again.
    """
    if draws < MIN_DRAWS:
        raise ValueError(f"the bootstrap needs at least {MIN_DRAWS} draws")
    spark = weeks.sparkSession
    if source == "hash":
        plan = hashed_draws(spark, weeks.count(), draws, seed)
    elif source == "generator":
        plan = spark.createDataFrame(multiplicities(weeks.count(), draws, seed), "draw int, position int, copies int")
    else:
        raise ValueError(f"draws come from hash or generator, not {source}")
    sums = plan.join(F.broadcast(weeks), "position").groupBy("draw").agg(*[F.sum(F.col(f"{s}_{n}") * F.col("copies")).alias(f"{s}_{n}") for s in "ab" for n in STATS])
    a, b = _metrics("a"), _metrics("b")
    return sums.select("draw", *[(b[d] - a[d]).alias(d) for d in DELTAS])


def weekly_paired_bootstrap(champion: DataFrame, challenger: DataFrame, assumptions: E.Assumptions = E.Assumptions(), draws: int = 1000, seed: int = SEED, source: str = "hash") -> DataFrame:
    """Mean and 95 % interval of six deltas. Inputs are decided rows with their label."""
    deltas = draw_deltas(paired_weeks(champion, challenger, assumptions), draws, seed, source)
    long = deltas.selectExpr(X.unpivot_stack([(f"'{d}'", d) for d in DELTAS], ("metric", "v")))
    return long.groupBy("metric").agg(
        F.count("*").alias("draws"), F.avg("v").alias("estimate"), F.percentile("v", F.lit(0.025)).alias("ci_lower"), F.percentile("v", F.lit(0.975)).alias("ci_upper"),
    ).select("*", F.lit("weekly_paired_block_bootstrap").alias("method"), F.lit(seed).alias("seed"), F.lit("PASS").alias("status"))
