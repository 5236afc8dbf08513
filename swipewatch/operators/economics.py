"""Cost model of decided rows against labels.

Every cost is linear in rows and exposure, so counts and exposure sums per action
and label are all that is read from the data. Exposure is summed in cents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scale import DEALT_ROWS, dealt
from ..sources.contracts import FORBIDDEN_POLICY

CELLS = [(a, l) for a in ("ALLOW", "REVIEW", "BLOCK") for l in ("fraud", "legit")]


@dataclass(frozen=True)
class Assumptions:
    fraud_loss_fraction: float = 0.70
    block_effectiveness: float = 0.95
    review_cost_per_case: float = 1.0
    review_fraud_detection_rate: float = 0.80
    review_legitimate_false_reject_rate: float = 0.01
    false_block_fixed_friction_cost: float = 0.50
    false_block_amount_friction_rate: float = 0.02
    review_delay_cost: float = 0.05


def cell_sums(action: str = "action", label: str = "fraud_label", exposure: str = "positive_exposure") -> list[Column]:
    out = []
    for a, l in CELLS:
        hit = (F.col(action) == a) & ((F.col(label) == 1) if l == "fraud" else (F.col(label) != 1))
        out += [F.count_if(hit).alias(f"n_{a}_{l}"), F.coalesce(F.sum(F.when(hit, X.cents(exposure))), F.lit(0)).alias(f"x_{a}_{l}")]
    return out


def costs(a: Assumptions, prevalence: float = 1.0) -> dict[str, Column]:
    """Missed fraud, review, false block and total cost from the cell sums."""
    n = lambda act, l: F.col(f"n_{act}_{l}").cast("double")
    x = lambda act, l: X.dollars(F.col(f"x_{act}_{l}"))
    lost = lambda act: x(act, "fraud") * F.lit(a.fraud_loss_fraction * prevalence)
    friction = lambda act: n(act, "legit") * F.lit(a.false_block_fixed_friction_cost) + x(act, "legit") * F.lit(a.false_block_amount_friction_rate)
    missed = lost("ALLOW")
    review = ((n("REVIEW", "fraud") + n("REVIEW", "legit")) * F.lit(a.review_cost_per_case + a.review_delay_cost)
              + lost("REVIEW") * F.lit(1 - a.review_fraud_detection_rate) + friction("REVIEW") * F.lit(a.review_legitimate_false_reject_rate))
    false_block = friction("BLOCK")
    # The loss that gets past a block is part of the total but of no component.
    total = missed + review + false_block + lost("BLOCK") * F.lit(1 - a.block_effectiveness)
    return {"simulated_missed_fraud_cost": missed, "simulated_review_cost": review, "simulated_false_block_cost": false_block, "simulated_total_cost": total}


def economics_columns(a: Assumptions, prevalence: float = 1.0) -> list[Column]:
    """The 29 outcome metrics of a policy from its cell sums."""
    n = lambda act, l: F.col(f"n_{act}_{l}")
    x = lambda act, l: F.col(f"x_{act}_{l}")
    both = lambda act: n(act, "fraud") + n(act, "legit")
    fraud = n("ALLOW", "fraud") + n("REVIEW", "fraud") + n("BLOCK", "fraud")
    legit = n("ALLOW", "legit") + n("REVIEW", "legit") + n("BLOCK", "legit")
    rows = fraud + legit
    fraud_x = x("ALLOW", "fraud") + x("REVIEW", "fraud") + x("BLOCK", "fraud")
    all_x = fraud_x + x("ALLOW", "legit") + x("REVIEW", "legit") + x("BLOCK", "legit")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    metrics: dict[str, Column] = {"transactions": rows, "fraud_rows": fraud}
    metrics |= {f"{v.lower()}_count": both(v) for v in ("ALLOW", "REVIEW", "BLOCK")}
    metrics |= {f"{v.lower()}_rate": zero(X.ratio(both(v), rows)) for v in ("ALLOW", "REVIEW", "BLOCK")}
    metrics |= {"fraud_allowed": n("ALLOW", "fraud"), "fraud_reviewed": n("REVIEW", "fraud"), "fraud_blocked": n("BLOCK", "fraud"),
                "fraud_capture": 1 - X.ratio(n("ALLOW", "fraud"), fraud), "review_fraud_capture": X.ratio(n("REVIEW", "fraud"), fraud), "block_fraud_capture": X.ratio(n("BLOCK", "fraud"), fraud),
                "legitimate_reviewed": n("REVIEW", "legit"), "legitimate_blocked": n("BLOCK", "legit"),
                "legitimate_block_rate": zero(X.ratio(n("BLOCK", "legit"), legit)),
                "legitimate_intervention_rate": zero(X.ratio(n("REVIEW", "legit") + n("BLOCK", "legit"), rows)), "false_block_rate": zero(X.ratio(n("BLOCK", "legit"), rows)),
                "total_positive_exposure": X.dollars(all_x), "fraud_positive_exposure": X.dollars(fraud_x), "allowed_fraud_exposure": X.dollars(x("ALLOW", "fraud")),
                "reviewed_fraud_exposure": X.dollars(x("REVIEW", "fraud")), "blocked_fraud_exposure": X.dollars(x("BLOCK", "fraud")),
                "fraud_exposure_capture": 1 - X.ratio(x("ALLOW", "fraud"), fraud_x)}
    metrics |= costs(a, prevalence)
    return [c.alias(name) for name, c in metrics.items()]


def join_labels(decisions: DataFrame, labels: DataFrame, label: str = "fraud_label", *, rows: int | None = None) -> DataFrame:
    """Labels joined after the decision, one to one; a missing or doubled label stops the job. With ``rows``, an upper bound on either side, many
    rows are dealt out to as many tasks as they take."""
    held = sorted(FORBIDDEN_POLICY & set(decisions.columns))
    if held:
        raise ValueError(f"label firewall: decisions carry {held}")
    if (rows or 0) > DEALT_ROWS:
        decisions, labels = dealt(decisions, ["source_row_id"], rows), dealt(labels, ["source_row_id"], rows)
    once = labels.groupBy("source_row_id").agg(F.max(label).alias(label), F.count("*").alias("_copies"))
    joined = decisions.join(once, "source_row_id", "left")
    fine = F.col(label).isNotNull() & (F.col("_copies") == 1)
    return joined.where(F.assert_true(fine, "labels must cover every decision row exactly once").isNull()).drop("_copies")


def evaluate(evaluated: DataFrame, assumptions: Assumptions = Assumptions(), by: Sequence[str | Column] = (), prevalence: float = 1.0) -> DataFrame:
    """Economics of decided rows with their label, in total or per group."""
    cells = evaluated.groupBy(*by).agg(*cell_sums())
    keys = cells.columns[: len(by)]
    return cells.select(*keys, *economics_columns(assumptions, prevalence))


def daily(evaluated: DataFrame, assumptions: Assumptions = Assumptions()) -> DataFrame:
    return evaluate(evaluated, assumptions, [F.date_format("transaction_timestamp", "yyyy-MM-dd").alias("date")])


SEGMENTS = {"channel": "channel", "pair_new": "pair_seen", "cold_card": "cold_start", "new_merchant": "merchant_novelty", "cold_start_segment": "cold_start_segment"}


def by_segment(evaluated: DataFrame, assumptions: Assumptions = Assumptions()) -> DataFrame:
    """Economics per value of every segment column, from one pass over the rows.

    Cells are summed per combination first, so the unpivot repeats only those few rows.
    """
    table = evaluated
    if {"cold_card", "new_merchant", "pair_new"} <= set(table.columns):
        table = table.withColumn("cold_start_segment", X.cold_start_segment("cold_card", "new_merchant", "pair_new"))
    present = [c for c in SEGMENTS if c in table.columns]
    combos = table.groupBy(*present).agg(*cell_sums())
    names = [c for c in combos.columns if c not in present]
    long = combos.selectExpr(*names, X.unpivot_stack([(f"'{SEGMENTS[c]}'", X.segment_text(table, c)) for c in present], ("segment_type", "segment")))
    cells = long.groupBy("segment_type", "segment").agg(*[F.sum(c).alias(c) for c in names])
    return cells.select("segment_type", "segment", *economics_columns(assumptions))


def scenarios(base: Assumptions) -> dict[str, tuple[Assumptions, float]]:
    """Named (assumptions, prevalence weight) stresses."""
    friction = replace(base, false_block_fixed_friction_cost=base.false_block_fixed_friction_cost * 2, false_block_amount_friction_rate=base.false_block_amount_friction_rate * 2)
    return {
        "FRAUD_LOSS_LOW": (replace(base, fraud_loss_fraction=0.50), 1.0), "FRAUD_LOSS_BASE": (base, 1.0), "FRAUD_LOSS_HIGH": (replace(base, fraud_loss_fraction=0.90), 1.0),
        "REVIEW_COST_DOUBLE": (replace(base, review_cost_per_case=base.review_cost_per_case * 2), 1.0), "FRICTION_DOUBLE": (friction, 1.0),
        "SIMULATED_PREVALENCE_STRESS_0.5X": (base, 0.5), "SIMULATED_PREVALENCE_STRESS_1.5X": (base, 1.5),
    }
