"""Point-in-time behavioral features: only strictly earlier events count.

Every lookback is the difference of two growing frames, so a sorted group is read
once however dense it is: events in [t-w, t) = events before t - events before t-w.
Amounts are summed as integer cents, which makes that difference exact.

All user and card families hash on ``user_id`` and share one exchange; merchant
features run first, on narrow rows, and take the second. Keys with more rows than
a task should sort go through ``prefix`` instead of a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions.scale import DEALT_ROWS, TASK_ROWS, dealt, hot_keys, join_same, prefix, split_hot

HOUR, DAY, WEEK = 3600, 86400, 604800

FAMILIES: dict[str, list[str]] = {
    "user": ["user_id"],
    "card": ["user_id", "card_key"],
    "user_merchant": ["user_id", "merchant_id_raw"],
    "card_merchant": ["user_id", "card_key", "merchant_id_raw"],
    "user_mcc": ["user_id", "merchant_category_code"],
    "card_mcc": ["user_id", "card_key", "merchant_category_code"],
    "user_channel": ["user_id", "use_chip"],
    "card_channel": ["user_id", "card_key", "use_chip"],
    "merchant": ["merchant_id_raw"],
}
COUNT_LOOKBACKS = {"user": {"1h": HOUR, "24h": DAY, "7d": WEEK}, "card": {"1h": HOUR, "24h": DAY, "7d": WEEK}, "merchant": {"1h": HOUR, "24h": DAY}}
AMOUNT_LOOKBACKS = {"user": {"24h": DAY, "7d": WEEK}, "card": {"24h": DAY, "7d": WEEK}}
WITH_RECENCY = ("user", "card", "merchant", "user_merchant", "card_merchant")

# Feature name -> family group, in the published order.
FEATURE_FAMILIES: dict[str, str] = {}
for _e in ("user", "card", "merchant"):
    FEATURE_FAMILIES[f"{_e}_prior_txn_count"] = "entity_history"
for _e in ("user", "card", "merchant"):
    FEATURE_FAMILIES[f"{_e}_cold_start"] = "cold_start"
for _e in ("user", "card", "merchant"):
    FEATURE_FAMILIES[f"{_e}_seconds_since_prev_txn"] = "recency"
for _e, _spans in COUNT_LOOKBACKS.items():
    for _s in _spans:
        FEATURE_FAMILIES[f"{_e}_txn_count_{_s}"] = "velocity"
for _e, _spans in AMOUNT_LOOKBACKS.items():
    for _s in _spans:
        FEATURE_FAMILIES[f"{_e}_positive_amount_sum_{_s}"] = "amount_velocity"
for _e in ("user", "card"):
    FEATURE_FAMILIES[f"{_e}_prior_positive_amount_mean"] = "amount_baseline"
    FEATURE_FAMILIES[f"{_e}_prior_positive_amount_std"] = "amount_baseline"
for _e in ("user", "card"):
    FEATURE_FAMILIES[f"current_positive_amount_vs_{_e}_mean"] = "amount_deviation"
for _e in ("user", "card"):
    FEATURE_FAMILIES[f"current_positive_amount_{_e}_z"] = "amount_deviation"
for _e in ("user_merchant", "card_merchant"):
    FEATURE_FAMILIES[f"{_e}_prior_txn_count"] = "merchant_familiarity"
    FEATURE_FAMILIES[f"{_e}_is_new"] = "merchant_familiarity"
    FEATURE_FAMILIES[f"{_e}_seconds_since_prev_txn"] = "merchant_familiarity"
for _e in ("user_mcc", "card_mcc"):
    FEATURE_FAMILIES[f"{_e}_prior_txn_count"] = "mcc_familiarity"
    FEATURE_FAMILIES[f"{_e}_is_new"] = "mcc_familiarity"
for _e in ("user_channel", "card_channel"):
    FEATURE_FAMILIES[f"{_e}_prior_txn_count"] = "channel_familiarity"
    FEATURE_FAMILIES[f"{_e}_is_new"] = "channel_familiarity"
FEATURES = list(FEATURE_FAMILIES)


def keys_of(feature: str) -> str:
    """The entry of ``FAMILIES`` whose history a feature is taken from."""
    if feature.startswith("current_positive_amount_"):
        return "user" if "_user_" in feature else "card"
    return max((f for f in FAMILIES if feature.startswith(f"{f}_")), key=len)


# Layer -> the families it is built from; amount features have a layer of their own.
LAYERS: dict[str, list[str]] = {
    "user_features": ["user"],
    "card_features": ["card"],
    "merchant_features": ["merchant"],
    "amount_features": ["user", "card"],
    "user_merchant_features": ["user_merchant"],
    "card_merchant_features": ["card_merchant"],
    "user_mcc_features": ["user_mcc"],
    "card_mcc_features": ["card_mcc"],
    "channel_features": ["user_channel", "card_channel"],
}

Z_MIN_HISTORY = 5
CONTRACT_VERSION = "PART4_v1.1"
PIT_POLICY = "history_timestamp < current_timestamp"


def pit_window(keys: list[str]):
    """All strictly earlier events of a key; rows must carry ``_us``."""
    return Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)


def _before(keys: list[str], seconds: int):
    """Events earlier than the start of a lookback."""
    return Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, -seconds * 1_000_000 - 1)


def _spans(family: str) -> dict[str, int]:
    return {**COUNT_LOOKBACKS.get(family, {}), **AMOUNT_LOOKBACKS.get(family, {})}


def _square(c: Column) -> Column:
    return (c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)")


def _by_window(df: DataFrame, family: str) -> DataFrame:
    keys = FAMILIES[family]
    prior = pit_window(keys)
    out = [F.count("*").over(prior).alias(f"{family}_n")]
    if family in WITH_RECENCY:
        out.append(F.max("_us").over(prior).alias(f"{family}_last"))
    for name, seconds in COUNT_LOOKBACKS.get(family, {}).items():
        out.append(F.count("*").over(_before(keys, seconds)).alias(f"{family}_n_{name}"))
    if family in AMOUNT_LOOKBACKS:
        out += [
            F.count("_pos").over(prior).alias(f"{family}_pn"),
            F.sum("_pos").over(prior).alias(f"{family}_ps"),
            F.sum(_square(F.col("_pos"))).over(prior).cast("decimal(38,0)").alias(f"{family}_pq"),
        ]
        for name, seconds in AMOUNT_LOOKBACKS[family].items():
            out.append(F.sum("_pos").over(_before(keys, seconds)).alias(f"{family}_ps_{name}"))
    return df.select("*", *out)


def _by_prefix(df: DataFrame, family: str, task_rows: int) -> DataFrame:
    """Same columns for hot keys: running sums over (key, time), looked up at t and at each t-w."""
    keys, spans = FAMILIES[family], _spans(family)
    amounts = family in AMOUNT_LOOKBACKS
    instants = df.groupBy(*keys, "_us").agg(
        F.count("*").alias("_n"), F.count("_pos").alias("_pn"), F.coalesce(F.sum("_pos"), F.lit(0)).alias("_ps"),
        F.coalesce(F.sum(_square(F.col("_pos"))).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("_pq"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    points = instants.select(
        *keys, F.col("_us").alias("_origin"), F.lit("now").alias("_span"), F.col("_us").alias("_at"), F.lit(1).alias("_event"),
        "_n", "_pn", "_ps", "_pq", F.col("_us").alias("_seen"),
    )
    if spans:
        offsets = F.array(*[F.struct(F.lit(n).alias("span"), F.lit(s * 1_000_000).cast("long").alias("us")) for n, s in spans.items()])
        looks = instants.withColumn("_look", F.explode(offsets)).select(
            *keys, F.col("_us").alias("_origin"), F.col("_look.span").alias("_span"),
            (F.col("_us") - F.col("_look.us")).alias("_at"), F.lit(0).alias("_event"),
            zero.alias("_n"), zero.alias("_pn"), zero.alias("_ps"), F.lit(0).cast("decimal(38,0)").alias("_pq"), none.alias("_seen"),
        )
        points = points.unionByName(looks)
    measures = {"c_n": ("_n", "sum"), "c_last": ("_seen", "max")}
    if amounts:
        measures |= {"c_pn": ("_pn", "sum"), "c_ps": ("_ps", "sum"), "c_pq": ("_pq", "sum")}
    # A look-back point sorts before events of the same instant, so it sees only earlier ones.
    summed = prefix(points, keys, ["_at", "_event", "_span", "_origin"], measures, exclusive=True, task_rows=task_rows)

    def at(span: str, column: str) -> Column:
        return F.max(F.when(F.col("_span") == span, F.col(column)))

    out = [at("now", "c_n").alias(f"{family}_n")]
    if family in WITH_RECENCY:
        out.append(at("now", "c_last").alias(f"{family}_last"))
    out += [at(name, "c_n").alias(f"{family}_n_{name}") for name in COUNT_LOOKBACKS.get(family, {})]
    if amounts:
        out += [at("now", "c_pn").alias(f"{family}_pn"), at("now", "c_ps").alias(f"{family}_ps"),
                at("now", "c_pq").cast("decimal(38,0)").alias(f"{family}_pq")]
        out += [at(name, "c_ps").alias(f"{family}_ps_{name}") for name in AMOUNT_LOOKBACKS[family]]
    wide = summed.groupBy(*keys, F.col("_origin").alias("_us")).agg(*out)
    return join_same(df, wide, [*keys, "_us"])


def _derive(df: DataFrame, families: list[str]) -> DataFrame:
    """Replace the running sums of some families by their features, in one projection."""
    out, spent = {}, set()
    for family in families:
        df, features, used = _features(df, family)
        out |= features
        spent |= used
    return df.select(*[c for c in df.columns if c not in spent], *[c.alias(name) for name, c in out.items()])


def _features(df: DataFrame, family: str) -> tuple[DataFrame, dict[str, Column], set[str]]:
    n = F.col(f"{family}_n")
    newness = "cold_start" if family in COUNT_LOOKBACKS else "is_new"
    out = {f"{family}_prior_txn_count": n, f"{family}_{newness}": F.when(n == 0, 1).otherwise(0)}
    if family in WITH_RECENCY:
        out[f"{family}_seconds_since_prev_txn"] = X.whole_seconds_between(F.col(f"{family}_last"), F.col("_us"))
    for name in COUNT_LOOKBACKS.get(family, {}):
        out[f"{family}_txn_count_{name}"] = n - F.col(f"{family}_n_{name}")
    spent = {c for c in df.columns if c == f"{family}_n" or c == f"{family}_last" or c.startswith(f"{family}_n_")}
    if family in AMOUNT_LOOKBACKS:
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        for name in AMOUNT_LOOKBACKS[family]:
            out[f"{family}_positive_amount_sum_{name}"] = X.dollars(zero(f"{family}_ps") - zero(f"{family}_ps_{name}"))
        k, s, q = F.col(f"{family}_pn"), F.col(f"{family}_ps"), F.col(f"{family}_pq")
        wide = lambda c: c.cast("decimal(19,0)")
        spread = (wide(k) * q - wide(s) * wide(s)).cast("double")
        mean_name, std_name = f"{family}_prior_positive_amount_mean", f"{family}_prior_positive_amount_std"
        # Named first, because the four features below use them several times.
        df = df.withColumns({
            mean_name: F.when(k > 0, s.cast("double") / (k.cast("double") * 100.0)),
            std_name: F.when(k > 1, F.sqrt(spread / (k * (k - 1)).cast("double")) / 100.0)})
        amount, mean, std = F.col("amount"), F.col(mean_name), F.col(std_name)
        out[f"current_positive_amount_vs_{family}_mean"] = F.when((amount > 0) & (mean > 0), amount / mean)
        out[f"current_positive_amount_{family}_z"] = F.when((amount > 0) & (k >= Z_MIN_HISTORY) & (std > 0), (amount - mean) / std)
        spent |= {f"{family}_pn", f"{family}_ps", f"{family}_pq", *[f"{family}_ps_{n}" for n in AMOUNT_LOOKBACKS[family]]}
    return df, out, spent


def _history(df: DataFrame, families: list[str], entity: list[str], hot: DataFrame | None, task_rows: int, rows: int | None = None) -> DataFrame:
    cold_rows = df
    if hot is not None:
        cold_rows, hot_rows = split_hot(df, hot, entity)
    # The amount families are derived as soon as they are summed, the others together:
    # small projections compile and run faster than one that holds all features.
    if len(families) > 1 or (rows or 0) > DEALT_ROWS:  # a window by more keys would ask for an exchange of its own, and know nothing of the rows a task sorts
        cold_rows = dealt(cold_rows, entity, rows)
    pairs = [f for f in families if f not in AMOUNT_LOOKBACKS]
    steps = ([pairs] if pairs else []) + [[f] for f in families if f in AMOUNT_LOOKBACKS]
    for step in steps:
        for family in step:
            cold_rows = _by_window(cold_rows, family)
        cold_rows = _derive(cold_rows, step)
    if hot is None:
        return cold_rows
    for step in steps:
        for family in step:
            hot_rows = _by_prefix(hot_rows, family, task_rows)
        hot_rows = _derive(hot_rows, step)
    return cold_rows.unionByName(hot_rows.select(*cold_rows.columns))


def _prepared(df: DataFrame, rows: int | None, task_rows: int, entities: tuple[str, ...] = ("merchant", "user")) -> tuple[DataFrame, dict[str, DataFrame | None]]:
    prepared = df.withColumn("_us", X.micros("transaction_timestamp")).withColumn(
        "_pos", F.when(F.col("amount") > 0, X.cents("amount"))
    )
    small = rows is not None and rows <= task_rows
    return prepared, {e: None if small else hot_keys(df, FAMILIES[e], task_rows) for e in entities}


def feature_layers(df: DataFrame, *, rows: int | None = None, task_rows: int = TASK_ROWS) -> dict[str, DataFrame]:
    """The nine feature families, each built alone from a transaction table: ``source_row_id`` and the features of the layer."""
    prepared, hot = _prepared(df, rows, task_rows)
    layers = {}
    for name, families in LAYERS.items():
        entity = "merchant" if families == ["merchant"] else "user"
        made = _history(prepared, families, FAMILIES[entity], hot[entity], task_rows, rows)
        own = [f for f in FEATURES if f in made.columns and FEATURE_FAMILIES[f].startswith("amount_") == (name == "amount_features")]
        layers[name] = made.select("source_row_id", *own)
    return layers


def behavior_features(df: DataFrame, *, rows: int | None = None, task_rows: int = TASK_ROWS, features: Sequence[str] = FEATURES) -> DataFrame:
    """Add the 43 features (or some ``features``), the availability flags and the contract versions to a transaction table.

    ``rows`` is an upper bound on the input size if one is known; without it, or
    above ``task_rows``, one aggregation per entity looks for hot keys first.
    Rows are dealt out for the entities of the wanted features only.
    """
    wanted = {keys_of(f) for f in features}
    # Pairs first: they add few columns, so most sorts move narrow rows.
    sides = {"merchant": ["merchant"], "user": [f for f in FAMILIES if f not in ("merchant", "user", "card")] + ["card", "user"]}
    sides = {e: [f for f in families if f in wanted] for e, families in sides.items()}
    seen, hot = _prepared(df, rows, task_rows, tuple(e for e, families in sides.items() if families))
    # The flag takes the place of the text on the way.
    seen = seen.withColumn("_state_missing", F.when(F.col("merchant_state").isNull(), 1).otherwise(0))
    for entity, keys in hot.items():
        seen = _history(seen, sides[entity], FAMILIES[entity], keys, task_rows, rows)
    return seen.select(
        *df.columns,
        *features,
        (F.col("amount") > 0).alias("current_positive_amount"),
        F.col("_state_missing").alias("state_missing_flag"),
        F.lit(CONTRACT_VERSION).alias("feature_contract_version"),
        F.lit(PIT_POLICY).alias("pit_policy_version"),
    )
