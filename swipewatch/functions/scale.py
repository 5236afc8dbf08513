"""Building blocks that keep a plan balanced when one key holds much of the data.

A window function sends every row of its partition to one task. That is fine
while a partition has a known, moderate size. ``prefix`` gives the same ordered
running aggregates without that limit: it range-partitions by the full sort key,
aggregates inside each range and adds what earlier ranges carry over.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Rows one task may sort for a window before the range-partitioned plan is used.
TASK_ROWS = 2_000_000

# Rows that one task sorts at most, about, where rows are dealt out by key; several sorts of that many wide rows stay in memory.
DEALT_ROWS = 300_000

# Upper bound on rows of a table that is broadcast on purpose.
BROADCAST_ROWS = 200_000

# A key is hot only above 1/HOT_KEY_DIVISOR of all rows, so there are never more
# hot keys than this and their list may be broadcast.
HOT_KEY_DIVISOR = 100_000

# Quantiles narrow the range of each wanted position by so many bins a scan, for so
# many (group, position) pairs at most; the scans end when few rows are left in the ranges.
RANGE_BINS = 1024
RANGES_AT_MOST = 4_096
RANGE_SCANS = 4

# Quantiles of many columns: bounds around the wanted position come from a sketch of about so many rows, and are proved by counts over all rows.
SKETCH_ROWS, SKETCH_ACCURACY = 500_000, 5_000

# Columns that one scan aggregates: code for more of them is too long to be compiled.
COLUMNS_A_SCAN = 10


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="swipewatch-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, in compressed columns: for wide tables that are read several times, a few columns at a time. The order of rows is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None = None, dealt_rows: int = DEALT_ROWS) -> DataFrame:
    """``df`` dealt out by key for windows and joins that follow. ``rows`` is an upper bound on its rows if known: with more than ``dealt_rows`` a
    task, there are more tasks, so that what each sorts does not grow with the input and is not spilled."""
    parts = math.ceil((rows or 0) / dealt_rows)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*keys)
    return df.repartition(parts, *keys)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """NULL-safe equi-join that keeps one copy of the key columns."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def rows_at_most(df: DataFrame, limit: int, known: int | None = None) -> bool:
    """Whether ``df`` has at most ``limit`` rows; ``known`` is an upper bound if one is at hand."""
    if known is not None and known <= limit:
        return True
    return df.count() <= limit


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    measures: dict[str, tuple[str, str]],
    *,
    exclusive: bool = False,
    rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Running ``sum``/``max``/``min`` per group in a total order.

    ``measures`` maps an output column to ``(input column, aggregate)``. ``order``
    must be unique within a group, or ties resolve arbitrarily. ``exclusive``
    leaves the current row out. Exclusive sums start at 0, extremes at NULL.
    """
    by = list(by)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    last = -1 if exclusive else 0

    def running(spec):
        out = []
        for name, (source, how) in measures.items():
            value = _AGGREGATES[how](source).over(spec)
            out.append((F.coalesce(value, F.lit(0)) if how == "sum" else value).alias(name))
        return out

    if rows is None or rows > task_rows:
        rows = df.count()
    if rows <= task_rows:
        spec = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.select("*", *running(spec))

    parts = max(math.ceil(rows / DEALT_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *[F.col(b) for b in by], *order)
    # The range bounds come from a sample, so the range number must be fixed on
    # disk before two branches of the plan use it. Rows are sorted again below, so their order may be lost.
    ranged = stored(ranged.withColumn("_range", F.spark_partition_id()))
    keys = [*by, "_range"]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = dealt(ranged, keys, rows).select("*", *running(inner))
    totals = ranged.groupBy(*keys).agg(
        *[_AGGREGATES[how](source).alias(f"_t_{name}") for name, (source, how) in measures.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *[_AGGREGATES[how](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (_, how) in measures.items()],
    )
    joined = join_same(local, carried, keys)
    combined = []
    for name, (_, how) in measures.items():
        if how == "sum":
            value = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        elif how == "max":
            value = F.greatest(F.col(name), F.col(f"_c_{name}"))
        else:
            value = F.least(F.col(name), F.col(f"_c_{name}"))
        combined.append(value.alias(name))
    return joined.select(*df.columns, *combined)


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    name: str = "rank",
    *,
    rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """1-based position per group; ``order`` must be a total order."""
    numbered = prefix(
        df.withColumn("_one", F.lit(1).cast("long")), by, order, {name: ("_one", "sum")}, rows=rows, task_rows=task_rows
    )
    return numbered.drop("_one")


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    name: str = "quantiles",
    weight: str | None = None,
    rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as an array in the order of ``probs``. A row counts ``weight`` times, or once.

    The built-in ``percentile`` keeps every distinct value of a group in one task.
    Past ``task_rows`` rows scans of ``df`` count bins, which leaves a narrow range
    around each wanted position; only values in the ranges are shuffled, and the
    positions are looked up in their running counts. Write ``df`` first if it is
    costly. With a weight, or for many groups, all distinct values are counted.
    """
    by = list(by)
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if weight is None and (rows is None or rows > task_rows):
        found = _within_ranges(present, value, probs, by, name, task_rows)
        if found is not None:
            return found
    if rows_at_most(present, task_rows, rows):
        return present.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), F.lit(1) if weight is None else F.col(weight)).alias(name))
    counted = present.groupBy(*by, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    cumulative = prefix(counted, by, [value], {"_upto": ("_n", "sum")}, task_rows=task_rows)
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        wanted = join_same(cumulative, totals, by, "inner")
    else:
        total = totals.first()["_total"]
        wanted = cumulative.withColumn("_total", F.lit(total).cast("long"))
    wanted = wanted.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    position = F.col("_p") * (F.col("_total") - 1)
    start = F.col("_upto") - F.col("_n")
    wanted = wanted.withColumn("_pos", position)

    def at(index):
        return F.max(F.when((start <= index) & (index < F.col("_upto")), F.col(value)))

    near = wanted.where((start <= F.ceil("_pos")) & (F.floor("_pos") < F.col("_upto")))
    per_prob = near.groupBy(*by, "_p").agg(
        at(F.floor("_pos")).cast("double").alias("_lo"), at(F.ceil("_pos")).cast("double").alias("_hi"),
        F.max("_pos").alias("_pos"),
    )
    fraction = F.col("_pos") - F.floor("_pos")
    per_prob = per_prob.withColumn(
        "_v",
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
            F.col("_lo") * (1 - fraction) + F.col("_hi") * fraction
        ),
    )
    looked = F.map_from_entries(F.collect_list(F.struct("_p", "_v")))
    return (
        per_prob.groupBy(*by)
        .agg(looked.alias("_m"))
        .select(*by, F.array(*[F.col("_m")[F.lit(float(p))] for p in probs]).alias(name))
    )


def _within_ranges(present: DataFrame, value: str, probs: Sequence[float], by: list[str], name: str, task_rows: int) -> DataFrame | None:
    """``quantiles`` of present values by ranges around the wanted positions, or None for too many groups.

    A range is in terms of a logarithm that keeps the order of values. The driver holds one range a group and position.
    """
    spark = present.sparkSession
    # The logarithm only has to grow with the value; infinite values are at its ends.
    v = F.col(value).cast("double")
    place = F.signum(v) * F.log1p(F.least(F.abs(v), F.lit(1.7e308)))
    keyed = present.select(*by, v.alias("_v"), place.alias("_x"))
    groups = keyed.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).limit(RANGES_AT_MOST // len(probs) + 1).collect()
    if len(groups) * len(probs) > RANGES_AT_MOST:
        return None
    if sum(g["n"] for g in groups) <= max(task_rows, 0):
        return present.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias(name))
    key_fields = [present.schema[b] for b in by]
    # Per group: its keys, its rows, and per position [low, high, rows below low, rows inside].
    state = []
    for g in groups:
        wanted = {}
        for p in probs:
            at = float(p) * (g["n"] - 1)
            wanted[float(p)] = (math.floor(at), math.ceil(at), at)
        state.append(([g[b] for b in by], g["n"], wanted, {float(p): (g["lo"], g["hi"], 0, g["n"]) for p in probs}))

    def inside(open_only: bool) -> DataFrame:
        """Rows with each of the distinct ranges of their group that they are in."""
        schema = T.StructType([*key_fields, T.StructField("_g", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
        ranges = [(*keys, i, lo, hi) for i, (keys, _, _, spans) in enumerate(state) for lo, hi in sorted({(lo, hi) for lo, hi, _, _ in spans.values() if lo < hi or not open_only})]
        spans = F.broadcast(spark.createDataFrame(ranges, schema))
        joined = join_same(keyed, spans, by, "inner") if by else keyed.join(spans)
        return joined.where(F.col("_x").between(F.col("_lo"), F.col("_hi"))).select("_g", "_lo", "_hi", "_v", "_x")

    for _ in range(RANGE_SCANS):
        left = sum(n for _, _, _, spans in state for n in {(lo, hi): n for lo, hi, _, n in spans.values() if lo < hi}.values())
        if left <= task_rows:
            break
        lo, hi = F.col("_lo"), F.col("_hi")
        bin_ = F.least(F.floor((F.col("_x") - lo) / (hi - lo) * RANGE_BINS), F.lit(RANGE_BINS - 1)).cast("int")
        cells: dict[tuple, list] = {}
        for r in inside(True).groupBy("_g", "_lo", "_hi", bin_.alias("_bin")).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect():
            cells.setdefault((r["_g"], r["_lo"], r["_hi"]), []).append((r["_bin"], r["n"], r["lo"], r["hi"]))
        for found in cells.values():
            found.sort()
        for i, (_, _, wanted, spans) in enumerate(state):
            for p, (low, high, below, n) in spans.items():
                if not low < high:
                    continue
                first, last, _ = wanted[p]
                start, kept = below, []
                for _, rows, a, b in cells[i, low, high]:
                    if first < start + rows and last >= start:
                        kept.append((a, b, start, rows))
                    start += rows
                spans[p] = (kept[0][0], kept[-1][1], kept[0][2], sum(k[3] for k in kept))
    positions = [(i, low, high, p, below, *wanted[p]) for i, (_, _, wanted, spans) in enumerate(state) for p, (low, high, below, _) in spans.items()]
    asked = F.broadcast(spark.createDataFrame(positions, "_g int, _lo double, _hi double, _p double, _below long, _first long, _last long, _pos double"))
    counted = cut(inside(False).groupBy("_g", "_lo", "_hi", "_v").agg(F.count("*").alias("_n")))
    cumulative = prefix(counted, ["_g", "_lo", "_hi"], ["_v"], {"_upto": ("_n", "sum")}, task_rows=task_rows)
    start, end = F.col("_below") + F.col("_upto") - F.col("_n"), F.col("_below") + F.col("_upto")
    at = lambda c: F.max(F.when((start <= F.col(c)) & (F.col(c) < end), F.col("_v")))
    looked = cumulative.join(asked, ["_g", "_lo", "_hi"]).where((start <= F.col("_last")) & (F.col("_first") < end))
    per = looked.groupBy("_g", "_p").agg(at("_first").alias("_a"), at("_last").alias("_b"), F.max("_pos").alias("_pos"))
    fraction = F.col("_pos") - F.floor("_pos")
    per = per.withColumn("_q", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - fraction) + F.col("_b") * fraction))
    values = per.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_q"))).alias("_m"))
    keys = spark.createDataFrame([(*k, i) for i, (k, _, _, _) in enumerate(state)], T.StructType([*key_fields, T.StructField("_g", T.IntegerType())]))
    return values.join(F.broadcast(keys), "_g").select(*by, F.array(*[F.col("_m")[F.lit(float(p))] for p in probs]).alias(name))


def column_quantiles(df: DataFrame, columns: Sequence[str], prob: float, by: Sequence[str] = (), *, more: Callable[[str], dict[str, Column]] = lambda _: {}) -> dict[tuple, dict]:
    """(*group, column) -> its exact interpolated quantile ``q``, its rows ``n``, its present values ``k``, and the aggregates ``more`` asks for.

    For few groups of many rows: the answer is held by the driver. Rows are not repeated for each column. A sketch gives bounds around the wanted
    position, a scan of all rows counts the values below, at and between the bounds, and only values strictly between them are shuffled. Where
    counts show that a position lies outside, wider bounds are counted, at last none. Missing values and NaN do not count. Write ``df`` first.
    """
    by, columns = list(by), list(columns)
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    total = max(df.count(), 1)
    near = 2 / math.sqrt(min(total, SKETCH_ROWS)) + 2 / SKETCH_ACCURACY
    asked = [min(max(prob + d * near, 0.0), 1.0) for d in (-8, -1, 1, 8)]
    some = df if total <= SKETCH_ROWS else df.sample(SKETCH_ROWS / total, seed=0)
    sketch = [r.asDict() for r in some.groupBy(*by).agg(*[F.percentile_approx(value(c), asked, SKETCH_ACCURACY).alias(f"_s{i}") for i, c in enumerate(columns)]).limit(RANGES_AT_MOST).collect()]
    seen = {(*[r[b] for b in by], c): r[f"_s{i}"] for r in sketch for i, c in enumerate(columns)}
    nothing = [-math.inf, -math.inf, math.inf, math.inf]
    levels = [lambda s: (s[1], s[2]), lambda s: (s[0], s[3]), lambda _: (-math.inf, math.inf)]

    def bounded(wanted: list[str], bounds: dict[tuple, tuple]) -> tuple[DataFrame, Callable[[int, int], Column]]:
        """Rows beside the bounds of their group, and the expression of one of the two bounds of a wanted column."""
        if not by:
            return df, lambda i, side: F.lit(float(bounds[wanted[i],][side]))
        groups = list(dict.fromkeys(k[:-1] for k in bounds))
        sides = [[[float(bounds[(*g, c)][side]) for c in wanted] for side in (0, 1)] for g in groups]
        table = df.sparkSession.createDataFrame([(*g, *s) for g, s in zip(groups, sides, strict=True)], T.StructType([*[df.schema[b] for b in by], T.StructField("_lo", T.ArrayType(T.DoubleType())), T.StructField("_hi", T.ArrayType(T.DoubleType()))]))
        return join_same(df, F.broadcast(table), by), lambda i, side: F.coalesce(F.get(("_lo", "_hi")[side], F.lit(i)), F.lit((-math.inf, math.inf)[side]))

    out: dict[tuple, dict] = {}
    spans: dict[tuple, tuple] = {}  # (low, high, values strictly between, position of the first of them)
    open_ = columns
    for level in levels:
        missed = []
        for a in range(0, len(open_), COLUMNS_A_SCAN):
            part = open_[a : a + COLUMNS_A_SCAN]
            bounds = {k: level(s or nothing) for k, s in seen.items() if k[-1] in part}
            rows, at = bounded(part, bounds)
            aggs = [F.count("*").alias("_rows")]
            for i, c in enumerate(part):
                v, lo, hi = value(c), at(i, 0), at(i, 1)
                counts = {"k": F.count(v), "below": F.count_if(v < lo), "low": F.count_if(v == lo), "mid": F.count_if((v > lo) & (v < hi)), "high": F.count_if((v == hi) & (lo < hi)), **more(c)}
                aggs += [e.alias(f"{n}_{i}") for n, e in counts.items()]
            for r in rows.groupBy(*by).agg(*aggs).limit(RANGES_AT_MOST + 1).collect():
                for i, c in enumerate(part):
                    key = (*[r[b] for b in by], c)
                    if "q" in out.get(key, ()):
                        continue
                    found = out[key] = {"n": r["_rows"], "k": r[f"k_{i}"], **{n: r[f"{n}_{i}"] for n in more(c)}}
                    where, (lo, hi) = prob * (found["k"] - 1), bounds.get(key, (-math.inf, math.inf))
                    start, ends = r[f"below_{i}"], r[f"low_{i}"]
                    if not found["k"]:
                        found["q"] = None
                    elif math.floor(where) < start or math.ceil(where) >= start + ends + r[f"mid_{i}"] + r[f"high_{i}"]:
                        missed.append(c)
                    else:
                        spans[key] = (lo, hi, r[f"mid_{i}"], start + ends)
                        found["q"] = where
        open_ = list(dict.fromkeys(missed))
        if not open_:
            break
    # Positions strictly between two bounds are looked up among the values there.
    inside = {k: [p for p in {math.floor(out[k]["q"]), math.ceil(out[k]["q"])} if s[3] <= p < s[3] + s[2]] for k, s in spans.items()}
    wanted = [c for c in columns if any(inside[k] for k in inside if k[-1] == c)]
    values: dict[tuple, float] = {}
    if wanted:
        bounds = {(*k[:-1], c): spans[(*k[:-1], c)][:2] if inside.get((*k[:-1], c)) else (0.0, 0.0) for k in spans for c in wanted}
        rows, at = bounded(wanted, bounds)
        one = lambda i, c: F.when((value(c) > at(i, 0)) & (value(c) < at(i, 1)), F.struct(F.lit(i).alias("_i"), value(c).alias("_v")))
        between = rows.select(*by, F.explode(F.array_compact(F.array(*[one(i, c) for i, c in enumerate(wanted)]))).alias("_e")).select(*by, "_e._i", "_e._v")
        counted = stored(between.groupBy(*by, "_i", "_v").agg(F.count("*").alias("_n")))
        upto = prefix(counted, [*by, "_i"], ["_v"], {"_upto": ("_n", "sum")})
        places = [(*k[:-1], wanted.index(k[-1]), p - spans[k][3], p) for k, ps in inside.items() for p in ps]
        table = df.sparkSession.createDataFrame(places, T.StructType([*[df.schema[b] for b in by], T.StructField("_i", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_p", T.LongType())]))
        looked = join_same(upto, F.broadcast(table), [*by, "_i"], "inner").where((F.col("_upto") - F.col("_n") <= F.col("_at")) & (F.col("_at") < F.col("_upto")))
        values = {(*[r[b] for b in by], wanted[r["_i"]], r["_p"]): r["_v"] for r in looked.collect()}
    for key, (lo, hi, mid, start) in spans.items():
        where = out[key]["q"]
        a, b = ((lo if p < start else hi if p >= start + mid else values[(*key, p)]) for p in (math.floor(where), math.ceil(where)))
        share = where - math.floor(where)
        out[key]["q"] = a if a == b else a * (1 - share) + b * share
    return out


def hot_keys(df: DataFrame, key: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """Keys with more rows than one task should sort, or None when there are none.

    The limit is never below 1/HOT_KEY_DIVISOR of all rows, so the result has at
    most HOT_KEY_DIVISOR rows and may be broadcast.
    """
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("total")).first()
    limit = max(task_rows, (top["total"] or 0) // HOT_KEY_DIVISOR)
    if (top["most"] or 0) <= limit:
        return None
    return cut(counts.where(F.col("_n") > limit).select(*key))


def split_hot(df: DataFrame, hot: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of hot keys)."""
    listed = F.broadcast(hot.select([F.col(k).alias(f"_h_{k}") for k in key]))
    condition = F.lit(True)
    for k in key:
        condition = condition & df[k].eqNullSafe(F.col(f"_h_{k}"))
    return df.join(listed, condition, "left_anti"), df.join(listed, condition, "left_semi")


def join_by_key(left: DataFrame, right: DataFrame, key: Sequence[str], *, rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Left join to ``right``, which has one row a key. Rows of hot keys do not meet in a task: what ``right`` has for them is sent around,
    as many rows as there are hot keys at most. ``rows`` is an upper bound on the rows of ``left``, if known."""
    hot = None if rows is not None and rows <= task_rows else hot_keys(left, key, task_rows)
    if hot is None:
        return left.join(right, list(key), "left")
    others, many = split_hot(left, hot, key)
    return others.join(right, list(key), "left").unionByName(many.join(F.broadcast(split_hot(right, hot, key)[1]), list(key), "left"))
