"""Conversation structure repair: faults of each turn, and the cheapest edits to an alternating conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut, hot_keys, split_hot
from .audit import ENDS, NOTHING, applied, joined, paths
from .chat import _filled, _rows
from .common import table

#: White space of the fault rules.
SPACES = " \t\n\x0b\x0c\r"

#: Turns whose edits are worked out at once; longer conversations are put together from such segments.
SEGMENT = 2_000

#: Conversations with more turns than this are spread over tasks.
TASK_TURNS = 100_000

_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ("audit", pa.string()), ("repaired", _REPAIRED)])
_DDL = "conv_id long, piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role string, text string>>"


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, t, r, x, n): the rows as the contract damages them, ``n`` telling how often a row stays (0, 1 or 2). Null roles and texts are a
    space; a null id or turn is a space in the text that is hashed and stays null."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(word(key), F.lit(":"), word(turn))) % 20).cast("int")
    x = F.when(kind == 1, "").when(kind == 2, F.translate(word(text), ".!?", "")).when(kind == 0, "").otherwise(word(text))
    return rows.select(F.col(key).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.when(kind == 4, "user").otherwise(word(role)).alias("r"), x.alias("x"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def _faults(r: str, x: str, seen: bool) -> tuple[str, bool, bool, bool]:
    """Initial, blank, duplicate, truncated: the first fault counts."""
    bare = x.strip(SPACES)
    blank = not bare
    return r[:1], blank, seen and not blank, not blank and not seen and bare[-1] not in ".!?"


def _segments(flags: Iterator[tuple], starts: list[int], size: int) -> Iterator[list]:
    """For each ``size`` rows the table [start][end] of least cost and audit."""
    first = True
    while block := list(islice(flags, size)):
        rows = [(i, b or d, t) for i, b, d, t in block]
        yield [paths(rows, s, first and s == NOTHING) if s in starts else None for s in range(4)]
        first, starts = False, [0, 1, 2, 3]


def _no_rows(start: int) -> list:
    return [(0, "") if s == start else None for s in range(4)]


def _whole(segment: int):
    """Conversations that a task sees one after the other, each in order."""

    def one(c, rows) -> tuple:
        kept, flags, turns, seen = [], [], set(), set()
        for _, t, r, x, n in rows:
            for _ in range(n):
                mark = hashlib.blake2b(f"{len(r)}:{r}{x}".encode(), digest_size=16).digest()
                flags.append(_faults(r, x, mark in seen))
                seen.add(mark)
                kept.append((r, x))
                if t is not None:
                    turns.add(t)
        cells = _no_rows(NOTHING)
        for after in _segments(iter(flags), [NOTHING], segment):
            cells, _ = joined(cells, after)
        cost, audit = min(c for c in (cells[s] for s in ENDS) if c is not None)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return (c, 0, gaps, *(sum(f[k] for f in flags) for k in (1, 2, 3)), illegal, cost, audit, [{"role": r, "text": x} for r, x in applied(audit, kept)])

    def work(batches):
        groups = groupby(_rows(batches, ["c", "t", "r", "x", "n"]), key=lambda row: row[0])
        return _filled((one(c, rows) for c, rows in groups), _SCHEMA, lambda row: 300 + sum(len(p["text"]) for p in row[-1]), 4_000_000)

    return work


def _spread(rows: DataFrame, segment: int) -> DataFrame:
    """The same for conversations of any length: rows in ranges of (conversation, turn), a table of edits for each range, ranges put together.

    A task holds a range of rows, or the audits of one conversation's ranges (at most 16 letters a turn, no texts).
    """
    order = ["c", F.asc_nulls_first("t"), "r", "x"]
    copies = rows.withColumn("u", F.monotonically_increasing_id()).where("n > 0").select("c", "t", "r", "x", F.explode(F.sequence(F.lit(1), "n")).alias("n"), "u")
    ranged = cut(copies.repartitionByRange(*order, "u", "n").sortWithinPartitions(*order, "u", "n").select("c", "t", "r", "x", F.spark_partition_id().cast("long").alias("p"), F.monotonically_increasing_id().alias("pos")))
    firsts = ranged.groupBy("c", "r", F.sha2("x", 256).alias("d")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    flagged = cut(ranged.join(firsts, "pos", "left").select("c", "t", "r", "x", "p", "pos", F.col("new").isNull().alias("seen")))
    part = pa.schema([("c", pa.int64()), ("p", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])

    def measured(batches):
        def one(c, p, rows):
            counts, edge = [0] * 4, [None, None]

            def flags():
                for row in rows:
                    f = _faults(row[2], row[3], row[4])
                    for k in (1, 2, 3):
                        counts[k - 1] += f[k]
                    if edge[0] is None:
                        edge[0] = f[0]
                    else:
                        counts[3] += edge[1] + f[0] not in ("su", "ua", "au")
                    edge[1] = f[0]
                    yield f

            reached = [_no_rows(s) for s in range(4)]
            for after in _segments(flags(), [0, 1, 2, 3], segment):
                reached = [joined(cells, after)[0] for cells in reached]
            flat = [cell for cells in reached for cell in cells]
            return (c, p, *counts, *edge, [None if f is None else f[0] for f in flat], [None if f is None else f[1] for f in flat])

        groups = groupby(_rows(batches, ["c", "p", "r", "x", "seen"]), key=lambda row: row[:2])
        return _filled((one(c, p, rows) for (c, p), rows in groups), part, most=20)

    grouped = flagged.repartition("c", "p").sortWithinPartitions("c", "p", "pos")
    parts = grouped.select("c", "p", "r", "x", "seen").mapInArrow(measured, "c long, p long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost array<long>, audit array<string>")
    turns = ranged.where("t is not null").select("c", "t").distinct().groupBy("c").agg((F.max("t") - F.min("t") + 1 - F.count("*")).alias("gaps"))
    # one row a range, so as many for a conversation as it has ranges
    ids = rows.select("c").distinct()
    dealt = parts.unionByName(ids.select("c"), allowMissingColumns=True).repartition("c").sortWithinPartitions("c", F.asc_nulls_first("p"))
    chosen_schema = pa.schema([("c", pa.int64()), ("p", pa.int64()), ("piece", pa.int64()), ("state", pa.int32()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("total", pa.int64()), ("edits", pa.string()), ("whole", pa.string())])

    def chosen(batches):
        def one(c, ranges):
            cells, back, counts, last = _no_rows(NOTHING), [], [0] * 4, None
            for _, p, *more, first, end, cost, audit in ranges:
                if p is None:
                    continue
                counts = [a + b for a, b in zip(counts, more, strict=True)]
                counts[3] += last is not None and last + first not in ("su", "ua", "au")
                last = end
                after = [[None if cost[4 * s + e] is None else (cost[4 * s + e], audit[4 * s + e]) for e in range(4)] for s in range(4)]
                cells, starts = joined(cells, after)
                back.append((p, starts, after))
            at, (total, whole) = min(((s, cells[s]) for s in ENDS if cells[s] is not None), key=lambda x: x[1])
            path = []
            for p, starts, after in reversed(back):
                path.append((p, starts[at], after[starts[at]][at][1]))
                at = starts[at]
            path.reverse()
            for piece, (p, state, edits) in enumerate(path or [(None, NOTHING, "")]):
                head = (*counts, total) if not piece else (None,) * 5
                yield (c, p, piece, state, *head, edits, None if piece else whole)

        groups = groupby(_rows(batches, part.names), key=lambda row: row[0])
        return _filled((row for c, ranges in groups for row in one(c, ranges)), chosen_schema, lambda row: 100 + len(row[-2]), 4_000_000)

    ways = cut(dealt.mapInArrow(chosen, "c long, p long, piece long, state int, blank long, duplicate long, truncated long, illegal long, total long, edits string, whole string"))
    headed = ways.select("c", "p", F.lit(-1).cast("long").alias("pos"), "piece", "state", "edits").unionByName(flagged.select("c", "p", "pos", "r", "x"), allowMissingColumns=True)
    fixed = pa.schema([("c", pa.int64()), ("piece", pa.int64()), ("repaired", _REPAIRED)])

    def repaired(batches):
        def one(c, rows):
            head = next(rows)
            return c, head[4], [{"role": r, "text": x} for r, x in applied(head[6], [(row[2], row[3]) for row in rows], head[5])]

        groups = groupby(_rows(batches, ["c", "p", "r", "x", "piece", "state", "edits"]), key=lambda row: row[:2])
        return _filled((one(c, rows) for (c, _), rows in groups), fixed, lambda row: 300 + sum(len(q["text"]) for q in row[-1]), 4_000_000)

    bodies = headed.repartition("c", "p").sortWithinPartitions("c", "p", "pos").select("c", "p", "r", "x", "piece", "state", "edits").mapInArrow(repaired, "c long, piece long, repaired array<struct<role string, text string>>")
    heads = ways.where("piece = 0").join(turns.withColumnRenamed("c", "k"), F.col("c").eqNullSafe(F.col("k")), "left").select("c", "piece", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("total").alias("cost"), F.col("whole").alias("audit"))
    heads = heads.select(F.col("c").alias("_c"), F.col("piece").alias("_p"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    both = bodies.join(heads, F.col("c").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p")), "left")
    return both.select(F.col("c").alias("conv_id"), "piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def repair(rows: DataFrame, key: str = "c", turn: str = "t", role: str = "r", text: str = "x", copies: Column | str = "n", segment: int = SEGMENT, task_turns: int = TASK_TURNS) -> DataFrame:
    """(conv_id, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation.

    ``copies`` is how often a row counts; an id whose rows all count 0 times is a conversation without rows. Rows are in the order of ``turn``
    (null first; ties by role, then text). Rows without an id are one conversation, an empty table has no result, other columns do not matter.
    Null roles and texts are a space, so such rows are blank.

    ``repaired`` holds the repaired (role, text) rows. Piece 0 carries the counts and the audit; conversations of over ``task_turns`` rows
    (found by a count; no less than 1/100,000 of the table) have a piece for each range of rows, in order, the others one piece in all.

    One shuffle brings a conversation's turns together, and its edits are found segment by segment. Long conversations are divided over tasks
    by ranges of turns: a range's edits from each of four states do not depend on other ranges, and only these tables meet.
    """
    word = lambda c: F.coalesce(F.col(c), F.lit(" "))
    taken = rows.select(F.col(key).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), word(role).alias("r"), word(text).alias("x"), (F.col(copies) if isinstance(copies, str) else copies).cast("int").alias("n"))
    hot = hot_keys(taken.select("c"), ["c"], task_turns)
    small, long = (taken, None) if hot is None else split_hot(taken, hot, ["c"])
    ordered = small.repartition("c").sortWithinPartitions("c", F.asc_nulls_first("t"), "r", "x")
    out = ordered.mapInArrow(_whole(segment), _DDL)
    if long is None:
        return out
    # pieces of a conversation one after the other, as in the other branch
    return out.unionByName(_spread(long, segment).repartition("conv_id").sortWithinPartitions("conv_id", "piece"))


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, with ``repaired_sha256`` over its repaired ``role:text`` rows joined by newlines, in place of the rows.

    The pieces of a conversation must lie one after the other, as ``repair`` leaves them; the digest is updated piece by piece.
    """
    schema = pa.schema([*list(_SCHEMA)[:1], *list(_SCHEMA)[2:9], ("repaired_sha256", pa.string())])

    def one(c, rows):
        digest, head, some = hashlib.sha256(), None, False
        for row in rows:
            head = head or row[2:-1]
            for turn in row[-1]:
                digest.update(f"{chr(10) if some else ''}{turn['role']}:{turn['text']}".encode())
                some = True
        return (c, *head, digest.hexdigest())

    def work(batches):
        return _filled((one(c, rows) for c, rows in groupby(_rows(batches, _SCHEMA.names), key=lambda row: row[0])), schema)

    return pieces.mapInArrow(work, _DDL.replace("piece long, ", "").replace("repaired array<struct<role string, text string>>", "repaired_sha256 string"))


def op11_conversation_repair(spark, sf_dir):
    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))


def _sql() -> str:
    """The dynamic programme row by row in a recursive query, each state a struct of cost, audit and repaired text."""
    step = lambda cell, cost, letter, text: f"case when {cell} is not null then {{'c': {cell}.c + {cost}, 'a': {cell}.a || '{letter}', 'r': {cell}.r || {text}}} end"
    line = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    into = {"u": ("cn", "cs", "ca"), "a": ("cu",)}
    role = {"u": "'user'", "a": "'assistant'"}
    edits = {s: [step(f"c{s}", 3, "D", "''")] for s in "nsua"}
    for s, sources in into.items():
        for c in sources:
            edits[s].append(f"case when not bad and i = '{s}' then {step(c, 't', 'K', line('role', 'text'))} end")
            edits[s].append(f"case when not bad then {step(c, '2 + t', 'R', line(role[s], 'text'))} end")
    edits["s"].append(f"case when not bad and i = 's' then {step('cn', 't', 'K', line('role', 'text'))} end")
    least = lambda options: f"least({', '.join(options)})"
    insert = lambda cells, n: f"select {cells}, " + ", ".join([
        "cn", "cs", least(["cu", *(step(c, 2, "I", line(role["u"])) for c in into["u"])]) + " as cu", least(["ca", step("cu", 2, "I", line(role["a"]))]) + " as ca"]) + f" from ({n})"
    three = lambda source, cells: insert(cells, insert(cells, insert(cells, source)))
    none = "null::struct(c bigint, a varchar, r varchar)"
    begin = three(f"select conv_id, 0 as pos, {{'c': 0::bigint, 'a': '', 'r': ''}}::struct(c bigint, a varchar, r varchar) as cn, {none} as cs, {none} as cu, {none} as ca from ids", "conv_id, pos")
    rows = three("select d.conv_id, d.pos + 1 as pos, " + ", ".join(f"{least(o) if len(o) > 1 else o[0]} as c{s}" for s, o in edits.items()) + " from dp d join faults f on f.conv_id is not distinct from d.conv_id and f.pos = d.pos + 1", "conv_id, pos")
    return rf"""with recursive crc as (select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) g(i))),
words as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as w from conversations),
kinds as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(w, ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as k from words, crc),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text
  from kinds, range(2) copy(n) where k <> 0 and (n = 0 or k = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from damaged),
seen as (select *, left(role, 1) as i, row_number() over (partition by conv_id, role, text order by pos) > 1 as again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from numbered),
faults as (select conv_id, turn, role, text, pos, i, last = '' as blank, last <> '' and again as duplicate, last <> '' and not again and last not in ('.', '!', '?') as truncated, last = '' or again as bad,
  case when last <> '' and not again and last not in ('.', '!', '?') then 1 else 0 end as t, lag(i) over (partition by conv_id order by pos) || i not in ('su', 'ua', 'au') as illegal from seen),
ids as (select distinct conv_id from conversations),
dp(conv_id, pos, cn, cs, cu, ca) as ({begin} union all {rows}),
ended as (select conv_id, least(cn, ca) as best from dp qualify row_number() over (partition by conv_id order by pos desc) = 1),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
  count(*) filter (where illegal) as illegal from faults group by conv_id)
select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
  sha256(substr(best.r, 2)) as repaired_sha256 from ended e left join counts c on c.conv_id is not distinct from e.conv_id"""


SQL = _sql()
