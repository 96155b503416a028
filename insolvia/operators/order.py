"""Order-dependent primitives that stay bounded per task.

Quantiles, cuts by rank, running totals and windows over an ordered sequence all need a
global order.  Below ``insolvia.maxTaskRows`` rows per group they use Spark's own
aggregate or window.  Above it they narrow brackets around the wanted ranks, or number
the rows of a range-partitioned table and work on equal-sized chunks of it, so no group
is ever pulled whole into one task.  Both routes give the same, exact result.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import melt
from ..session import largest_group, materialize, max_task_rows, shuffle_partitions
from .skew import join_to_keys

SKETCH_ACCURACY = 10_000
EXPRESSIONS_PER_JOB = 240
MANY_RANKS = 64


# ---------------------------------------------------------------- ranks and quantiles
@dataclass
class _Bracket:
    """Open interval (lo, hi) strictly between which the ``rank``-th value (0-based) lies."""

    column: str
    rank: int
    lo: object
    hi: object
    below: int = 0  # rows at or before lo
    inside: int = 0
    value: object = None


def _batched(items: Sequence, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


def _inside(b: _Bracket) -> Column:
    return (F.col(b.column) > F.lit(b.lo)) & (F.col(b.column) < F.lit(b.hi))


def _settle(df: DataFrame, brackets: list[_Bracket], bounds: list[tuple]) -> None:
    """Count around the proposed (lo, hi) of each bracket and either find the value on a
    bound or keep the open stretch that holds the rank.  A bound is never looked at again,
    so even a value that fills a third of the table is settled in one pass."""
    for batch in _batched(list(zip(brackets, bounds)), EXPRESSIONS_PER_JOB // 4):
        aggs = []
        for i, (b, (lo, hi)) in enumerate(batch):
            c = F.col(b.column)
            aggs += [F.count_if(c < F.lit(lo)).alias(f"a{i}"), F.count_if(c <= F.lit(lo)).alias(f"b{i}"),
                     F.count_if(c < F.lit(hi)).alias(f"c{i}"), F.count_if(c <= F.lit(hi)).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        for i, (b, (lo, hi)) in enumerate(batch):
            under_lo, upto_lo, under_hi, upto_hi = (row[f"{p}{i}"] for p in "abcd")
            end = b.below + b.inside
            if b.rank < under_lo:
                b.hi, b.inside = lo, under_lo - b.below
            elif b.rank < upto_lo:
                b.value = lo
            elif b.rank < under_hi:
                b.lo, b.hi, b.below, b.inside = lo, hi, upto_lo, under_hi - upto_lo
            elif b.rank < upto_hi:
                b.value = hi
            else:
                b.lo, b.below, b.inside = hi, upto_hi, end - upto_hi


def _tighten(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Propose narrower bounds around each rank from a bounded quantile sketch."""
    bounds = []
    for batch in _batched(brackets, EXPRESSIONS_PER_JOB // 4):
        aggs = []
        for i, b in enumerate(batch):
            centre = (b.rank - b.below + 0.5) / b.inside
            slack = 2.0 / SKETCH_ACCURACY
            probs = [max(0.0, centre - slack), min(1.0, centre + slack)]
            aggs.append(F.percentile_approx(F.when(_inside(b), F.col(b.column)), probs, SKETCH_ACCURACY).alias(f"q{i}"))
        row = df.agg(*aggs).first()
        bounds += [tuple(row[f"q{i}"]) for i in range(len(batch))]
    _settle(df, brackets, bounds)


def _pick(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Finish brackets holding few rows: count distinct values inside and walk them."""
    for batch in _batched(brackets, EXPRESSIONS_PER_JOB // 4):
        tagged = df.select(
            F.explode(
                F.array_compact(
                    F.array(
                        *[
                            F.when(_inside(b), F.struct(F.lit(i).alias("bid"), F.col(b.column).alias("v")))
                            for i, b in enumerate(batch)
                        ]
                    )
                )
            ).alias("s")
        ).select("s.bid", "s.v")
        counts = tagged.groupBy("bid", "v").count()
        w = Window.partitionBy("bid").orderBy("v")
        walked = counts.withColumn("upto", F.sum("count").over(w))
        wanted = F.create_map(*[x for i, b in enumerate(batch) for x in (F.lit(i), F.lit(b.rank - b.below))])
        hit = walked.filter(
            (F.col("upto") > wanted[F.col("bid")]) & (F.col("upto") - F.col("count") <= wanted[F.col("bid")])
        )
        for row in hit.collect():  # at most one row per bracket
            batch[row["bid"]].value = row["v"]


def _walk(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, object]:
    """Many ranks of one column at once: one ordered pass over its value counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    wanted = F.array(*[F.lit(int(r)).cast("bigint") for r in sorted(set(ranks))])
    before = F.col("upto") - F.col("n")
    hit = F.filter(wanted, lambda r: (r < F.col("upto")) & (r >= before))
    rows = running_totals(counts, [], [column], {"upto": "n"}).select(column, hit.alias("hit")).filter(F.size("hit") > 0)
    return {r: row[column] for row in rows.collect() for r in row["hit"]}  # at most one row per rank


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]]) -> dict[str, dict[int, object]]:
    """Exact ``rank``-th smallest non-null value (0-based) of each column, any orderable type
    the sketch accepts (numbers, dates, timestamps).  Ranks past the end are left out."""
    limit = max_task_rows(df.sparkSession)
    cols = [c for c, ranks in wanted.items() if ranks]
    if not cols:
        return {}
    df = df.select(*cols)
    many = {c: wanted[c] for c in cols if len(set(wanted[c])) > MANY_RANKS}
    if many:
        out = {c: _walk(df, c, ranks) for c, ranks in many.items()}
        return {**out, **order_statistics(df, {c: wanted[c] for c in cols if c not in many})}
    ends = df.agg(
        *[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    brackets = [
        _Bracket(c, r, ends[f"lo{i}"], ends[f"hi{i}"], 0, ends[f"n{i}"])
        for i, c in enumerate(cols)
        for r in sorted(set(wanted[c]))
        if 0 <= r < ends[f"n{i}"]
    ]
    _settle(df, brackets, [(b.lo, b.hi) for b in brackets])
    while open_ := [b for b in brackets if b.value is None]:
        large = [b for b in open_ if b.inside > limit]
        _pick(df, [b for b in open_ if b.inside <= limit])
        if large:
            _tighten(df, large)
    out: dict[str, dict[int, object]] = {c: {} for c in cols}
    for b in brackets:
        out[b.column][b.rank] = b.value
    return out


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of the non-null values of each column."""
    spark, columns, probs = df.sparkSession, list(columns), [float(p) for p in probs]
    if not columns:
        return {}
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: sizes[f"n{i}"] for i, c in enumerate(columns)}
    limit = max_task_rows(spark)
    # the built-in aggregate buffers the distinct values of a group, and each column is its
    # own group of at most ``limit`` values, so the buffers spread over the reduce tasks
    small = [c for c in columns if 0 < sizes[c] <= limit]
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if small:
        long = melt(df, small).filter(F.col("value").isNotNull())
        for row in long.groupBy("feature").agg(F.percentile("value", F.lit(probs)).alias("q")).collect():
            found[row["feature"]] = list(row["q"])
    large = {c: sizes[c] for c in columns if sizes[c] > limit}
    wanted = {}
    for c, n in large.items():
        positions = [p * (n - 1) for p in probs]
        wanted[c] = sorted({int(f(x)) for x in positions for f in (math.floor, math.ceil)})
    stats = order_statistics(df, wanted)
    for c, n in large.items():
        found[c] = []
        for p in probs:
            x = p * (n - 1)
            lo, hi = float(stats[c][math.floor(x)]), float(stats[c][math.ceil(x)])
            found[c].append(lo + (hi - lo) * (x - math.floor(x)))
    return {c: found[c] for c in columns}


# ---------------------------------------------------------------- cuts by rank
@dataclass(frozen=True)
class Cut:
    """The first ``size`` rows in an order are those for which ``before(cut)`` is true."""

    columns: tuple[str, ...]
    values: tuple
    size: int

    def condition(self) -> Column:
        if self.size <= 0:
            return F.lit(False)
        test = F.lit(False)
        tied = F.lit(True)
        for i, (c, v) in enumerate(zip(self.columns, self.values)):
            last = i == len(self.values) - 1
            test = test | (tied & (F.col(c) <= F.lit(v) if last else F.col(c) < F.lit(v)))
            tied = tied & (F.col(c) == F.lit(v))
        return test


def cut_at(df: DataFrame, order: Sequence[str], sizes: Sequence[int]) -> list[Cut]:
    """Boundaries that split ``df`` after its first ``size`` rows in ascending ``order``.

    Later columns only break ties of earlier ones, so a hot value costs one more pass
    over its ties rather than a sort of everything.
    """
    order = list(order)
    head = order[0]
    real = sorted({s for s in sizes if s > 0})
    if not real:
        return [Cut(tuple(order), (), s) for s in sizes]
    found = order_statistics(df, {head: [s - 1 for s in real]})[head]
    values = sorted({v for v in found.values() if v is not None})
    counts: dict = {}
    for batch in _batched(values, EXPRESSIONS_PER_JOB // 2):
        aggs = []
        for i, v in enumerate(batch):
            aggs += [F.count_if(F.col(head) < F.lit(v)).alias(f"b{i}"), F.count_if(F.col(head) == F.lit(v)).alias(f"e{i}")]
        row = df.agg(*aggs).first()
        counts.update({v: (row[f"b{i}"], row[f"e{i}"]) for i, v in enumerate(batch)})
    cuts: dict[int, Cut] = {}
    for s in real:
        v = found.get(s - 1)
        if v is None:  # more rows asked for than exist: everything is in front of the cut
            cuts[s] = Cut((head,), (df.agg(F.max(head)).first()[0],), s)
            continue
        below, ties = counts[v]
        if s == below + ties or len(order) == 1:
            cuts[s] = Cut((head,), (v,), s)
        else:
            inner = cut_at(df.filter(F.col(head) == F.lit(v)), order[1:], [s - below])[0]
            cuts[s] = Cut((head, *inner.columns), (v, *inner.values), s)
    return [cuts.get(s, Cut(tuple(order), (), s)) for s in sizes]


def bucket_by_cuts(cuts: Sequence[Cut]) -> Column:
    """Index of the first cut a row falls in front of; ``len(cuts)`` behind the last one."""
    expr = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        expr = F.when(cuts[i].condition(), F.lit(i)).otherwise(expr)
    return expr


def cuts_by_group(df: DataFrame, group: str, order: Sequence[str], sizes: Sequence, least_buckets: int = 1024) -> DataFrame:
    """Boundaries of every group at once: `_group` and `_cut0`, `_cut1`, …, the last order tuple among the
    group's first ``size(n)`` rows (null when that is no row, the group's last one when it has fewer).

    The first order column is a hash in [0, 1).  Rows are counted per group and hash bucket, with
    partial sums before the shuffle; only buckets that hold a boundary are looked into, where equal
    tuples are counted together.  Buckets are as many as keep both windows below the task limit.
    """
    head, limit = order[0], max_task_rows(df.sparkSession)
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(least_buckets, -(-4 * largest // limit))
    rows = df.select(F.col(group).alias("_group"), *order, F.floor(F.col(head) * buckets).alias("_bucket"))
    counted = rows.groupBy("_group", "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_bucket"))
    n = F.sum("_n").over(Window.partitionBy("_group"))
    sized = counted.withColumns({"_below": upto - F.col("_n"), "_all": n})
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("_cut"), F.least(size(F.col("_all")), F.col("_all")).alias("_size")) for i, size in enumerate(sizes)]))
    sought = materialize(
        sized.withColumn("_w", wanted).select("_group", "_bucket", "_below", "_n", "_all", "_w.*")
        .where((F.col("_size") > F.col("_below")) & (F.col("_size") <= F.col("_below") + F.col("_n")))
        .select("_group", "_bucket", "_cut", (F.col("_size") - F.col("_below")).alias("_rest")),
        "sought",
    )
    same = lambda a, b: a["_group"].eqNullSafe(b["_group"]) & (a["_bucket"] == b["_bucket"])
    near = rows.join(sought.select("_group", "_bucket").distinct(), same(rows, sought), "left_semi")
    tuples = near.groupBy("_group", "_bucket", *order).agg(F.count("*").alias("_n"))
    tuples = tuples.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_group", "_bucket").orderBy(*order)))
    at = tuples.join(sought, same(tuples, sought)).where((F.col("_rest") <= F.col("_upto")) & (F.col("_rest") > F.col("_upto") - F.col("_n")))
    found = at.select(tuples["_group"], "_cut", F.struct(*order).alias("_at"))
    return found.groupBy("_group").agg(*[F.max(F.when(F.col("_cut") == i, F.col("_at"))).alias(f"_cut{i}") for i in range(len(sizes))])


# ---------------------------------------------------------------- global positions
def with_position(df: DataFrame, order: Sequence[str], name: str = "_pos") -> DataFrame:
    """Add the 0-based global position in ``order`` (which should be total).

    One range shuffle sorts the table; it is written once to the shared folder so the
    per-partition offsets and the rows come from the same evaluation.
    """
    parts = shuffle_partitions(df.sparkSession)
    ids = F.monotonically_increasing_id()
    stored = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", ids)
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid"),
        "sorted",
    )
    # one row per sort partition, hence bounded by spark.sql.shuffle.partitions
    sizes = stored.groupBy("_part").count()
    offsets = sizes.select(
        "_part",
        (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"),
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.col("_row"))
        .drop("_part", "_row", "_base")
    )


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str], is_stored: bool = False
) -> DataFrame:
    """Inclusive running sums of ``sums[name]`` per group in ``order``.

    Give it a table already aggregated to one row per (group, order) value; it is written
    once so that sizing and summing do not repeat the aggregation.
    """
    group, order = list(group), list(order)
    if not is_stored:
        df = materialize(df, "totals")
    limit = max_task_rows(df.sparkSession)
    if largest_group(df, group) <= limit:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(src).over(w) for out, src in sums.items()})
    placed = with_position(df, group + order).withColumn("_chunk", F.expr(f"_pos div {limit}"))
    totals = placed.groupBy(*group, "_chunk").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_c_{out}") for out in sums],
    )
    within = Window.partitionBy("_chunk", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(carried, [*group, "_chunk"])
    return joined.withColumns(
        {out: F.sum(src).over(within) + F.col(f"_c_{out}") for out, src in sums.items()}
    ).drop("_pos", "_chunk", *[f"_c_{out}" for out in sums])


def grouped_quantile(counted: DataFrame, group: Sequence[str], value: str, n: str, p: float) -> DataFrame:
    """Interpolated quantile per group of a stored value-count table (one row per group and value)."""
    group = list(group)
    walked = running_totals(counted.select(*group, value, n), group, [value], {"_upto": n}, is_stored=True)
    totals = counted.groupBy(*group).agg(F.sum(n).alias("total"), F.count("*").alias("_rows"))
    x = (F.col("total") - 1) * F.lit(float(p))
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col(n) <= rank)
    picked = (
        join_to_keys(walked, totals, group, "_rows")
        .groupBy(*group)
        .agg(
            F.max("total").alias("total"),
            F.count("*").alias("n_values"),
            F.max(F.when(holds(F.floor(x)), F.col(value))).alias("_lo"),
            F.max(F.when(holds(F.ceil(x)), F.col(value))).alias("_hi"),
        )
    )
    return picked.select(*group, "total", "n_values", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (x - F.floor(x))).alias("quantile"))


def over_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    build: Callable[[object], dict[str, Column]],
) -> DataFrame:
    """Window expressions that look at most ``lookback`` rows back within each key.

    ``build`` receives an ordered window spec and returns the new columns.  When a key is
    too large for one task, rows are numbered globally, cut into chunks, and the last
    ``lookback`` rows of each chunk are repeated in front of the next one.
    """
    keys, order = list(keys), list(order)
    limit = max(max_task_rows(df.sparkSession), lookback + 1)
    if largest_group(df, keys) <= limit:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*order)))
    placed = with_position(df, keys + order)
    chunk = F.expr(f"_pos div {limit}")
    tail = F.col("_pos") % limit >= limit - lookback
    copies = F.when(
        tail,
        F.array(
            F.struct(chunk.alias("c"), F.lit(False).alias("h")),
            F.struct((chunk + 1).alias("c"), F.lit(True).alias("h")),
        ),
    ).otherwise(F.array(F.struct(chunk.alias("c"), F.lit(False).alias("h"))))
    spread = placed.withColumn("_copy", F.explode(copies)).select("*", "_copy.c", "_copy.h").drop("_copy")
    spec = Window.partitionBy("c", *keys).orderBy("_pos")
    return spread.withColumns(build(spec)).filter(~F.col("h")).drop("_pos", "c", "h")


# ---------------------------------------------------------------- repeatable sampling
def hash_uniform(*parts: Column | str, seed: int = 42) -> Column:
    """32-bit integer from md5 of ``seed:part:part…``: the same on every engine and partition."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest key hash: a reproducible random sample.

    A hash threshold sized from the row count leaves little more than ``n`` rows for the
    final top-n, so no task or merge sees the whole table.
    """
    hashed = df.withColumn("_h", hash_uniform(key, seed=seed))
    total = df.count()
    if total > 4 * n + 1000:
        share = (n + 12 * math.sqrt(n) + 64) / total
        trimmed = hashed.filter(F.col("_h") < F.lit(int(share * (1 << 32))))
        if trimmed.count() >= n:
            hashed = trimmed
    return hashed.orderBy("_h", key).limit(n).drop("_h")
