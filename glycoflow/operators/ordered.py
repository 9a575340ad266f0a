"""Ordered operators that never need all rows of one key in a single task.

Windows run over (key, time block). What a block has to know about earlier blocks
is one row per block, found by a partial aggregate, so a key holding a large share
of the table is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: Column,
    right_ts: str,
    payload: list[str],
    tie: str,
    direction: str = "backward",
    strict: bool = False,
    block_minutes: int = 60,
) -> DataFrame:
    """Add to each left row the nearest right row at or before it ("backward") or after it.

    `payload` columns come back under their own names, NULL where there is no match.
    Right rows at one instant are settled by `tie`: the greatest looking backward, the
    smallest looking forward. `strict` leaves out right rows at the very instant.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    backward = direction == "backward"
    sign = 1 if backward else -1
    width = block_minutes * 60_000

    def block_of(pos: Column) -> Column:
        return F.floor(pos / F.lit(width))

    pick = F.max_by if backward else F.min_by
    hits = (
        right.filter(F.col(right_ts).isNotNull())
        .select(
            *by,
            (F.unix_millis(right_ts) * sign).alias("_pos"),
            F.col(tie).alias("_tie"),
            F.struct(*payload).alias("_hit"),
        )
        .groupBy(*by, "_pos")
        .agg(pick("_hit", "_tie").alias("_hit"))
        .withColumn("_block", block_of(F.col("_pos")))
    )
    # The search is for instants, so left rows at one instant are one row in it.
    placed = left.withColumn("_at", F.unix_millis(left_ts) * sign)
    packed = (
        placed.filter(F.col("_at").isNotNull())
        .select(*by, F.col("_at").alias("_pos"))
        .distinct()
        .withColumn("_left", F.lit(True))
        .withColumn("_block", block_of(F.col("_pos")))
    )

    tails = (
        hits.select(*by, "_block", "_pos", "_hit", F.lit(0).alias("_wanted"))
        .unionByName(
            packed.select(*by, "_block", F.lit(1).alias("_wanted")), allowMissingColumns=True
        )
        .groupBy(*by, "_block")
        .agg(F.max_by("_hit", "_pos").alias("_tail"), F.max("_wanted").alias("_wanted"))
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        tails.withColumn("_hit", F.last("_tail", ignorenulls=True).over(earlier))
        .filter((F.col("_wanted") == 1) & F.col("_hit").isNotNull())
        .select(
            *by, "_block", (F.col("_block") * width - 1).alias("_pos"), "_hit",
            F.lit(0).alias("_rank"),
        )
    )
    left_rank, right_rank = (0, 1) if strict else (1, 0)
    merged = (
        hits.withColumn("_rank", F.lit(right_rank))
        .unionByName(carried)
        .unionByName(packed.withColumn("_rank", F.lit(left_rank)), allowMissingColumns=True)
    )
    seen = (
        Window.partitionBy(*by, "_block")
        .orderBy("_pos", "_rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = merged.withColumn("_hit", F.last("_hit", ignorenulls=True).over(seen)).filter(
        F.col("_left").isNotNull()
    )
    found = matched.select(*by, F.col("_pos").alias("_at"), "_hit")
    return placed.join(found, [*by, "_at"], "left").select(
        *[F.col(c) for c in left.columns], *[F.col("_hit").getField(c).alias(c) for c in payload]
    )


def sessions(
    events: DataFrame, by: list[str], ts: str, gap_minutes: int, aggregates: dict[str, Column]
) -> DataFrame:
    """Runs of events less than `gap_minutes` apart.

    Events inside one block as long as the gap always belong together, so the first
    step is a plain aggregate per block; only blocks, not events, are then ordered.
    `aggregates` maps a name to a column that is summed.
    """
    width = gap_minutes * 60_000
    blocks = (
        events.withColumn("_ms", F.unix_millis(ts))
        .groupBy(*by, F.floor(F.col("_ms") / F.lit(width)).alias("_block"))
        .agg(
            F.min("_ms").alias("_first"),
            F.max("_ms").alias("_last"),
            F.count(F.lit(1)).alias("n_events"),
            *[F.sum(column).alias(name) for name, column in aggregates.items()],
        )
    )
    order = Window.partitionBy(*by).orderBy("_block")
    opens = F.coalesce(
        (F.col("_first") - F.lag("_last").over(order) >= width).cast("int"), F.lit(1)
    )
    return (
        blocks.withColumn("_opens", opens)
        .withColumn("session_no", F.sum("_opens").over(order))
        .groupBy(*by, "session_no")
        .agg(
            F.timestamp_millis(F.min("_first")).alias("session_start"),
            F.timestamp_millis(F.max("_last")).alias("session_last"),
            F.sum("n_events").alias("n_events"),
            *[F.sum(name).alias(name) for name in aggregates],
        )
    )


# -- long series in blocks ---------------------------------------------------------------


def with_blocks(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their block's summary; NULL keys are keys like others."""
    renamed = summary.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [rows[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys]
    return rows.join(renamed, same).drop(*[f"_of_{k}" for k in keys])


def numbered(
    rows: DataFrame, by: list[str], order: str, width: float = 4096, sums: tuple[str, ...] = ()
) -> DataFrame:
    """Add `_at`, the place of a row in its series (from 1), and `_sum_…`, the running sums of some columns.

    Rows are numbered within cells of `width` units of `order`; counts and sums of the cells before come from one
    row per cell. A cell is as large as it has values, so `order` should not repeat much.
    """
    keys = [*by, "_cell"]
    placed = rows.withColumn("_cell", F.floor(F.col(order) / F.lit(float(width))).cast("bigint"))
    summary = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n0"), *[F.sum(c).alias(f"_sum0_{c}") for c in sums]
    )
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(
        *keys,
        F.coalesce(F.sum("_n0").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_sum0_{c}").over(earlier), F.lit(0.0)).alias(f"_sum0_{c}") for c in sums],
    )
    inner = Window.partitionBy(*keys).orderBy(order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        "*",
        F.row_number().over(inner).cast("bigint").alias("_at"),
        *[F.sum(c).over(so_far).alias(f"_sum_{c}") for c in sums],
    )
    total = {"_at": F.col("_at") + F.col("_n0")}
    total |= {f"_sum_{c}": F.col(f"_sum_{c}") + F.col(f"_sum0_{c}") for c in sums}
    return with_blocks(local, before, keys).withColumns(total).drop("_cell", "_n0", *[f"_sum0_{c}" for c in sums])


def with_halo(rows: DataFrame, by: list[str], reach: int, block: int = 4096) -> tuple[DataFrame, WindowSpec]:
    """Numbered rows in blocks, each with copies of `reach` rows of its neighbours, and the window over a block.

    Expressions that look at most `reach` rows to either side are right for the rows with `_own`.
    """
    if reach > block:
        raise ValueError("a block has to hold what its neighbours reach")
    index = F.col("_at") - 1
    home, place = F.floor(index / F.lit(block)), F.pmod(index, F.lit(block))
    homes = F.array(
        home, F.when(place < reach, home - 1), F.when(place >= block - reach, home + 1)
    )
    dealt = rows.withColumn("_home", F.explode(F.array_compact(homes))).withColumn("_own", F.col("_home") == home)
    return dealt, Window.partitionBy(*by, "_home").orderBy("_at")


def known_around(
    rows: DataFrame, by: list[str], block: str, order: list[str],
    before: tuple[str, str], after: tuple[str, str],
) -> DataFrame:
    """Add the last known value at or before each row, and the first at or after it.

    `before` and `after` name the column with the value, NULL where there is none, and the column to add. Values are
    carried within a block by a window and between blocks by one row per block.
    """
    keys = [*by, block]
    rank = F.struct(*order)
    summary = rows.groupBy(*keys).agg(
        F.max_by(before[0], F.when(F.col(before[0]).isNotNull(), rank)).alias("_last"),
        F.min_by(after[0], F.when(F.col(after[0]).isNotNull(), rank)).alias("_first"),
    )
    run = (Window.unboundedPreceding, -1)
    up = Window.partitionBy(*by).orderBy(block).rowsBetween(*run)
    down = Window.partitionBy(*by).orderBy(F.desc(block)).rowsBetween(*run)
    carried = summary.select(
        *keys,
        F.last("_last", ignorenulls=True).over(up).alias("_from_before"),
        F.last("_first", ignorenulls=True).over(down).alias("_from_after"),
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    rising = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*so_far)
    falling = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(*so_far)
    found = rows.select(
        "*",
        F.last(before[0], ignorenulls=True).over(rising).alias("_near_before"),
        F.last(after[0], ignorenulls=True).over(falling).alias("_near_after"),
    )
    return (
        with_blocks(found, carried, keys)
        .withColumn(before[1], F.coalesce("_near_before", "_from_before"))
        .withColumn(after[1], F.coalesce("_near_after", "_from_after"))
        .drop("_near_before", "_near_after", "_from_before", "_from_after")
    )
