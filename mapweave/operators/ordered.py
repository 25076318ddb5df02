"""Order along a key: neighbours, running values, positions, ranks and gap filling.

A key needs one plain window, and a chain of windows over the same key costs one shuffle and one sort in total. Keys too
large for one task are cut into ordered pieces, each key by its own count: windows run inside a piece, and what crosses a
border comes from one summary row per piece. All other keys stay on the plain way, whatever the largest one holds.
``hot_keys`` finds such keys in one counting job; every function takes its result as ``block``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.session import cut_lineage

TASK_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], limit: int = TASK_ROWS) -> DataFrame | None:
    """``keys`` and the number of pieces ``_pieces`` of every key of more than ``limit`` rows; None where there is none."""
    counts = df.groupBy(*keys).count().where(F.col("count") > limit)
    hot = counts.select(*keys, (2 * F.ceil(F.col("count") / limit)).cast("int").alias("_pieces"))
    return None if hot.isEmpty() else cut_lineage(hot)


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Number of rows, and that of the key with most of them, in one job."""
    total, most = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return total or 0, most or 0


def spread(df: DataFrame, keys: list[str], rows: int = TASK_ROWS // 2, total: int | None = None) -> DataFrame:
    """Rows dealt out by key to as many partitions as their number (``total``, if known) asks for, so that no window holds
    more as tables grow.

    Windows over the same keys need no shuffle of their own afterwards.
    """
    wanted = -(-(df.count() if total is None else total) // rows)
    # Up to one partition a core the shuffle's own count does; beyond, adaptive coalescing would fill tasks by compressed size.
    return df.repartition(wanted, *keys) if wanted > df.sparkSession.sparkContext.defaultParallelism else df


def _blocked(df: DataFrame, keys: list[str], order: str, hot: DataFrame) -> DataFrame:
    """Rows of hot keys with their piece ``_blk``, cut at approximate quantiles of the order.

    The cuts only spread the work; results do not depend on their accuracy. Written once, as the windows and the
    summaries both read it.
    """
    rows = df.join(hot, [k for k in keys if k in hot.columns])
    most = hot.agg(F.max("_pieces")).first()[0]
    shares = F.array(*[F.lit(i / most) for i in range(1, most)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(order, shares, F.lit(max(1_000, 10 * most))).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return cut_lineage(rows.join(cuts, keys).withColumn("_blk", below).drop("_cuts", "_pieces"))


def _split(df: DataFrame, keys: list[str], order: str, hot: DataFrame | None, plain: Callable, pieces: Callable) -> DataFrame:
    """``plain`` on the rows of ordinary keys, ``pieces`` on those of hot keys."""
    if hot is None:
        return plain(df)
    usual = plain(df.join(hot, [k for k in keys if k in hot.columns], "left_anti"))
    return usual.unionByName(pieces(_blocked(df, keys, order, hot)).select(*usual.columns))


def neighbors(df: DataFrame, keys: list[str], order: str, columns: list[str], before: str | None = None,
              after: str | None = None, block: DataFrame | None = None) -> DataFrame:
    """Attach the previous and next row of the same key as structs of ``columns``.

    ``order`` is a number, unique within a key; it may have gaps.
    """
    row = F.struct(*[F.col(c) for c in columns])

    def around(window) -> dict[str, Column]:
        added = {}
        if before:
            added[before] = F.lag(row).over(window)
        if after:
            added[after] = F.lead(row).over(window)
        return added

    def pieces(rows: DataFrame) -> DataFrame:
        cells = [*keys, "_blk"]
        across = Window.partitionBy(*keys).orderBy("_blk")
        edge = rows.groupBy(*cells).agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last")).select(
            *cells, F.lag("_last").over(across).alias("_enter"), F.lead("_first").over(across).alias("_leave")
        )
        joined = rows.withColumns(around(Window.partitionBy(*cells).orderBy(order))).join(edge, cells)
        if before:
            joined = joined.withColumn(before, F.coalesce(before, "_enter"))
        if after:
            joined = joined.withColumn(after, F.coalesce(after, "_leave"))
        return joined.drop("_blk", "_enter", "_leave")

    return _split(df, keys, order, block, lambda rows: rows.withColumns(around(Window.partitionBy(*keys).orderBy(order))), pieces)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, total: str | None = None,
                block: DataFrame | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within a key and, if asked, the key's total."""
    upto = (Window.unboundedPreceding, 0)

    def plain(rows: DataFrame) -> DataFrame:
        result = rows.withColumn(name, F.sum("_v").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*upto)))
        if total:
            # The full frame keeps the same order, so no second sort is needed.
            whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing
            )
            result = result.withColumn(total, F.sum("_v").over(whole))
        return result.drop("_v")

    def pieces(rows: DataFrame) -> DataFrame:
        cells = [*keys, "_blk"]
        earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*cells).agg(F.sum("_v").alias("_s"))
        offsets = sums.withColumn("_base", F.sum("_s").over(earlier))
        if total:
            offsets = offsets.withColumn(total, F.sum("_s").over(Window.partitionBy(*keys)))
        inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(*upto)
        joined = rows.withColumn(name, F.sum("_v").over(inside)).join(offsets.drop("_s"), cells)
        return joined.withColumn(name, F.col(name) + F.coalesce(F.col("_base"), F.lit(0))).drop("_blk", "_v", "_base")

    return _split(df.withColumn("_v", value), keys, order, block, plain, pieces)


def position(df: DataFrame, keys: list[str], order: str, name: str = "pos", total: str | None = None,
             block: DataFrame | None = None) -> DataFrame:
    """Dense position from 0 within a key and, if asked, the number of rows of the key."""
    return running_sum(df, keys, order, F.lit(1), "_n", total, block).withColumn(name, F.col("_n") - 1).drop("_n")


def last_known(df: DataFrame, keys: list[str], order: str, value: str, name: str,
               block: DataFrame | None = None) -> DataFrame:
    """Value of this row or the nearest earlier row of the key that has one."""
    upto = (Window.unboundedPreceding, 0)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.last(value, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*upto)))

    def pieces(rows: DataFrame) -> DataFrame:
        cells = [*keys, "_blk"]
        inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(*upto)
        earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*cells).agg(
            F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")
        ).select(*cells, F.last("_end", True).over(earlier).alias("_carry"))
        return rows.withColumn(name, F.last(value, True).over(inside)).join(ends, cells).withColumn(
            name, F.coalesce(name, "_carry")
        ).drop("_blk", "_carry")

    return _split(df, keys, order, block, plain, pieces)


def running_min(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: DataFrame | None = None) -> DataFrame:
    """Least ``value`` of the earlier rows of the key, this row excluded."""
    before = (Window.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.min(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)))

    def pieces(rows: DataFrame) -> DataFrame:
        cells = [*keys, "_blk"]
        ends = rows.groupBy(*cells).agg(F.min(value).alias("_low")).select(
            *cells, F.min("_low").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*before)).alias("_carry")
        )
        inside = Window.partitionBy(*cells).orderBy(order).rowsBetween(*before)
        # ``least`` skips nulls, which is what the first row of a piece needs.
        return rows.withColumn(name, F.min(value).over(inside)).join(ends, cells).withColumn(
            name, F.least(name, "_carry")
        ).drop("_blk", "_carry")

    return _split(df, keys, order, block, plain, pieces)


def place(df: DataFrame, keys: list[str], value: str, tie: str | None, name: str, block: DataFrame | None = None) -> DataFrame:
    """Place of each row by descending ``value``: shared among equals, or told apart by ``tie``."""
    order = [F.col(value).desc()] + ([F.col(tie)] if tie else [])
    number = F.row_number() if tie else F.rank()

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, number.over(Window.partitionBy(*keys).orderBy(*order)))

    def pieces(rows: DataFrame) -> DataFrame:
        cells = [*keys, "_blk"]
        above = Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(*cells).count().select(*cells, F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_ahead"))
        return rows.withColumn(name, number.over(Window.partitionBy(*cells).orderBy(*order))).join(counts, cells).withColumn(
            name, F.col(name) + F.col("_ahead")
        ).drop("_blk", "_ahead")

    return _split(df, keys, value, block, plain, pieces)
