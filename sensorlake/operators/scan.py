"""Scans along files of any length in two levels: rows are dealt by blocks of a file, and small tables of a row per block
carry over what a block has to know of those before it.

A block is a range of offsets. What it needs comes as a *halo row* put before its rows: windows over (file, block) then
see it like any other row, so rows are shuffled and sorted once, by block, and need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Offsets of a block: bytes of a raw file, which hold 4 million frames at most.
BLOCK = 32 * 1024 * 1024
SO_FAR = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def with_blocks(rows: DataFrame, span: int) -> DataFrame:
    return rows.withColumn("__block", F.floor(F.col("offset") / span))


def within(keys: tuple[str, ...]) -> WindowSpec:
    """Rows of a block in order, its halo row first."""
    return Window.partitionBy(*keys, "__block").orderBy("__row", "offset")


def blocks_before(keys: tuple[str, ...]) -> WindowSpec:
    """A block's summary and those of the blocks before it; one row per block."""
    return Window.partitionBy(*keys).orderBy("__block").rowsBetween(*BEFORE)


def with_halo(rows: DataFrame, halo: DataFrame) -> DataFrame:
    """``rows`` (with __block) and a halo row per row of ``halo``; columns that either lacks are null there."""
    return rows.withColumn("__row", F.lit(1)).unionByName(halo.withColumn("__row", F.lit(0)), allowMissingColumns=True)


def carried(name: str, keys: tuple[str, ...]) -> Column:
    """What the halo row says in a column of its own, for all rows of the block."""
    return F.first(name, ignorenulls=True).over(within(keys).rowsBetween(*SO_FAR))


def plain_rows(rows: DataFrame, *spare: str) -> DataFrame:
    return rows.where("__row = 1").drop("__row", "__block", *spare)


def last_before(blocked: DataFrame, columns: list[str], keys: tuple[str, ...], of: Column | None = None) -> DataFrame:
    """Per block the ``columns`` of the last row of earlier blocks (of those rows that ``of`` admits); no row where there
    is none."""
    at = F.col("offset") if of is None else F.when(of, F.col("offset"))
    last = blocked.groupBy(*keys, "__block").agg(F.max_by(F.struct(*columns), at).alias("__last"))
    before = last.select(*keys, "__block", F.last("__last", ignorenulls=True).over(blocks_before(keys)).alias("__before"))
    return before.where("__before IS NOT NULL").select(*keys, "__block", "__before.*")


def with_previous(rows: DataFrame, columns: list[str], keys: tuple[str, ...], span: int) -> DataFrame:
    """``rows`` by blocks, each behind a copy of the row before it (its ``columns``, of the others the keys): ``lag`` over
    ``within(keys)`` then gives what it gives over the whole file."""
    blocked = with_blocks(rows, span)
    return with_halo(blocked, last_before(blocked, columns, keys))


def numbered(rows: DataFrame, keys: tuple[str, ...], span: int, more: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``__nth`` (from 1), ``__all`` (the number of rows) and, for each of ``more``, an aggregate over all rows
    of their keys whose parts can be combined by ``min``."""
    blocked = with_blocks(rows, span)
    summary = blocked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in (more or {}).items()])
    whole = Window.partitionBy(*keys)
    halo = summary.select(*keys, "__block", F.coalesce(F.sum("__n").over(blocks_before(keys)), F.lit(0)).alias("__skipped"), F.sum("__n").over(whole).alias("__total"), *[F.min(n).over(whole).alias(n) for n in more or {}])
    x = with_halo(blocked, halo)
    nth = F.sum("__row").over(within(keys).rowsBetween(*SO_FAR)) + carried("__skipped", keys)
    x = x.withColumns({"__nth": nth, "__all": carried("__total", keys), **{n: carried(n, keys) for n in more or {}}})
    return plain_rows(x, "__skipped", "__total")
