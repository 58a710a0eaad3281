"""Ordered scans that do not need a whole key in one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..sources.tables import durable

BLOCK = "_block"
MULTI = "_multi_block"


def page_blocks(block=None) -> Column:
    """``block`` if it is given, otherwise blocks of ``PAGES_PER_BLOCK`` pages."""
    return blocks_of("page", config.PAGES_PER_BLOCK) if block is None else block


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """Filter that stays above the projections it reads.

    A plain filter is pushed down with its columns written out in full, so a condition on the
    last of several dependent columns would compute all of them many times over.
    """
    rows = F.when(condition, F.array(F.struct(*df.columns)))
    return df.select(F.inline_outer(rows)).filter(F.col(df.columns[0]).isNotNull())


def blocks_of(column: str, size: int) -> Column:
    """Block number ``column / size``; the same plan serves short and long keys."""
    return F.floor(F.col(column) / size)


def long_keys(df: DataFrame, block: Column, keys=("document_id",)) -> DataFrame:
    """Keys with rows behind block 0, written once; usually none.

    Steps that hand something from block to block work on these keys alone: joined with the
    stored table, whose size is known, an ordinary plan runs nothing for them.
    """
    return durable(df.filter(block > 0).select(*keys).distinct(), "long-keys")


def running(df: DataFrame, keys, order, block: Column, sums=None, lasts=None, long=None) -> DataFrame:
    """Per key, in ``order``: inclusive running sums and last non-NULL values.

    ``sums`` and ``lasts`` map output names to input columns. ``block`` is a column that never
    falls along ``order``. Rows are windowed per (key, block); what earlier blocks hand on is
    summed up in one row per block, and only keys with more than one block need that second
    step; ``long`` (see ``long_keys``) names them beforehand. The result is partitioned by
    (keys, block) and keeps the columns ``BLOCK`` and ``MULTI`` (whether the key has several
    blocks), so callers can go on without a shuffle.
    """
    keys, order = list(keys), list(order)
    sums, lasts = sums or {}, lasts or {}
    df = df.withColumn(BLOCK, block)

    totals = [F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()] + [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_last_{name}")
        for name, c in lasts.items()
    ]
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    handed_on = (
        (df if long is None else df.join(long, keys, "left_semi")).groupBy(*keys, BLOCK)
        .agg(*totals)
        .withColumns(
            {
                MULTI: F.min(BLOCK).over(per_key) < F.max(BLOCK).over(per_key),
                **{f"_sum_{n}": F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)) for n in sums},
                **{f"_last_{n}": F.last(f"_last_{n}", ignorenulls=True).over(before) for n in lasts},
            }
        )
        .filter(MULTI)
    )

    upto = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumns(
        {
            **{f"_l_{n}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()},
            **{f"_l_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()},
        }
    )
    joined = local.join(handed_on, [*keys, BLOCK], "left")
    added = {n: F.col(f"_l_{n}") + F.coalesce(f"_sum_{n}", F.lit(0)) for n in sums}
    added.update({n: F.coalesce(f"_l_{n}", f"_last_{n}") for n in lasts})
    added[MULTI] = F.coalesce(MULTI, F.lit(False))
    drop = [f"_l_{n}" for n in [*sums, *lasts]]
    drop += [f"_sum_{n}" for n in sums] + [f"_last_{n}" for n in lasts]
    return joined.withColumns(added).drop(*drop)


def numbered(df: DataFrame, keys, order, block: Column, out="sequence") -> DataFrame:
    """Dense numbers from 0 per key."""
    counted = running(df.withColumn("_one", F.lit(1)), keys, order, block, sums={out: "_one"})
    return counted.withColumn(out, (F.col(out) - 1).cast("int")).drop("_one", BLOCK, MULTI)


def top_per_group(df: DataFrame, keys, order, limit, rank="_rank") -> DataFrame:
    """The first ``limit`` rows of each group; each task cuts its own rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)
    return top if rank != "_rank" else top.drop(rank)
