"""Plan shapes that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def chunked_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums, previous values and last non-null values per key.

    The window runs inside (key, chunk); one summary row per chunk carries the
    totals of the chunks before it. No task sorts a whole key. ``chunk`` must not
    decrease along the order. The rows are read twice (once for the summaries):
    hand in a scan or a written table, not a long plan.

    sums   name -> expression: inclusive running sum
    lags   name -> expression: value of the row before
    lasts  name -> expression: last non-null value up to and including the row
    """
    sums, lags, lasts = sums or {}, lags or {}, lasts or {}
    values = {f"_v_{n}": e for n, e in {**sums, **lags, **lasts}.items()}
    rows = df.withColumn("_chunk", chunk).withColumns(values)
    by = [*keys, "_chunk"]
    position = F.struct(*order)

    totals = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    # max over (position, value) keeps the value of the last row, null included
    totals += [F.max(F.struct(position, f"_v_{n}"))[f"_v_{n}"].alias(f"_t_{n}") for n in lags]
    totals += [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
               for n in lasts]
    along = Window.partitionBy(*keys).orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by).agg(*totals).select(
        *by,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.lag(f"_t_{n}").over(along).alias(f"_c_{n}") for n in lags],
        *[F.last(f"_t_{n}", True).over(before).alias(f"_c_{n}") for n in lasts],
    )

    inside = Window.partitionBy(*by).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}
    local |= {f"_l_{n}": F.lag(f"_v_{n}").over(inside) for n in lags}
    local |= {f"_l_{n}": F.last(f"_v_{n}", True).over(upto) for n in lasts}
    local["_first"] = F.row_number().over(inside) == 1

    on = F.lit(True)
    left, right = rows.withColumns(local).alias("l"), carried.alias("r")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = {}
    for n in sums:
        out[n] = F.coalesce(F.col(f"r._c_{n}"), F.lit(0)) + F.coalesce(F.col(f"l._l_{n}"), F.lit(0))
    for n in lags:
        out[n] = F.when(F.col("l._first"), F.col(f"r._c_{n}")).otherwise(F.col(f"l._l_{n}"))
    for n in lasts:
        out[n] = F.coalesce(F.col(f"l._l_{n}"), F.col(f"r._c_{n}"))
    kept = [F.col(f"l.{c}") for c in df.columns if c not in out]
    return left.join(right, on).select(*kept, *[e.alias(n) for n, e in out.items()])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row of every key by a partial aggregate."""
    place = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*place))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)
