"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.plans.storage import stored


def placed(rows: DataFrame, by: tuple[str, ...], scope: tuple[str, ...] = (), name: str = "ord") -> DataFrame:
    """``rows`` with their place (from 0) by ``by`` within ``scope``. Rows are sorted by ranges and stored; then each run of
    a scope in a part starts after the runs of that scope in the parts before. Only the runs, at most one for each part and
    scope, meet in windows. Rows that tie in ``by`` follow each other in any order."""
    at, part, first, before, n, *run = _free(rows.columns, ["_at", "_part", "_first", "_before", "_n", "_run", *(f"_run_{c}" for c in scope)])
    kept = stored(rows.repartitionByRange(*scope, *by).sortWithinPartitions(*scope, *by).withColumn(at, F.monotonically_increasing_id()), "order")
    kept = kept.withColumn(part, F.shiftright(at, 33))
    runs = kept.groupBy(part, *scope).agg(F.min(at).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*scope).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))), "runs")
    runs = runs.select(*[F.col(c).alias(r) for c, r in zip((part, *scope), run, strict=True)], first, before)
    same = F.lit(True)
    for c, r in zip((part, *scope), run, strict=True):
        same &= F.col(c).eqNullSafe(F.col(r))
    met = kept.join(runs, same)
    return met.select(*rows.columns, (F.col(before) + F.col(at) - F.col(first)).alias(name))


def _free(columns: list[str], names: list[str]) -> list[str]:
    """``names``, with underscores before each until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def pages(ordered: DataFrame, by: tuple[str, ...], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows of a table by the columns ``by`` (the last of them unique, none null), behind the row whose
    values a caller saw last: a keyset cursor. The bound on the first column goes to the scan, so that files of a table
    written in that order are skipped; each task hands on ``size`` rows at most."""
    rows = ordered
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for column, value in zip(by, after, strict=True):
            behind |= same & (F.col(column) > F.lit(value))
            same &= F.col(column) == F.lit(value)
        rows = rows.where((F.col(by[0]) >= F.lit(after[0])) & behind)
    return rows.orderBy(*by).limit(size)
