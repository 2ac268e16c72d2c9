"""Top N rows of every group by partition lower bounds.

The N-th best row of one partition's share of a group is a lower bound for the
N-th best row of the whole group, so the greatest of these bounds still keeps
every row that can be among the first N. The plan is

1. each scan partition finds the N-th best distinct row of each of its groups,
   without a shuffle (`local_bounds`);
2. only these bounds are shuffled: the greatest one of a group counts;
3. the bounds are joined map-side, those of the groups with most rows first, so
   that rows behind them are dropped before they are shuffled. That broadcast
   holds at most `BOUNDS` rows by a limit;
4. the survivors are shuffled once and ranked. Spark's window group limit sends
   no more than N places of a group from a partition, so a group whose bound
   the limit left out is cut as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bounds that are sent to every worker. It decides only where a row is cut, never whether.
BOUNDS = 20_000
#: Rows that a partition gathers before it reduces them to its best ones.
GATHER = 200_000
#: Types whose order is the same in Arrow and in Spark. Others take no part in bounds; their groups are ranked all the same.
_ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "timestamp", "timestamp_ntz", "decimal")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int, place: str = "place", bounds: int = BOUNDS) -> DataFrame:
    """The first `n` distinct rows of every group with their places 1..n.

    df: may hold only the columns in `keys` and `order`; repeated rows count once.
    order: (column, descending) from the most to the least important; together
    they must tell rows apart, else equal rows are one row.

    Nulls in a key form a group of their own; a null in an ordering column comes
    last, NaN counts as greatest. An empty table gives an empty result; groups
    with fewer than `n` rows give what they have.
    """
    cols = [c for c, _ in order]
    rows = df.select(*keys, *cols)
    how = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]
    kept = rows
    if all(rows.schema[c].dataType.simpleString().split("(")[0] in _ORDERED for c in [*keys, *cols]):
        bound = _fresh("bound", rows.columns)
        kept = _cut(rows, F.broadcast(_greatest(local_bounds(rows, keys, order, n), keys, how, cols, bound, bounds)), keys, order, bound)
    ranked = kept.withColumn(place, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*how)).cast("bigint"))
    return ranked.filter(F.col(place) <= n).distinct()


def local_bounds(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """For each partition and group with at least `n` distinct rows there, the n-th best of them.

    Rows with a null or NaN in an ordering column are left out: any `n` distinct
    rows bound the group. A partition holds at most `GATHER` rows and its best
    ones of each group.
    """
    cols = [c for c, _ in order]
    full = rows
    for c in cols:
        full = full.filter(F.col(c).isNotNull())
        if rows.schema[c].dataType.simpleString() in ("float", "double"):
            full = full.filter(~F.isnan(c))
    by = [(c, "descending" if desc else "ascending") for c, desc in order]

    def best(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The first n distinct rows of each group in order, and each row's place from 0."""
        table = table.take(pc.sort_indices(table, sort_keys=[*((k, "ascending") for k in keys), *by]))
        same = np.ones(len(table), bool)
        same[:1] = False
        equal = same.copy()
        for i, c in enumerate([*keys, *cols]):
            col = table.column(c).combine_chunks()
            a, b = col[1:], col[:-1]
            eq = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            if i < len(keys):
                same[1:] &= eq
            equal[1:] &= eq
        distinct = np.cumsum(~equal)
        starts = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        rank = distinct - distinct[starts][group]
        keep = np.flatnonzero((rank < n) & ~equal)
        return table.take(pa.array(keep)), rank[keep]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting, limit = 0, GATHER
        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting >= limit:
                table, _ = best(pa.Table.from_batches(held))
                held, waiting = table.to_batches(), len(table)
                limit = max(GATHER, 2 * waiting)
        if held and waiting:
            table, rank = best(pa.Table.from_batches(held))
            yield from table.take(pa.array(np.flatnonzero(rank == n - 1))).to_batches()

    return full.mapInArrow(search, rows.schema)


def _greatest(local: DataFrame, keys: Sequence[str], how: Sequence[Column], cols: Sequence[str], bound: str, most: int) -> DataFrame:
    """(bound_<key>..., bound): the greatest local bound of each group, for the groups that most partitions have one of."""
    parts, at = f"{bound}_parts", f"{bound}_at"
    own = Window.partitionBy(*keys)
    ranked = local.withColumn(at, F.row_number().over(own.orderBy(*how))).withColumn(parts, F.count(F.lit(1)).over(own)).filter(F.col(at) == 1)
    names = [F.col(k).alias(f"{bound}_{k}") for k in keys]
    return ranked.orderBy(F.desc(parts), *keys).limit(most).select(*names, F.struct(*cols).alias(bound))


def _cut(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], bound: str) -> DataFrame:
    on = None
    for k in keys:
        same = rows[k].eqNullSafe(bounds[f"{bound}_{k}"])
        on = same if on is None else on & same
    joined = rows.join(bounds, on, "left")
    return joined.filter(F.col(bound).isNull() | ~_behind(order, bound)).select(*[F.col(c) for c in rows.columns])


def _behind(order: Sequence[tuple[str, bool]], bound: str) -> Column:
    """The row comes strictly after the bound; nulls come last."""
    out: Column = F.lit(False)
    for c, desc in reversed(order):
        own, other = F.col(c), F.col(bound)[c]
        worse = own < other if desc else own > other
        worse = F.coalesce(worse, own.isNull() & other.isNotNull())
        out = worse | (own.eqNullSafe(other) & out)
    return out


def _fresh(name: str, taken: Sequence[str]) -> str:
    out, low = f"_{name}", {c.lower() for c in taken}
    while any(c == out or c.startswith(f"{out}_") for c in low):
        out = f"_{out}"
    return out
