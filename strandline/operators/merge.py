"""Row-level changes as pure plans: new state = f(old state, delta).

Plain Parquet has no UPDATE or MERGE. Every operator here returns the whole new
state; :mod:`strandline.operators.versions` commits it as one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def new_or_old(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def old_or_new(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def upsert(state: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]], where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: one full outer join on the keys.

    rules: column -> rule(old, new) for rows that are in both; columns without a
    rule keep their old value. where: on conflict, only rows for which it holds
    change (it sees old columns as ``o.x`` and new ones as ``n.x``).
    delta has at most one row a key.
    """
    o, n = state.alias("o"), delta.alias("n")
    condition = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    on = condition[0]
    for c in condition[1:]:
        on = on & c
    joined = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), on, "full_outer")
    both = F.col("o._o").isNotNull() & F.col("n._n").isNotNull()
    if where is not None:
        both = both & where(joined)
    only_new = F.col("o._o").isNull()
    out = []
    for c in state.columns:
        if c in keys:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
            continue
        fresh = F.col(f"n.{c}") if c in delta.columns else F.lit(None).cast(state.schema[c].dataType)
        rule = rules.get(c, keep_old)
        out.append(F.when(only_new, fresh).when(both, rule(F.col(f"o.{c}"), fresh)).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(out)


def insert_or_ignore(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta whose key is new join the state."""
    return state.unionByName(delta.select(state.columns).dropDuplicates(keys).join(state.select(keys), keys, "left_anti"))


def replace_rows(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The new row wins whole."""
    return state.join(delta.select(keys), keys, "left_anti").unionByName(delta.select(state.columns))


def delete_rows(state: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(doomed.select(keys), keys, "left_anti")


def update_existing(state: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE by key; a delta row that meets no state row is an error, raised when the plan runs."""
    out = upsert(state, delta, keys, dict.fromkeys(columns, keep_new))
    return fail_if_missing(out, state, delta, keys, "update met no row for ")


def fail_if_missing(out: DataFrame, state: DataFrame, wanted: DataFrame, keys: list[str], message: str) -> DataFrame:
    """out, failing when it runs if a key of wanted is not in state; an out without rows fails too."""
    missing = wanted.select(keys).join(state.select(keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("_missing"))
    checked = missing.select("_missing", F.when(F.col("_missing") > 0, F.raise_error(F.concat(F.lit(message), F.col("_missing").cast("string"), F.lit(" keys")))).otherwise(F.lit(True)).alias("_ok"))
    return out.crossJoin(F.broadcast(checked.where("_ok"))).select(out.columns)  # one row


def best_of_group(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, without a window: min_by over a struct, with map-side combine."""
    row = F.struct(*rows.columns)
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    return rows.groupBy(*key).agg(F.min_by(row, rank).alias("_row")).select("_row.*")
