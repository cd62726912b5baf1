"""Chat formatting: collapse logged snapshots to maximal conversations, then render them; DataFrame functions only.

A logger that stores the whole conversation at every turn leaves rows that
prefix longer ones. Each turn gets a rolling hash of all turns up to it (two
XORs of hashes salted with the position, 128 bits). A conversation whose last
hash is some longer conversation's hash at that turn is a prefix of it: an
anti-join drops it. Of equal conversations the smallest conv_id stays.

Turns are ordered by (turn, role, text), nulls first, and counted from 1, so
gaps in the numbers do not matter. Prefix hashes are made distinct before the
join: a first turn that a third of all conversations share is one row a task.

Defined cases: null role renders as ``user``, null text as an empty message
(both differ from those values in the comparison); null conv_id: one
conversation; repeated rows: repeated turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n (place of the turn), role, text, h1 and h2 (of all turns up to it), last."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    blank = (F.col("role").isNull().cast("int") + 2 * F.col("text").isNull().cast("int")).alias("blank")
    salted = placed.withColumns({f"t{k}": F.xxhash64(F.lit(k), "n", blank, F.coalesce("role", F.lit("")), F.lit(k), F.coalesce("text", F.lit(""))) for k in (1, 2)})
    running = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    following = Window.partitionBy("conv_id").orderBy("n")
    return salted.withColumns({"h1": F.bit_xor("t1").over(running), "h2": F.bit_xor("t2").over(running), "last": F.lead("n").over(following).isNull()}).drop("t1", "t2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay, and n_equal: how many equal ones each stands for."""
    hashed = prefix_hashes(turns)
    whole = hashed.where("last").select("conv_id", "n", "h1", "h2")
    inner = hashed.where("not last").select("n", "h1", "h2").distinct()
    kept = whole.groupBy("n", "h1", "h2").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    return kept.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_equal")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One row a kept conversation: conv_id, n_turns, n_equal, rendered."""
    kept = kept.withColumnRenamed("conv_id", "kept_id")
    own = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept_id"])).select("conv_id", "turn", "role", "text", "n_turns", "n_equal")
    # Nulls sort first in a struct, as in prefix_hashes.
    gathered = own.groupBy("conv_id", "n_turns", "n_equal").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text")), _in_order).alias("turns"))
    message = F.transform("turns", lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("user")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n")))
    return gathered.select("conv_id", "n_turns", "n_equal", F.array_join(message, "").alias("rendered"))


def _in_order(a, b):
    def side(name):
        x, y = a[name], b[name]
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)

    first, second = side("turn"), side("role")
    return F.when(first != 0, first).when(second != 0, second).otherwise(side("text"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    return render(turns, maximal(turns))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op7_chat_format": op7}

ORACLE = {
    "op7_chat_format": """WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS rendered
    FROM conversations GROUP BY conv_id),
  g AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(rendered) AS rendered FROM c GROUP BY turns),
  p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM g))
  SELECT conv_id, len(turns)::BIGINT AS n_turns, n_equal, rendered FROM g WHERE turns NOT IN (SELECT turns FROM p)""",
}
