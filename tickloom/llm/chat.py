"""Chat formatting with cumulative-snapshot collapse.

Logs often hold the same conversation once a turn, each snapshot a prefix of the
next. A rolling hash of the turns (two 64-bit words over position, role and
text) names every turn prefix; a conversation whose whole hash is a shorter
prefix of another, or equals that of a smaller conv_id, is dropped by anti-join.
The rest are rendered.

Defined cases: turns sort by (turn, role, text), nulls first, and exact repeats
of a row count once; a null text or role renders as empty; rows without conv_id
belong to no conversation and are left out; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of every maximal conversation."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("k", F.row_number().over(order))
    prefix = numbered.select("conv_id", "k", "role", "text", F.bit_xor(F.xxhash64("k", "role", "text")).over(rolling).alias("h1"), F.bit_xor(F.xxhash64("text", F.lit("chain"), "role", "k")).over(rolling).alias("h2"))
    prefix = stage(prefix, "turn_prefixes")
    whole = prefix.groupBy("conv_id").agg(F.max("k").alias("n"), F.max_by(F.struct("h1", "h2"), "k").alias("h")).select("conv_id", "n", "h.h1", "h.h2")
    one = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = prefix.join(whole.select("conv_id", "n"), "conv_id").where("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    maximal = one.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n")
    turn = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    kept = prefix.select("conv_id", "k", turn.alias("t")).join(maximal, "conv_id")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "")
    return kept.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), body.alias("text"))


CHAT_SQL = """
WITH r AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS k,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS t
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT conv_id, max(k) AS n, arg_max(t, k) AS t FROM p GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n, t FROM f GROUP BY n, t),
inner_ AS (SELECT DISTINCT p.k, p.t FROM p JOIN f USING (conv_id) WHERE p.k < f.n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, t AS text FROM one
WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.k = one.n AND i.t = one.t)
"""
