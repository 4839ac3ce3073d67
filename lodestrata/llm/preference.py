"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix (equal roles and texts from the first turn on) is rendered once as the prompt. What
follows on either side is rendered as that side's completion, with a mask: the character spans that a loss is taken over,
which are the texts of assistant turns and their end marks. Headers and other roles' turns stay unmasked.

One aggregation by pair gathers its turns, and all else is array functions on that row; there is no other shuffle. A
pair's turns are its own output row, so what a task gathers for a key is one training example.

A null role is ``user``; a null text is empty. Turns that repeat a number come in order of role and text. Whole control
marks inside roles and texts are broken up by a blank, so that a text can't forge a turn; all else stays as it is. A pair with only one side has an empty other side; status
says ``ok``, ``identical`` (no turn differs), ``chosen_empty`` or ``rejected_empty`` (one side is a prefix of the
other). Rows without a pair_id are one pair. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def _broken(mark: str) -> str:
    return mark.replace("<|", "<| ")


def _header(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column) -> Column:
    """array<struct<start, end>> in characters of the rendered turns; ends are exclusive."""
    sized = F.transform(turns, lambda t: F.struct(F.length(_header(t)).alias("h"), (F.length(t["text"]) + len(END)).alias("b"), (t["role"] == "assistant").alias("on")))
    empty = F.lit(None).cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + t["h"]
        span = F.array(F.struct(start.alias("start"), (start + t["b"]).alias("end")))
        return F.struct((start + t["b"] + 1).alias("at"), F.when(t["on"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(sized, first, step, lambda s: s["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Two tables of turns (pair_id, turn, role, text) -> pair_id, status, n_prefix, prompt, chosen, rejected,
    chosen_mask, rejected_mask."""
    whole = lambda x: F.coalesce(F.col(x), F.lit("user" if x == "role" else ""))
    clean = lambda x: F.replace(F.replace(whole(x), F.lit(START), F.lit(_broken(START))), F.lit(END), F.lit(_broken(END)))
    side = lambda df, n: df.select("pair_id", F.struct(F.lit(n).alias("side"), F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text")).alias("t"))
    rows = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    sides = rows.select("pair_id", F.filter("turns", lambda t: t["side"] == 0).alias("c"), F.filter("turns", lambda t: t["side"] == 1).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    counted = sides.withColumn("_miss", F.array_position(same, False).cast("int")).withColumn("n_prefix", F.when(F.col("_miss") > 0, F.col("_miss") - 1).otherwise(F.size("c")))
    tail = lambda x: F.slice(x, F.col("n_prefix") + 1, F.greatest(F.size(x) - F.col("n_prefix"), F.lit(0)))
    parts = counted.select("pair_id", "n_prefix", F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), tail("c").alias("c"), tail("r").alias("r"))
    status = (
        F.when((F.size("c") == 0) & (F.size("r") == 0), "identical").when(F.size("c") == 0, "chosen_empty").when(F.size("r") == 0, "rejected_empty").otherwise("ok")
    )
    return parts.select(
        "pair_id", status.alias("status"), "n_prefix", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations: each conversation up to its last assistant turn, and the same
    with that turn's text taken from the last assistant turn of its neighbour (ids 2k and 2k + 1 are neighbours; without
    one, the text is empty). Conversations without an assistant turn are left whole and as they are on both sides."""
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    mine = answers.select("conv_id", F.col("last.turn").alias("_last"))
    other = answers.select(F.col("conv_id").bitwiseXOR(1).alias("conv_id"), F.coalesce("last.text", F.lit("")).alias("_answer"))
    kept = turns.join(mine, "conv_id", "left").join(other, "conv_id", "left").where("_last IS NULL OR turn <= _last")
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("_last"))
    columns = lambda text: kept.select(F.col("conv_id").alias("pair_id"), "turn", "role", text.alias("text"))
    return columns(F.col("text")), columns(F.when(swap, F.coalesce("_answer", F.lit(""))).otherwise(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(*swapped_answers(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    spans = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.select("pair_id", "status", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


ORACLE_SQL = r"""
WITH answers AS (
  SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), texts AS (
  SELECT a.conv_id, a.last, max(coalesce(c.text, '')) AS answer
  FROM answers a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.last AND c.role = 'assistant' GROUP BY ALL
), kept AS (
  SELECT c.conv_id AS pair_id, c.turn, coalesce(c.role, 'user') AS role, coalesce(c.text, '') AS text,
         CASE WHEN c.role = 'assistant' AND c.turn = m.last THEN coalesce(o.answer, '') ELSE coalesce(c.text, '') END AS other
  FROM conversations c LEFT JOIN texts m ON m.conv_id = c.conv_id
  LEFT JOIN texts o ON o.conv_id = c.conv_id + 1 - 2 * (c.conv_id % 2)
  WHERE m.last IS NULL OR c.turn <= m.last
), sides AS (
  SELECT pair_id, 0 AS side, turn, role, text FROM kept UNION ALL SELECT pair_id, 1, turn, role, other FROM kept
), marked AS (
  SELECT pair_id, side, replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS role,
         replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS text,
         row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS n
  FROM sides
), prefix AS (
  SELECT c.pair_id, coalesce(min(CASE WHEN c.role <> r.role OR c.text <> r.text THEN c.n - 1 END), max(c.n)) AS n_prefix
  FROM marked c JOIN marked r ON r.pair_id = c.pair_id AND r.n = c.n AND c.side = 0 AND r.side = 1 GROUP BY c.pair_id
), shown AS (
  SELECT m.*, p.n_prefix, '<|im_start|>' || role || chr(10) AS header, text || '<|im_end|>' AS body
  FROM marked m JOIN prefix p USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(header) + length(body) + 1) OVER (PARTITION BY pair_id, side, n > n_prefix ORDER BY n
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(header) AS start
  FROM shown
)
SELECT pair_id,
       CASE WHEN count(*) FILTER (n > n_prefix) = 0 THEN 'identical' WHEN count(*) FILTER (side = 0 AND n > n_prefix) = 0 THEN 'chosen_empty'
            WHEN count(*) FILTER (side = 1 AND n > n_prefix) = 0 THEN 'rejected_empty' ELSE 'ok' END AS status,
       CAST(any_value(n_prefix) AS BIGINT) AS n_prefix,
       coalesce(string_agg(header || body || chr(10), '' ORDER BY n) FILTER (side = 0 AND n <= n_prefix), '') AS prompt,
       coalesce(string_agg(header || body || chr(10), '' ORDER BY n) FILTER (side = 0 AND n > n_prefix), '') AS chosen,
       coalesce(string_agg(header || body || chr(10), '' ORDER BY n) FILTER (side = 1 AND n > n_prefix), '') AS rejected,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY n)
         FILTER (side = 0 AND n > n_prefix AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY n)
         FILTER (side = 1 AND n > n_prefix AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""
