"""Session memory, and the one question back.

What a turn may refer to are the last few turns of its session since the session's last reset. Events are put in order by
ranges, cut into runs of ``RUN`` places, and each run leads in with the last events of the one before: so a session of any
length is dealt over many tasks, and every event is shuffled about once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import placed

RUN = 1024


def with_memory(turns: DataFrame, resets: DataFrame, n: int, session: str = "session_id", at: str = "turn") -> DataFrame:
    """``turns`` (session, at, role, text) with ``memory``: the ``n`` turns before it, oldest first, as (at, role, text), but
    none before the last of the ``resets`` (session, at) of its session. A reset at a turn's own place comes before it.
    Turns that tie come by role and text. Turns without a session remember nothing; a null place comes first."""
    shape = "struct<at:bigint,role:string,text:string>"
    said = turns.select(session, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), "role", "text")
    ends = resets.select(session, F.col(at).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    events = placed(said.unionByName(ends), ("_at", "_kind", "role", "text"), (session,), "_place")
    run, inside = F.floor(F.col("_place") / RUN), F.col("_place") % RUN
    ahead = F.when(inside >= RUN - n, F.array(run, run + 1)).otherwise(F.array(run))  # the lead-in of the next run
    dealt = events.withColumn("_run", F.explode(ahead))
    window = Window.partitionBy(session, "_run").orderBy("_place").rowsBetween(-n, -1)
    event = F.struct(F.col("_kind").alias("kind"), F.struct(F.col("_at").alias("at"), "role", "text").cast(shape).alias("turn"))
    before = dealt.withColumn("_before", F.collect_list(event).over(window)).where((F.col("_kind") == 1) & (F.col("_run") == run))
    since = F.aggregate("_before", F.array().cast(f"array<{shape}>"), lambda kept, e: F.when(e["kind"] == 0, F.array().cast(f"array<{shape}>")).otherwise(F.concat(kept, F.array(e["turn"]))))
    memory = F.when(F.col(session).isNull(), F.array().cast(f"array<{shape}>")).otherwise(since)
    return before.select(session, F.col("_at").alias(at), "role", "text", memory.alias("memory"))


def in_context(remembered: DataFrame, resolve: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The ``search`` text of each user turn: ``resolve(text, memory)``, or the user's earlier turns and this one, by lines."""
    earlier = F.transform(F.filter("memory", lambda t: t["role"] == "user"), lambda t: F.coalesce(t["text"], F.lit("")))
    plain = F.array_join(F.concat(earlier, F.array(F.coalesce("text", F.lit("")))), "\n")
    return remembered.where("role = 'user'").withColumn("search", plain if resolve is None else resolve(F.col("text"), F.col("memory")))


def ambiguity(hits: DataFrame) -> DataFrame:
    """How clear each query's hits (query_id, parent_id, score; positive scores) are about their parent: query_id, parents,
    margin (by how much of its own score the best parent leads; 1 without a second one), entropy (of the parents' shares of
    all scores, 0 to 1) and options (parents, best first). A parent has the score of its best hit."""
    best = hits.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "parent_id")
    share = F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))
    rows = best.withColumn("_n", F.row_number().over(order)).withColumn("_p", share)
    sums = rows.groupBy("query_id").agg(
        F.count("*").alias("parents"), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("_first"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_second"),
        F.sum(-F.col("_p") * F.log("_p")).alias("_h"), F.transform(F.sort_array(F.collect_list(F.struct("_n", "parent_id"))), lambda o: o["parent_id"]).alias("options"),
    )
    entropy = F.when(F.col("parents") > 1, F.col("_h") / F.log(F.col("parents").cast("double"))).otherwise(0.0)
    margin = F.coalesce((F.col("_first") - F.col("_second")) / F.col("_first"), F.lit(1.0))
    return sums.select("query_id", "parents", margin.alias("margin"), entropy.alias("entropy"), "options")


def questions_back(queries: DataFrame, hits: DataFrame, least_margin: float, most_options: int = 3, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``queries`` (query_id, ...) that can go on, and those that wait for the user: with ``options`` (parents to choose
    from, best first) and ``margin``. A query waits if its best parent leads by less than ``least_margin``, and at most once:
    never if it is among ``asked`` (query_id). Without a hit there is nothing to ask about, and it goes on."""
    unclear = ambiguity(hits).where(F.col("margin") < least_margin)
    if asked is not None:
        unclear = unclear.join(asked.select("query_id").distinct(), "query_id", "left_anti")
    unclear = unclear.select("query_id", F.slice("options", 1, most_options).alias("options"), "margin")
    return queries.join(unclear.select("query_id"), "query_id", "left_anti"), queries.join(unclear, "query_id")


def resumed(waiting: DataFrame, replies: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits of waiting queries after their ``replies`` (query_id, parent_id): those of the parent that was chosen, in
    their old order, with new ranks. A reply that names none of the query's options changes nothing; the query goes on with
    all its hits. Queries without a reply still wait, and have no hits."""
    chosen = waiting.select("query_id", "options").join(replies.select("query_id", F.col("parent_id").alias("_reply")), "query_id")
    met = hits.join(chosen, "query_id").where(~F.array_contains("options", F.col("_reply")) | (F.col("parent_id") == F.col("_reply")))
    order = Window.partitionBy("query_id").orderBy("rank")
    return met.withColumn("rank", F.row_number().over(order)).select(*hits.columns)
