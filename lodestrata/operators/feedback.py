"""Feedback on answers: marks with comments, kept as they come in, and what a reviewer reads of them.

A mark (answer_id, user_id, mark, comment, at) says that a user finds an answer good (``up``) or bad (``down``), or takes
an earlier mark back (``none``). Of a user's marks on an answer the last one counts; marks of one time come by mark and
comment, and a null time is the earliest. So batches may overlap, come late or come twice.

Everything is aggregated by answer and user, or by answer, before it meets the answers; an answer that holds a large part
of all marks is one row by then in :func:`rates`, and in :func:`review` a skewed key that adaptive execution splits.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks, and the longest comment.
MARKS, COMMENT = ("up", "down", "none"), 4000
SCHEMA = "answer_id string, user_id string, mark string, comment string, at timestamp"
_COLUMNS = ("answer_id", "user_id", "mark", "comment", "at")


def checked(marks: DataFrame, answers: DataFrame) -> DataFrame:
    """The marks with the ``reason`` why one can't be kept, null where it can: a mark needs a user, one of ``MARKS``, a
    comment of at most ``COMMENT`` characters, and an answer that is there."""
    known = answers.where("answer_id IS NOT NULL").select("answer_id", F.lit(True).alias("_known")).distinct()
    joined = marks.select(*_COLUMNS).join(known, "answer_id", "left")
    reason = (
        F.when(F.col("_known").isNull(), "no such answer")
        .when(F.col("user_id").isNull(), "no user")
        .when(~F.coalesce(F.col("mark").isin(*MARKS), F.lit(False)), "not a mark")
        .when(F.length("comment") > COMMENT, "comment too long")
    )
    return joined.select(*_COLUMNS, reason.alias("reason"))


def record(marks: DataFrame, answers: DataFrame, folder: str) -> DataFrame:
    """Append the marks that can be kept to ``folder``, by the day of their time, and return the others with their reason."""
    found = checked(marks, answers)
    found.where("reason IS NULL").drop("reason").withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(folder)
    return found.where("reason IS NOT NULL")


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """All marks of ``folder``, with their day."""
    return spark.read.schema(f"{SCHEMA}, day date").parquet(folder)


def current(marks: DataFrame) -> DataFrame:
    """The mark of each user on each answer, without those taken back."""
    last = marks.groupBy("answer_id", "user_id").agg(F.max(F.struct("at", "mark", "comment")).alias("_last"))
    return last.select("answer_id", "user_id", "_last.mark", "_last.comment", "_last.at").where(F.col("mark").isin("up", "down"))


def review(answers: DataFrame, marks: DataFrame) -> DataFrame:
    """What users say of answers they mark down: workspace_id, answer_id, question, user_id, comment, at. ``answers`` has a
    row for each answer_id. Marks without a comment, or a blank one, are only counted."""
    said = current(marks).where((F.col("mark") == "down") & (F.length(F.trim("comment")) > 0))
    return answers.select("workspace_id", "answer_id", "question").join(said.drop("mark"), "answer_id").select("workspace_id", "answer_id", "question", "user_id", "comment", "at")


def _bound(p: Column, n: Column, z: float, side: int) -> Column:
    """A bound of the interval of a share ``p`` seen ``n`` times, by Wilson's score."""
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle + side * spread) / (1 + z * z / n)


def rates(answers: DataFrame, marks: DataFrame, by: tuple[str, ...] = ("workspace_id",), z: float = 1.96) -> DataFrame:
    """By the columns ``by`` of the answers: answers, marked (answers with a mark), up, down, share_down and its interval
    (low, high; null without a mark)."""
    counts = current(marks).groupBy("answer_id").agg(F.count_if(F.col("mark") == "up").alias("up"), F.count_if(F.col("mark") == "down").alias("down"))
    joined = answers.select("answer_id", *by).join(counts, "answer_id", "left")
    sums = joined.groupBy(*by).agg(F.count("*").alias("answers"), F.count("up").alias("marked"), F.coalesce(F.sum("up"), F.lit(0)).alias("up"), F.coalesce(F.sum("down"), F.lit(0)).alias("down"))
    n = F.col("up") + F.col("down")
    share = F.when(n > 0, F.col("down") / n)
    return sums.select(*by, "answers", "marked", "up", "down", share.alias("share_down"), F.when(n > 0, _bound(share, n, z, -1)).alias("low"), F.when(n > 0, _bound(share, n, z, 1)).alias("high"))
