"""Writing answers from passages alone.

The writer is a callable over a DataFrame: it sees each question with the passages found for it, and nothing else. What it
leaves without a text is refused, as is a question without a passage; a refusal lists what was searched for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFUSAL = "Nothing in this workspace answers the question."
NEXT_STEP = "Ask with words that the documents use, or in another workspace."


def contexts(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, question and passages (rank, source_file, section_label, text; best first) of the ``queries`` (query_id,
    text) for which :func:`retrieve.with_parents` found any. A query has as many passages as it was asked for at most."""
    passage = F.struct("rank", "source_file", "section_label", "text")
    passages = found.groupBy("query_id").agg(F.sort_array(F.collect_list(passage)).alias("passages"))
    return queries.select("query_id", F.col("text").alias("question")).join(passages, "query_id")


def written(replies: DataFrame, context: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ``replies`` of :func:`retrieve.answers` with their ``text``: ``write(context)`` gives (query_id, text), a row for
    each query. Where that is missing or blank, the reply becomes a refusal without sources."""
    texts = write(context).select("query_id", F.col("text").alias("_text"))
    joined = replies.join(texts, "query_id", "left")
    refused = F.col("refusal") | F.coalesce(F.length(F.trim("_text")) == 0, F.lit(True))
    tried = F.when(F.size("searched") > 0, F.concat(F.lit(" Searched for: "), F.array_join("searched", "; ", "(nothing)"), F.lit("."))).otherwise("")
    apology = F.concat(F.lit(REFUSAL), F.coalesce(tried, F.lit("")), F.lit(f" {NEXT_STEP}"))
    none = F.expr("array()").cast(replies.schema["sources"].dataType)
    new = {"kind": F.when(refused, "refusal").otherwise(F.col("kind")), "refusal": refused, "sources": F.when(refused, none).otherwise(F.col("sources"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in replies.columns], F.when(refused, apology).otherwise(F.col("_text")).alias("text"))
