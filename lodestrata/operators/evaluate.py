"""Roll-ups of sync runs and evaluations, and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.settings import Settings

RESULTS = ("added", "changed", "unchanged", "failed", "removed", "skipped")


def run_counters(items: DataFrame) -> DataFrame:
    """sync_run_id and the number of items of each result."""
    return items.groupBy("sync_run_id").agg(*[F.count_if(F.col("result") == r).cast("int").alias(r) for r in RESULTS])


def run_history(runs: DataFrame) -> DataFrame:
    """Runs with their state, newest first."""
    return runs.withColumn("state", F.when(F.col("finished_at").isNull(), "running").otherwise("finished")).orderBy(F.desc("started_at"), "id")


def with_details(heads: DataFrame, rows: DataFrame, key: str, columns: list[str], order: list[str], name: str) -> DataFrame:
    """Each head row with an ordered array of its rows; an empty one where it has none."""
    nested = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("_row")))).alias("_rows"))
    joined = heads.join(nested.withColumnRenamed(key, "id"), "id", "left")
    return joined.withColumn(name, F.coalesce(F.transform("_rows", lambda r: r["_row"]), F.expr("array()").cast(f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in rows.select(*columns).schema)}>>"))).drop("_rows")


def evaluation_summary(results: DataFrame) -> DataFrame:
    """eval_run_id, means over the scored questions, and refusals passed over out-of-scope ones."""
    outside = F.col("kind") == "out_of_scope"
    return results.groupBy("eval_run_id").agg(
        F.avg("groundedness").alias("groundedness"), F.avg("relevancy").alias("relevancy"),
        F.count_if(outside & F.col("passed")).cast("int").alias("refusal_pass"), F.count_if(outside).cast("int").alias("refusal_total"),
    )


def release_gate(results: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The summary with passed and the failing questions. ``results`` also has sourced: whether an in-scope answer named
    a source. Passed: groundedness reaches its bound, all refusals of a full set hold, and every answer is sourced."""
    inside = F.col("kind") == "in_scope"
    failing = results.where(~F.col("passed") | (inside & ~F.coalesce("sourced", F.lit(False)))).groupBy("eval_run_id").agg(F.sort_array(F.collect_list("question_id")).alias("failing"))
    sourced = results.groupBy("eval_run_id").agg(F.coalesce(F.bool_and(F.when(inside, F.coalesce("sourced", F.lit(False)))), F.lit(True)).alias("all_sourced"))
    joined = evaluation_summary(results).join(sourced, "eval_run_id").join(failing, "eval_run_id", "left")
    full = (F.col("refusal_total") >= settings.gate_refusals) & (F.col("refusal_pass") == F.col("refusal_total"))
    good = F.coalesce(F.col("groundedness") >= settings.gate_groundedness, F.lit(False)) & full & F.col("all_sourced")
    return joined.withColumn("passed", good).withColumn("failing", F.coalesce("failing", F.expr("cast(array() as array<string>)")))


def reports(gated: DataFrame, folder: str, day: str) -> DataFrame:
    """One report per run of :func:`release_gate`: eval_run_id, report_path (dated), body (JSON of the run's row)."""
    path = F.concat(F.lit(f"{folder.rstrip('/')}/run_date={day}/"), "eval_run_id", F.lit(".json"))
    return gated.select("eval_run_id", path.alias("report_path"), F.to_json(F.struct(*gated.columns), {"ignoreNullFields": "false"}).alias("body"))


def write_reports(gated: DataFrame, folder: str, day: str) -> None:
    """Append the runs' reports as JSON lines below ``folder``, by day."""
    gated.withColumn("run_date", F.lit(day)).write.mode("append").partitionBy("run_date").json(folder)


def latency(traces: DataFrame, column: str = "seconds") -> DataFrame:
    """Exact median and 95th percentile."""
    return traces.agg(F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.95)).alias("p95"))


def over_cap(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """workspace_id, files, pages, warning: whether a workspace outgrew its soft caps."""
    live = documents.where(F.col("status") != "removed").groupBy("workspace_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))
    return live.withColumn("warning", (F.col("files") > settings.file_cap) | (F.col("pages") > settings.page_cap))


#: Values that a sketch keeps of each of its levels: ranks are right to about a third of a percent.
SKETCH_K = 800


def latency_sketches(traces: DataFrame, by: tuple[str, ...], column: str = "seconds") -> DataFrame:
    """Of each group (a day, say), n and a quantile sketch of ``column``: a few kilobytes, however many values there are,
    to be stored and merged later. Nulls don't count."""
    return traces.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), SKETCH_K).alias("sketch"))


def merged_latency(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, median and p95 over the groups that share ``by``, from their sketches alone."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.select(*by, "n", at(0.5).alias("median"), at(0.95).alias("p95"))
