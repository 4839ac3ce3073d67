from pyspark.sql import functions as F

from lodestrata.operators import compose, retrieve

FOUND = "query_id int, workspace_id string, parent_id string, rank int, source_file string, section_label string, text string"


def tables(spark):
    queries = spark.createDataFrame([(k, "w", f"q{k}" if k != 4 else None) for k in (1, 2, 3, 4)], "query_id int, workspace_id string, text string")
    found = [(1, "w", "p2", 2, "b.md", None, "second"), (1, "w", "p1", 1, "a.md", "A", "first"), (2, "w", "p1", 1, "a.md", "A", None), (4, "w", "p3", 1, "c.md", "C", "third")]
    attempts = spark.createDataFrame([(1, 0, "q1"), (2, 0, "q2"), (3, 0, "q3"), (3, 1, "q3 again"), (4, 0, None)], "query_id int, attempt int, search string")
    return queries, spark.createDataFrame(found, FOUND), attempts, spark.createDataFrame([("w", True)], "id string, legal_flag boolean")


def plainly(context):
    return context.select("query_id", F.array_join(F.transform("passages", lambda p: p["text"]), " ").alias("text"), F.lit(1).alias("kind"))


def test_answers_are_written_from_passages_alone(spark):
    queries, found, attempts, spaces = tables(spark)
    context = compose.contexts(queries, found)
    got = {r.query_id: (r.question, [(p.rank, p.source_file, p.text) for p in r.passages]) for r in context.collect()}
    assert got == {1: ("q1", [(1, "a.md", "first"), (2, "b.md", "second")]), 2: ("q2", [(1, "a.md", None)]), 4: (None, [(1, "c.md", "third")])}
    replies = retrieve.answers(queries, found, attempts, spaces)
    out = compose.written(replies, context, plainly)
    assert out.columns == [*replies.columns, "text"]
    rows = {r.query_id: r for r in out.collect()}
    assert rows[1].text == "first second" and rows[1].kind == "answer" and [s.file_name for s in rows[1].sources] == ["a.md", "b.md"]
    assert rows[4].text == "third" and rows[4].disclaimer
    # nothing found, or nothing written: refused, with what was searched for
    assert rows[3].kind == "refusal" and rows[3].text == f"{compose.REFUSAL} Searched for: q3; q3 again. {compose.NEXT_STEP}"
    assert rows[2].kind == "refusal" and rows[2].refusal and rows[2].sources == [] and "Searched for: q2." in rows[2].text
    assert compose.written(replies, context, lambda c: plainly(c).where("false")).where("not refusal").count() == 0
    assert compose.written(replies.limit(0), context, plainly).count() == compose.contexts(queries, found.limit(0)).count() == 0
