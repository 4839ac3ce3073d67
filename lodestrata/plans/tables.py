"""The engine's tables, made from the test tables: what is on disk, what the registry knows, chunks and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import pack_fingerprint


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer tasks than there are: a small table may be one row group,
    which no setting splits. Large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: The languages of ``documents``.
LANGUAGES = ("de", "en", "es", "fr")
#: Extension by source and language; one source has files of a type that isn't supported.
EXTENSION = "CASE WHEN source = 'src1' THEN 'pptx' WHEN lang = 'en' THEN 'md' WHEN lang = 'fr' THEN 'txt' WHEN lang = 'de' THEN 'docx' ELSE 'pdf' END"
FILE_NAME = f"concat('doc-', doc_id, '.', {EXTENSION})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a workspace for each source."""
    docs = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return docs.selectExpr("doc_id", "source AS workspace_id", f"{FILE_NAME} AS file_name", f"{EXTENSION} AS file_type", "lang", "coalesce(text, '') AS text", "n_chars")


def on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan: French documents of low quality were deleted, and one source can't be read."""
    deleted = load(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    every = files(spark, sf_dir)
    left = every.join(deleted.withColumn("_low", F.lit(True)), "doc_id", "left").where("NOT (lang = 'fr' AND _low IS NOT NULL)")
    state = F.when(F.col("file_type") == "pptx", "unsupported").when(F.col("workspace_id") == "src2", "unreadable").otherwise("ok")
    ok = F.col("scan_state") == "ok"
    rows = left.withColumn("scan_state", state)
    return rows.select(
        "workspace_id", "file_name", "file_type", "scan_state", F.when(ok, F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.when(ok, F.octet_length("text").cast("long")).alias("size_bytes"),
    )


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows: the labelled documents. Toxic ones had other bytes, German ones another size, Spanish ones a hash
    that can't be parsed; some sources are removed, failed or skipped."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = files(spark, sf_dir).join(labels, "doc_id")
    right = pack_fingerprint(F.sha2(F.col("text").cast("binary"), 256), F.octet_length("text"))
    other = pack_fingerprint(F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256), F.octet_length("text"))
    forged = pack_fingerprint(F.sha2(F.col("text").cast("binary"), 256), F.octet_length("text") + 1)
    packed = F.when(F.col("toxic") == 1, other).when(F.col("lang") == "de", forged).when(F.col("lang") == "es", "sha256:garbage").otherwise(right)
    status = F.when(F.col("workspace_id") == "src3", "removed").when(F.col("workspace_id") == "src4", "failed").when(F.col("workspace_id") == "src5", "skipped").otherwise("active")
    return rows.select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "workspace_id", "file_name", "file_type", packed.alias("content_hash"), F.ceil(F.col("n_chars") / 3000).cast("int").alias("page_count"), status.alias("status"),
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("id"), (F.col("source") == "src7").alias("legal_flag")).distinct()


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as markdown: its lines as paragraphs, a second-level heading before each third one."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("## s"), i.cast("string"), F.lit("\n\n"), x)).otherwise(x)), "\n\n")
    return spread(files(spark, sf_dir)).select("doc_id", F.col("file_name").alias("source_file"), F.concat(F.lit("# doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), body).alias("markdown"))


def rough_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as markdown that is hard to cut: fences of both kinds (some never close), headings inside them, of
    level four, without a space, after a tab, with no-break spaces, and lines that end in CRLF or a line separator."""

    def line(x, i):
        n = i.cast("string")
        return (
            F.when(i % 9 == 1, F.concat(F.lit("##\u00a0n"), n, F.lit("\u00a0 "))).when(i % 9 == 2, F.concat(F.lit("#### four "), n)).when(i % 9 == 3, F.concat(F.lit("  ```sql\n"), x))
            .when(i % 9 == 4, F.concat(F.lit("# may be inside "), n)).when(i % 9 == 5, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("~~~\n"), x)).otherwise(F.concat(F.lit("#tag"), n)))
            .when(i % 9 == 6, F.concat(F.lit("\t# tabbed\u2003\n"), x)).when(i % 9 == 7, F.concat(F.lit("### level "), n, F.lit("\r"))).when(i % 9 == 8, F.concat(x, F.lit("\u2028# after "), n, F.lit("\x1c")))
            .otherwise(x)
        )

    return spread(files(spark, sf_dir)).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("markdown"))


def raw_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the bytes of text files: with a mark at the start, CRLF, CR, a byte that isn't UTF-8, or a mark inside."""
    text = lambda to: F.replace("text", F.lit("\n"), F.lit(to)).cast("binary")
    kind, plain, mark = F.col("doc_id") % 5, F.col("text").cast("binary"), F.lit("\ufeff").cast("binary")
    content = F.when(kind == 0, F.concat(mark, plain)).when(kind == 1, text("\r\n")).when(kind == 2, text("\r")).when(kind == 3, F.concat(plain, F.unhex(F.lit("FF")))).otherwise(F.concat(F.lit("a").cast("binary"), mark, plain))
    return files(spark, sf_dir).select("doc_id", content.alias("content"))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of ``benchmark`` as a PDF file: a title in large type, and its text, which is ASCII here. Every third file
    breaks off, and every fifth needs a password."""
    text = F.regexp_replace("text", r"[^\x20-\x7E]", "?")
    escaped = F.regexp_replace(text, r"([\\()])", r"\\$1")
    shown = F.concat(F.lit("BT /F1 24 Tf 1 0 0 1 72 720 Tm (Item "), F.col("item_id").cast("string"), F.lit(") Tj /F1 12 Tf 1 0 0 1 72 600 Tm ("), escaped, F.lit(") Tj ET"))
    tree = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << /Length "
    end = F.when(F.col("item_id") % 5 == 1, "\nendstream endobj\ntrailer << /Root 1 0 R /Encrypt 9 0 R >>\n%%EOF\n").otherwise("\nendstream endobj\ntrailer << /Root 1 0 R >>\n%%EOF\n")
    whole = F.concat(F.lit(tree), F.length(shown).cast("string"), F.lit(" >>\nstream\n"), shown, F.when(F.col("item_id") % 3 == 2, "").otherwise(end))
    return load(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.concat(F.lit("item-"), "item_id", F.lit(".PDF")).alias("file_name"), whole.cast("binary").alias("content"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What converting would give: blank files are skipped, short PDF and Word files fail."""
    short = F.col("file_type").isin("pdf", "docx") & (F.length("text") < 200)
    outcome = F.when(F.length(F.trim("text")) == 0, "skipped").when(short, "failed").otherwise("converted")
    return files(spark, sf_dir).select("workspace_id", "file_name", outcome.alias("outcome"), F.when(outcome != "converted", F.concat(F.lit("was "), outcome)).alias("reason"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with text and vector: documents that have a vector of the same id, in a workspace for each language."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("workspace_id"), "source", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(vectors, "doc_id").withColumnRenamed("doc_id", "chunk_id")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as answered questions, a run for each source; toxic ones are out of scope."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = labels.join(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    inside = F.col("toxic") == 0
    return rows.select(
        F.col("source").alias("eval_run_id"), F.col("doc_id").cast("string").alias("question_id"), F.when(inside, "in_scope").otherwise("out_of_scope").alias("kind"),
        F.when(inside, (F.pmod("n_chars", F.lit(101)) + 899) / 1000.0).cast("double").alias("groundedness"), F.when(inside, F.pmod("n_chars", F.lit(89)) / 100.0).cast("double").alias("relevancy"),
        (F.col("quality") == 1).alias("passed"), (F.col("n_chars") > 300).alias("sourced"),
    )


def write_files(rows: DataFrame, folder: str) -> None:
    """A file below ``folder`` for each row (file_name, text), written where the rows are."""

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for batch in batches:
            system.create_dir(root, recursive=True)
            for name, text in zip(batch["file_name"], batch["text"], strict=True):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write((text or "").encode())
            yield batch[["file_name"]]

    rows.mapInPandas(write, "file_name string").count()
