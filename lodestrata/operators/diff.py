"""Change detection: what is on disk against what the registry knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import parse_fingerprint

from .order import placed

NEW, CHANGED, UNCHANGED, REMOVED = "new", "changed", "unchanged", "removed"
OK, UNSUPPORTED, UNREADABLE = "ok", "unsupported", "unreadable"


def classified(status: Column, packed: Column, digest: Column, size: Column) -> Column:
    """What a file on disk is to its registry row. Removed rows come back as new; a hash that can't be parsed counts as
    changed; a failed or skipped file with equal bytes is unchanged, so it isn't tried again."""
    known = parse_fingerprint(packed)
    same = (known["digest"] == digest) & (known["size"] == size)
    return F.when(status.isNull() | (status == REMOVED), NEW).when(known.isNull() | ~same, CHANGED).otherwise(UNCHANGED)


def detect_changes(scan: DataFrame, documents: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """``scan`` (file_name, file_type, scan_state, digest, size_bytes) against ``documents`` (id, file_name, file_type,
    content_hash, status): file_name, change, file_type, digest, size_bytes, document_id.

    ``scope`` names columns that both tables have (workspace_id, say) and that files never cross. Both sides meet in one
    full outer join by file name. Unreadable files keep their rows from being removed; files of a type that isn't
    supported (any more) don't, and are also listed as unsupported by the scan. :func:`in_order` gives the rows' order.
    """
    keys = [*scope, "file_name"]
    present = scan.where(F.col("scan_state") != UNSUPPORTED).select(*keys, F.col("file_type").alias("_type"), "scan_state", "digest", "size_bytes")
    known = documents.select(*keys, "id", "file_type", "content_hash", "status")
    both = present.join(known, keys, "full_outer")
    gone = F.col("scan_state").isNull()
    change = F.when(gone, REMOVED).otherwise(classified(F.col("status"), F.col("content_hash"), F.col("digest"), F.col("size_bytes")))
    rows = both.where((F.col("scan_state") == OK) | (gone & (F.col("status") != REMOVED)))
    return rows.select(*keys, change.alias("change"), F.coalesce("_type", "file_type").alias("file_type"), "digest", "size_bytes", F.col("id").alias("document_id"))


def in_order(rows: DataFrame, scope: tuple[str, ...] = (), by: tuple[str, ...] = ("file_name",), name: str = "ord") -> DataFrame:
    """``rows`` with their place (from 0) within ``scope`` by file name in code point order: for the reader to sort by, as
    rows of a distributed table have no order of their own."""
    return placed(rows, by, scope, name)


def by_change(changes: DataFrame, change: str) -> DataFrame:
    return changes.where(F.col("change") == change)


def sync_results(changes: DataFrame, conversions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The result and reason of each change, once new and changed files were converted (file_name, outcome, reason)."""
    keys = [*scope, "file_name"]
    outcome = conversions.select(*keys, "outcome", F.col("reason").alias("_reason"))
    result = (
        F.when(F.col("change").isin(UNCHANGED, REMOVED), F.col("change")).when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "skipped", "skipped")
        .when(F.col("outcome").isNull(), "failed").when(F.col("change") == NEW, "added").otherwise("changed")
    )
    attempted = F.col("change").isin(NEW, CHANGED)
    reason = F.when(attempted & F.col("outcome").isNull(), "the file was not converted").when(attempted, F.col("_reason"))
    return changes.join(outcome, keys, "left").withColumn("result", result).withColumn("reason", reason).drop("outcome", "_reason")
