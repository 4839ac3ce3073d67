"""Conversion of files to markdown: one row per file whatever it holds, in the order the files came."""

from __future__ import annotations

import logging

import pandas as pd
import pyarrow
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import file_type, strip
from lodestrata.settings import Settings

from .files import UNSUPPORTED_REASON, open_stream
from .readers import EMPTY, NOT_READ, NOT_UTF8, PDF_NO_TEXT, READERS, Unreadable

CONVERTED, FAILED, SKIPPED = "converted", "failed", "skipped"
_RESULT = "outcome string, markdown string, page_count int, reason string"


def convert_bytes(kind: str, data: bytes, settings: Settings = Settings(), readers=READERS) -> tuple:
    """(outcome, markdown, page_count, reason) of one file; markdown only where it converted, reason only where not."""
    reader = readers.get(kind) if kind in settings.supported_types else None
    if reader is None:
        return SKIPPED, None, None, UNSUPPORTED_REASON
    try:
        found = reader(data)
    except Unreadable as e:
        return FAILED, None, None, e.reason
    except Exception as e:  # parsers meet hostile bytes; one surprise costs one file
        logging.getLogger(__name__).exception("a reader of %s failed", kind)
        return FAILED, None, None, NOT_READ.format(f"{type(e).__name__}: {e}")
    if len(found.text.strip()) < settings.min_text_chars:
        return SKIPPED, None, None, PDF_NO_TEXT if kind == "pdf" else EMPTY
    return CONVERTED, found.text, found.pages, None


def convert_files(files: DataFrame, settings: Settings = Settings(), readers=READERS, opener=open_stream) -> DataFrame:
    """``files`` (file_name, path, and any others) with outcome, markdown, page_count and reason. Never fails for a bad
    file; a file that went away is a failed row."""
    names = files.columns
    clash = {"outcome", "markdown", "page_count", "reason", "_kind"} & set(names)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: the operator adds these names")

    def convert(batches):
        for batch in batches:
            rows = []
            for path, kind in zip(batch["path"], batch["_kind"], strict=True):
                if kind not in readers or kind not in settings.supported_types:
                    rows.append((SKIPPED, None, None, UNSUPPORTED_REASON))
                    continue
                try:
                    with opener(path) as f:
                        data = f.read()
                except OSError as e:
                    rows.append((FAILED, None, None, NOT_READ.format(e.strerror or e)))
                    continue
                rows.append(convert_bytes(kind, data, settings, readers))
            out = pd.DataFrame(rows, columns=["outcome", "markdown", "page_count", "reason"], index=batch.index).astype({"page_count": "Int32"})
            yield pd.concat([batch[names], out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.withColumn("_kind", file_type("file_name")).mapInPandas(convert, f"{fields}, {_RESULT}")


def convert_contents(files: DataFrame, content: str = "content", settings: Settings = Settings(), readers=READERS) -> DataFrame:
    """The same for files whose bytes are at hand, as the engine's binary source gives them: ``files`` (file_name, content
    and any others) with outcome, markdown, page_count and reason, without the bytes."""
    names = [c for c in files.columns if c != content]

    def convert(batches):
        for batch in batches:
            rows = [convert_bytes(kind, bytes(data or b""), settings, readers) for kind, data in zip(batch["_kind"].to_pylist(), batch[content].to_pylist(), strict=True)]
            found = [pyarrow.array([r[k] for r in rows], t) for k, t in enumerate((pyarrow.string(), pyarrow.string(), pyarrow.int32(), pyarrow.string()))]
            yield pyarrow.RecordBatch.from_arrays([*(batch[c] for c in names), *found], names=[*names, "outcome", "markdown", "page_count", "reason"])

    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names)
    return files.withColumn("_kind", file_type("file_name")).mapInArrow(convert, f"{fields}, {_RESULT}")


def convert_text(kind: Column, content: Column, settings: Settings = Settings()) -> Column:
    """The same for text files whose bytes are a column, as one expression: struct<outcome, markdown, reason>."""
    known = kind.isin(*[k for k in ("txt", "md") if k in settings.supported_types])
    text = F.regexp_replace(F.regexp_replace(content.cast("string"), "^\ufeff", ""), "\r\n?", "\n")
    valid = F.is_valid_utf8(content.cast("string"))
    outcome = F.when(~known, SKIPPED).when(~valid, FAILED).when(F.length(strip(text)) < settings.min_text_chars, SKIPPED).otherwise(CONVERTED)
    reason = F.when(~known, UNSUPPORTED_REASON).when(~valid, NOT_UTF8).when(outcome == SKIPPED, EMPTY)
    return F.struct(outcome.alias("outcome"), F.when(outcome == CONVERTED, text).alias("markdown"), reason.alias("reason"))
