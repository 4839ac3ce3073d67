"""Derived identifiers and packed fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of parent ids: a name-based UUID of the engine's own.
PARENT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lodestrata:parent")
ALGORITHM = "sha256"


def name_uuid(namespace: uuid.UUID, name: Column) -> Column:
    """Version 5 UUID of a name, the same as Python's uuid5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def parent_id(source_file: Column, index: Column, namespace: uuid.UUID = PARENT_NAMESPACE) -> Column:
    """The same for the same file name and place, in whatever workspace: re-ingesting a file replaces its parents."""
    return name_uuid(namespace, F.concat(source_file, F.lit("\0"), index.cast("string")))


def pack_fingerprint(digest: Column, size: Column) -> Column:
    return F.concat_ws(":", F.lit(ALGORITHM), digest, size.cast("string"))


def parse_fingerprint(packed: Column) -> Column:
    """struct<digest, size>, or null unless there are three fields, a known algorithm, a digest, and a size of ASCII
    digits. (Signs, spaces and underscores in the size are not accepted: only :func:`pack_fingerprint` writes it.)"""
    part = F.split(packed, ":")
    size = F.when(F.get(part, F.lit(2)).rlike(r"^[0-9]{1,19}\z"), F.get(part, F.lit(2))).try_cast("bigint")
    good = (F.size(part) == 3) & (F.get(part, F.lit(0)) == ALGORITHM) & (F.get(part, F.lit(1)) != "") & size.isNotNull()
    return F.when(good, F.struct(F.get(part, F.lit(1)).alias("digest"), size.alias("size")))
