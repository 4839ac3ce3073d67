"""All tunables of the engine in one immutable object that callers pass on; nothing reads it behind their back."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


class InvalidSettings(ValueError):
    """A combination of settings that no plan can be built for."""


@dataclass(frozen=True)
class Settings:
    # segmentation, in characters
    child_size: int = 500
    child_overlap: int = 100
    merge_below: int = 2000
    split_above: int = 4000
    # vectors
    dense_width: int = 768
    passage_prefix: str = "passage: "
    query_prefix: str = "query: "
    # retrieval
    top_k: int = 5
    retry_ceiling: int = 2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    fusion_constant: int = 60
    # files
    supported_types: tuple[str, ...] = ("pdf", "docx", "txt", "md")
    min_text_chars: int = 1
    hash_block_bytes: int = 1 << 20
    # workspaces
    name_min: int = 1
    name_max: int = 100
    folder_min: int = 1
    page_cap: int = 1500
    file_cap: int = 50
    # registry
    busy_timeout_s: float = 30.0
    lock_expiry_s: float = 600.0
    lease_s: float = 60.0
    wave_files: int = 10_000
    run_expiry_s: float = 6 * 3600.0
    # release gate
    gate_groundedness: float = 0.90
    gate_refusals: int = 20

    def checked(self) -> "Settings":
        """Self, once the segmentation sizes make sense. ``merge_below`` may be anything."""
        if self.child_size <= 0:
            raise InvalidSettings(f"child_size must be positive, not {self.child_size}")
        if self.child_overlap < 0:
            raise InvalidSettings(f"child_overlap can't be negative: {self.child_overlap}")
        if self.child_overlap >= self.child_size:
            raise InvalidSettings(f"child_overlap {self.child_overlap} must be under child_size {self.child_size}, or windows never advance")
        if self.split_above <= 0:
            raise InvalidSettings(f"split_above must be positive, not {self.split_above}")
        return self

    @classmethod
    def from_environment(cls, prefix: str = "LODESTRATA_") -> "Settings":
        """Defaults, overridden by variables such as LODESTRATA_CHILD_SIZE."""
        given = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(getattr(cls, f.name))
                given[f.name] = tuple(raw.split(",")) if kind is tuple else kind(raw)
        return replace(cls(), **given)
