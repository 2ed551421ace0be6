"""What a comparison found, as plain data that goes to JSON and back."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class SideCounts:
    total_rows: int = 0
    duplicate_keys: int = 0
    duplicate_rows: int = 0
    max_multiplicity: int = 0
    null_key_rows: int = 0


@dataclass
class ColumnFound:
    """diff_count: before tolerance. stats: as the column's kind names them; empty after an abort."""

    name: str
    kind: str
    type: str
    diff_count: int = 0
    toleranced: bool = False
    within: int | None = None
    outside: int | None = None
    stats: dict[str, float | int | None] = field(default_factory=dict)

    @property
    def status(self) -> str:
        """OK if tolerance excuses all differences, NOK otherwise."""
        if self.toleranced and self.outside is not None:
            return "NOK" if self.outside else "OK"
        return "NOK" if self.diff_count else "OK"


@dataclass
class Summary:
    table_a: str
    table_b: str
    keys: list[str]
    side_a: SideCounts
    side_b: SideCounts
    rows_only_in_a: int
    rows_only_in_b: int
    rows_in_both_diff: int
    rows_in_both_diff_post_tolerance: int | None
    columns: list[ColumnFound]
    excluded: list[list[str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    filter_a: str | None = None
    filter_b: str | None = None
    absolute: dict[str, float] = field(default_factory=dict)
    relative: dict[str, float] = field(default_factory=dict)
    aborted: bool = False
    legacy: bool = False

    @property
    def rows_matched(self) -> int:
        return self.side_a.total_rows - self.rows_only_in_a

    @property
    def rows_identical(self) -> int:
        """Before tolerance."""
        return self.rows_matched - self.rows_in_both_diff

    @property
    def rows_different(self) -> int:
        """In both tables, after tolerance where there is one."""
        post = self.rows_in_both_diff_post_tolerance
        return self.rows_in_both_diff if post is None else post

    @property
    def identical(self) -> bool:
        return not (self.rows_only_in_a or self.rows_only_in_b or self.rows_different)

    @property
    def differing(self) -> list[ColumnFound]:
        return [c for c in self.columns if c.diff_count]

    def diff_share(self, column: ColumnFound) -> float | None:
        return column.diff_count / self.rows_matched if self.rows_matched else None

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Summary:
        raw: dict[str, Any] = json.loads(text)
        raw["columns"] = [ColumnFound(**c) for c in raw["columns"]]
        raw["side_a"], raw["side_b"] = SideCounts(**raw["side_a"]), SideCounts(**raw["side_b"])
        return cls(**raw)


def cache_path(table_a: str, table_b: str, keys: Sequence[str]) -> Path:
    """Where the summary of these tables and keys is kept, in the order of neither keys nor tolerances."""
    folder = Path(os.environ.get("ROWPARITY_CACHE", "~/.rowparity")).expanduser()
    about = json.dumps({"a": table_a, "b": table_b, "keys": sorted(keys)})
    return folder / f"summary-{hashlib.sha256(about.encode()).hexdigest()[:20]}.json"
