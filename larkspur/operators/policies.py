"""Row-level security: the rows of a table that a user may see."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Policies:
    """Policies of one table: a user sees the rows that one of their policies lets through, and none without a policy."""

    rules: list[tuple[str, Column]] = field(default_factory=list)

    def add(self, user: str, using: Column) -> Policies:
        """A policy for a user, or for all users by the name public."""
        self.rules.append((user, using))
        return self

    def visible(self, table: DataFrame, user: str) -> DataFrame:
        """The rows that user may see; a condition that is NULL hides a row. The filter is pushed into the scan."""
        seen = F.lit(False)
        for who, using in self.rules:
            if who in (user, "public"):
                seen = seen | F.coalesce(using, F.lit(False))
        return table.where(seen)
