"""Which column of an analysis table plays which part."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """Unit id, treatment (0/1), outcome (0/1) and covariates of an analysis table."""

    id: str
    t: str
    y: str
    x: tuple[str, ...]

    @classmethod
    def infer(cls, df: DataFrame, id: str, t: str, y: str) -> "Roles":
        """Every column that is not the id, treatment or outcome is a covariate."""
        missing = [c for c in (id, t, y) if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        return cls(id, t, y, tuple(c for c in df.columns if c not in (id, t, y)))

    def with_x(self, x) -> "Roles":
        return replace(self, x=tuple(x))
