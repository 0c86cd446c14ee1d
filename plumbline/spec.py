"""Declarative descriptions of datasets, views and fitted constants."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

ROLES = ("conti", "disc", "cat", "date", "coord")


@dataclass(frozen=True)
class FieldSpec:
    """One column: its role and what cleaning does to it."""

    name: str
    attr: str | None = None           # conti, disc, cat, date, coord
    type: str | None = None
    omit: bool = False
    target: bool = False
    values: tuple | None = None       # ordered category domain
    miss: Any = None                  # method name, or a constant
    encode: str | None = None
    scale: str | None = None
    timeline: bool = False
    resample: int | None = None       # minutes
    gap: int | None = None            # minutes
    nunique: int | None = None

    def __post_init__(self):
        if self.attr is not None and self.attr not in ROLES:
            raise ValueError(f"unknown role {self.attr!r} of {self.name}")


@dataclass(frozen=True)
class DatasetSpec:
    fields: tuple[FieldSpec, ...]
    transform: dict = field(default_factory=dict)   # dataset-wide defaults: miss, encode, scale

    @classmethod
    def of(cls, fields: list[dict], transform: dict | None = None) -> "DatasetSpec":
        known = FieldSpec.__dataclass_fields__
        made = []
        for f in fields:
            kept = {k: v for k, v in f.items() if k in known}
            if kept.get("values") is not None:
                kept["values"] = tuple(kept["values"])
            for flag in ("omit", "target", "timeline"):
                kept[flag] = bool(kept.get(flag, False))
            made.append(FieldSpec(**kept))
        return cls(tuple(made), dict(transform or {}))

    def field(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    def method(self, f: FieldSpec, step: str) -> Any:
        """Method of a step for a field: its own setting before the dataset-wide default."""
        own = getattr(f, step)
        return own if own is not None else self.transform.get(step)

    def omitted(self) -> list[str]:
        return [f.name for f in self.fields if f.omit]

    def live(self, df: DataFrame) -> list[FieldSpec]:
        return [f for f in self.fields if not f.omit and f.name in df.columns]

    def names(self, df: DataFrame, *roles: str) -> list[str]:
        return [f.name for f in self.live(df) if f.attr in roles]

    def targets(self, df: DataFrame) -> list[str]:
        return [f.name for f in self.live(df) if f.target]

    def features(self, df: DataFrame) -> list[str]:
        return [f.name for f in self.live(df) if not f.target]

    def select_roles(self, df: DataFrame, *roles: str) -> DataFrame:
        return df.select(*self.names(df, *roles))

    def invalid(self, df: DataFrame) -> list[str]:
        """Configured columns that the table does not have."""
        return [f.name for f in self.fields if not f.omit and f.name not in df.columns]


@dataclass
class FittedSpec:
    """Constants learned on training data; scoring and streams reuse them unchanged."""

    spec: DatasetSpec
    fill: dict[str, Any] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)    # (shift, divisor)
    domains: dict[str, list] = field(default_factory=dict)                 # small ordered domains
    lookups: dict[str, DataFrame] = field(default_factory=dict)            # larger domains and group statistics
    bins: dict[str, tuple[float, float]] = field(default_factory=dict)     # (minimum, width)
    dropped: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class ViewSpec:
    """A saved aggregate view."""

    dim: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    agg: str = "sum"
    prec: int | None = None
    filter: dict = field(default_factory=dict)
    sorter: tuple[tuple[str, str], ...] = ()
    calculation: dict[str, str] = field(default_factory=dict)   # new column -> SQL expression
    variable: dict[str, Any] = field(default_factory=dict)      # named values usable in the calculation
