"""What a weights table looks like and which way its weights are normalised."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = {"extensive": "per_source", "intensive": "per_destination", "ratio": "per_source"}


@dataclass(frozen=True)
class SourceUnits:
    """Key and descriptive columns of the source side."""

    keys: tuple[str, ...]
    meta: tuple[str, ...] = ()
    key_type: T.DataType = field(default_factory=T.StringType)
    meta_type: T.DataType = field(default_factory=T.DoubleType)


GRID_CELLS = SourceUnits(("cell_ix", "cell_iy"), ("cell_lon", "cell_lat"), T.LongType())


def family(kind: T.DataType) -> str:
    """Types that may stand for each other: integers of any width, floats of any width, strings."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    return kind.typeName()


@dataclass(frozen=True)
class OutputSchema:
    """Target ids, source units, weight names and normalisation: they fix columns, types and the group that sums to one."""

    id_fields: tuple[str, ...]
    weights: tuple[str, ...]
    source: SourceUnits = GRID_CELLS
    normalization: str = "per_destination"

    def __post_init__(self):
        if self.normalization not in ("per_source", "per_destination"):
            raise ValueError(f"normalization must be per_source or per_destination, not {self.normalization!r}")

    @property
    def group(self) -> tuple[str, ...]:
        return self.source.keys if self.normalization == "per_source" else self.id_fields

    @property
    def struct(self) -> T.StructType:
        out = T.StructType([T.StructField(c, T.StringType()) for c in self.id_fields])
        for c in self.source.keys:
            out.add(c, self.source.key_type)
        for c in self.source.meta:
            out.add(c, self.source.meta_type)
        for w in self.weights:
            out.add(f"{w}wt", T.DoubleType()).add(f"{w}_raw", T.DoubleType()).add(f"{w}_method", T.StringType())
        return out

    @property
    def columns(self) -> list[str]:
        return self.struct.fieldNames()

    def validate(self, df: DataFrame) -> None:
        have = {f.name: f.dataType for f in df.schema.fields}
        missing = [c for c in self.columns if c not in have]
        if missing:
            raise ValueError(f"weights lack columns {missing}")
        wrong = [(f.name, have[f.name].simpleString()) for f in self.struct.fields if family(have[f.name]) != family(f.dataType) and f.name not in self.id_fields]
        if wrong:
            raise ValueError(f"weights have columns of other types: {wrong}")

    def check_kind(self, kind: str) -> None:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}, not {kind!r}")
        if KINDS[kind] != self.normalization:
            raise ValueError(f"{kind} data need {KINDS[kind]} weights; these are {self.normalization}")


@dataclass
class WeightsArtifact:
    """A weights table with the versions of the geometry on both sides."""

    frame: DataFrame
    schema: OutputSchema
    regions_version: str | None = None
    source_version: str | None = None
    partial_coverage: int | None = None
    manifest: dict = field(default_factory=dict)
