"""The cohort: pixels, their features, and how they came about."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomill.errors import InvalidParameterError, require_column

VALUES = "values"
#: Columns of ``pixels`` that are not observations about them.
STRUCTURAL = ("section", "pixel_id", "x", "y", VALUES)


@dataclass(frozen=True)
class Cohort:
    """``pixels(section, pixel_id, x, y, ..., values array<double>)``, the names of the values in
    order, columns about the features, and the steps so far. Every operator returns a new one."""

    pixels: DataFrame
    names: tuple[str, ...]
    about: dict[str, tuple] = field(default_factory=dict)
    steps: tuple[str, ...] = ()

    def with_pixels(self, pixels: DataFrame, step: str = "", **parameters) -> Cohort:
        made = replace(self, pixels=pixels)
        return made.record(step, parameters) if step else made

    def record(self, step: str, parameters: dict) -> Cohort:
        """Append a step to the provenance."""
        entry = json.dumps({"step": step, "params": {k: str(v) for k, v in parameters.items()}, "at": datetime.now(UTC).isoformat()})
        return replace(self, steps=(*self.steps, entry))

    def provenance(self) -> list[dict]:
        """The steps; entries that are no JSON objects are kept as names of steps."""
        out = []
        for s in self.steps:
            try:
                entry = json.loads(s)
            except ValueError:
                entry = s
            out.append(entry if isinstance(entry, dict) else {"step": str(entry), "params": {}, "at": None})
        return out

    def select_features(self, keep: Sequence[int]) -> Cohort:
        """Only the features at these places, in this order."""
        if not keep:
            raise InvalidParameterError("No feature is left.")
        chosen = F.array(*[F.get(VALUES, F.lit(int(i))) for i in keep])
        arrays = {c: F.array(*[F.get(c, F.lit(int(i))) for i in keep]) for c in self.pixels.columns if c.startswith(VALUES + "_")}
        pixels = self.pixels.withColumns({VALUES: chosen, **arrays})
        return replace(
            self, pixels=pixels, names=tuple(self.names[i] for i in keep), about={k: tuple(v[i] for i in keep) for k, v in self.about.items()}
        )

    def describe_features(self, name: str, values: Sequence) -> Cohort:
        if len(values) != len(self.names):
            raise InvalidParameterError(f"'{name}' has {len(values)} values for {len(self.names)} features.")
        return replace(self, about={**self.about, name: tuple(values)})

    def features(self) -> DataFrame:
        """``feature_idx, metabolite`` and the columns about features. A panel's size."""
        spark = self.pixels.sparkSession
        kinds = {k: "double" if all(v is None or isinstance(v, (int, float)) for v in c) else "string" for k, c in self.about.items()}
        rows = [
            (i, n, *(float(c[i]) if kinds[k] == "double" and c[i] is not None else c[i] for k, c in self.about.items()))
            for i, n in enumerate(self.names)
        ]
        return spark.createDataFrame(rows, "feature_idx int, metabolite string" + "".join(f", `{k}` {t}" for k, t in kinds.items()))

    def index_of(self, metabolite: str) -> int:
        require_column(self.names, metabolite)
        return self.names.index(metabolite)

    def layer(self, name: str | None = None) -> str:
        """Column of a layer: ``values`` itself, or ``values_<name>``."""
        column = f"{VALUES}_{name}" if name else VALUES
        require_column(self.pixels.columns, column)
        return column

    def analysis_layer(self) -> str:
        """The ``log1p`` layer where there is one, else the values."""
        return f"{VALUES}_log1p" if f"{VALUES}_log1p" in self.pixels.columns else VALUES

    def long(self, *keep: str, layer: str | None = None) -> DataFrame:
        """``keep..., feature_idx, value``: a row a pixel and feature."""
        return self.pixels.select(*keep, F.posexplode(layer or VALUES).alias("feature_idx", "value"))

    def named(self, table: DataFrame) -> DataFrame:
        """``table`` with ``metabolite`` in place of ``feature_idx``."""
        return table.join(F.broadcast(self.features().select("feature_idx", "metabolite")), "feature_idx").drop("feature_idx")

    def observations(self) -> list[str]:
        return [c for c in self.pixels.columns if c not in STRUCTURAL and not c.startswith(VALUES + "_")]
