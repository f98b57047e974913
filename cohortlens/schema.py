"""The tables of the data model.

``expr`` holds no zeros: means over cells divide by the number of cells, and
empty cells and genes survive only by joins from ``cells`` and ``genes``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.errors import InputError, SampleError
from cohortlens.storage import stored

CELLS = "sample_id string, cell_id string, cell_pos long, lineage string"
#: A gene table may have ``gene_symbol``, too.
GENES = "gene_id string, gene_pos int"
EXPR = "sample_id string, cell_id string, gene_id string, value double"
PROGRAMS = "sample_id string, program_idx int, gene_id string, gene_pos int, weight double"


@dataclass(frozen=True)
class Cohort:
    """Cells of several samples, a gene axis, the non-zero values, and further layers of values by name."""

    cells: DataFrame
    genes: DataFrame
    expr: DataFrame
    layers: Mapping[str, DataFrame] = field(default_factory=dict)

    def with_(self, **tables: DataFrame) -> Cohort:
        return replace(self, **tables)

    def _each(self, change) -> dict:
        return {"expr": change(self.expr), "layers": {k: change(v) for k, v in self.layers.items()}}

    def matrix(self, layer: str | None = None) -> Cohort:
        """The cohort with a layer's values for its own; without a name, as it is."""
        if layer is None:
            return self
        if layer not in self.layers:
            raise InputError(f"no layer {layer!r}; there are {sorted(self.layers)}")
        return self.with_(expr=self.layers[layer])

    def kept_cells(self, ids: DataFrame) -> Cohort:
        """Only the cells of ``ids`` (sample_id, cell_id)."""
        on = ["sample_id", "cell_id"]
        return self.with_(cells=self.cells.join(ids, on, "left_semi"), **self._each(lambda x: x.join(ids, on, "left_semi")))

    def kept_genes(self, ids: DataFrame) -> Cohort:
        return self.with_(genes=self.genes.join(ids, "gene_id", "left_semi"), **self._each(lambda x: x.join(ids, "gene_id", "left_semi")))

    def kept_samples(self, ids: list[str]) -> Cohort:
        here = F.col("sample_id").isin(ids)
        return self.with_(cells=self.cells.where(here), **self._each(lambda x: x.where(here)))

    def known_samples(self, ids: list[str]) -> Cohort:
        """As ``kept_samples``, but ids without a cell raise."""
        out = self.kept_samples(ids)
        if unknown := set(ids) - {r[0] for r in out.cells.select("sample_id").distinct().collect()}:
            raise SampleError(f"unknown samples {sorted(unknown)}")
        return out

    def symbols(self) -> Column:
        """What a gene is called: its symbol, or its id."""
        return F.coalesce("gene_symbol", "gene_id") if "gene_symbol" in self.genes.columns else F.col("gene_id")

    def stored(self) -> Cohort:
        """The cohort as tables on the shared folder, so that each is computed once."""
        return self.with_(cells=stored(self.cells), genes=stored(self.genes), **self._each(stored))
