"""Named feature suites: a request becomes a list of columns, so only what is asked for is computed."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

log = logging.getLogger(__name__)

#: The features of the known suites, in their order (fixed values).
SUITES = {
    "mihalcea": ("alliteration", "antonymy", "slang", "content"),
    "yang": ("interpersonal", "phonetic", "incongruity", "ambiguity", "average_vector", "nearest"),
    "cattle_ma": ("perplexity", "embedding", "association", "relations", "anchor_embedding", "anchor_association"),
    "hayashi": ("topics", "vectors", "synsets", "betweenness", "load", "relativity", "lexical"),
}


class Suite:
    """Features by name, each a function that gives ``key`` and columns.

    needs: the models that a feature can't do without; models: those that there are. dims: how many columns a
    feature has, which is checked.
    """

    def __init__(self, key: str, features: Mapping[str, Callable[[], DataFrame]], needs: Mapping[str, Sequence[str]] | None = None, models: Mapping[str, object] | None = None, dims: Mapping[str, int] | None = None):
        self.key, self.features = key, dict(features)
        self.needs, self.models, self.dims = dict(needs or {}), dict(models or {}), dict(dims or {})

    def choose(self, names: Sequence[str] | None = None, in_order: bool = False) -> list[str]:
        """The known features of a request, by name or in the order given.

        Unknown names are ignored with a warning; a request that leaves nothing, or that needs a model which is
        not there, is refused.
        """
        names = list(self.features) if names is None else list(names)
        unknown = [n for n in names if n not in self.features]
        if unknown:
            log.warning("unknown features ignored: %s", unknown)
        chosen = [n for n in dict.fromkeys(names) if n not in unknown]
        if not chosen:
            raise ValueError("no known feature was asked for")
        missing = {n: [m for m in self.needs.get(n, ()) if self.models.get(m) is None] for n in chosen}
        if any(missing.values()):
            raise ValueError(f"models are missing: { {n: m for n, m in missing.items() if m} }")
        return chosen if in_order else sorted(chosen)

    def __call__(self, spine: DataFrame, names: Sequence[str] | None = None, in_order: bool = False) -> DataFrame:
        """Features side by side; missing and non-finite values are 0."""

        def column(name: str) -> DataFrame:
            df = self.features[name]()
            if len(df.columns) - 1 != self.dims.get(name, len(df.columns) - 1):
                raise ValueError(f"{name} has {len(df.columns) - 1} columns, not {self.dims[name]}")
            # a table of one row a key: one plan of all features would take longer to make than to run
            return cut(df.select(self.key, *(F.col(c).cast("double").alias(f"{name}_{c}") for c in df.columns if c != self.key)))

        out = reduce(lambda a, b: a.join(b, self.key, "left"), (column(n) for n in self.choose(names, in_order)), spine.select(self.key))
        fine = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).alias(c)
        return out.select(self.key, *(fine(c) for c in out.columns if c != self.key))


def zeros(spine: DataFrame, key: str, width: int) -> DataFrame:
    """The block that stands for features whose extractor is not there."""
    return spine.select(key, *(F.lit(0.0).alias(f"z{i}") for i in range(width)))


def ablations(rows: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """For each group of columns, the rows without it."""
    return {name: rows.select(*(c for c in rows.columns if c == key or c not in columns)) for name, columns in groups.items()}
