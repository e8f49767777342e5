"""Clustering parameters: presets, suggestions, validation, environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

ALGORITHMS = ("hdbscan", "kmeans")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie within {low} and {high}, not {value}")


@dataclass(frozen=True)
class ClusteringParameters:
    min_cluster_size: int = 10
    cluster_selection_epsilon: float = 0.5
    max_clusters: int = 20
    algorithm: str = "hdbscan"
    expected_cluster_range: tuple[int, int] = (3, 15)

    def __post_init__(self):
        _within("min_cluster_size", self.min_cluster_size, 2, 100)
        _within("cluster_selection_epsilon", self.cluster_selection_epsilon, 0.1, 2.0)
        _within("max_clusters", self.max_clusters, 2, 50)
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"Unsupported clustering algorithm: {self.algorithm}")


#: Fixed values.
PRESETS = {
    "conservative": ClusteringParameters(15, 0.8, 10, "hdbscan", (2, 8)),
    "balanced": ClusteringParameters(10, 0.5, 15, "hdbscan", (3, 12)),
    "aggressive": ClusteringParameters(5, 0.3, 25, "hdbscan", (5, 20)),
    "kmeans_focused": ClusteringParameters(8, 0.5, 12, "kmeans", (4, 15)),
}
#: Model aliases.
MODELS = {
    "text-embedding-3-small": "all-MiniLM-L6-v2",
    "all-MiniLM-L6-v2": "all-MiniLM-L6-v2",
    "bge-m3": "BAAI/bge-m3",
    "BAAI/bge-m3": "BAAI/bge-m3",
}


def preset(name: str = "balanced") -> ClusteringParameters:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def suggest_parameters(rows: int) -> ClusteringParameters:
    """By the number of rows; the least cluster size stays within its own limit."""
    for below, name in ((20, "conservative"), (100, "balanced"), (500, "aggressive")):
        if rows < below:
            return preset(name)
    return ClusteringParameters(min(100, max(10, rows // 50)), 0.6, min(30, rows // 10), "hdbscan")


def suggested(rows: Column) -> dict[str, Column]:
    """suggest_parameters as expressions, for a count by group."""
    pick = lambda a, b, c, rest: F.when(rows < 20, a).when(rows < 100, b).when(rows < 500, c).otherwise(rest)
    per = lambda n: F.floor(rows / n)
    return {
        "min_cluster_size": pick(15, 10, 5, F.least(F.lit(100), F.greatest(F.lit(10), per(50)))).cast("int"),
        "cluster_selection_epsilon": pick(0.8, 0.5, 0.3, F.lit(0.6)).cast("double"),
        "max_clusters": pick(10, 15, 25, F.least(F.lit(30), per(10))).cast("int"),
    }


#: What validate looks for: (test of parameters and rows, issue or None, advice).
_CHECKS = (
    (lambda c, n: n is not None and c.min_cluster_size > n // 2, "min_cluster_size leaves most rows as noise", lambda n: f"a min_cluster_size near {n // 10} suits {n} rows"),
    (lambda c, n: c.algorithm == "kmeans" and c.max_clusters < 3, "k-means has too few clusters to choose from", lambda n: "raise max_clusters to 3 or more"),
    (lambda c, n: c.cluster_selection_epsilon > 1.0, None, lambda n: "an epsilon above 1 may join different clusters"),
)


def validate(config: ClusteringParameters, rows: int | None = None) -> dict:
    """valid, issues, suggestions."""
    hit = [(issue, advice(rows)) for test, issue, advice in _CHECKS if test(config, rows)]
    issues = [issue for issue, _ in hit if issue]
    return {"valid": not issues, "issues": issues, "suggestions": [advice for _, advice in hit]}


def from_env() -> ClusteringParameters:
    return ClusteringParameters(int(os.getenv("MIN_CLUSTER_SIZE", "10")), float(os.getenv("CLUSTER_SELECTION_EPSILON", "0.5")), int(os.getenv("MAX_CLUSTERS", "20")), os.getenv("CLUSTERING_ALGORITHM", "hdbscan"))


def with_changes(config: ClusteringParameters, **changes) -> ClusteringParameters:
    return replace(config, **changes)


def batch_size(average_length: float | None, model: str = "all-MiniLM-L6-v2", most: int = 64) -> int:
    """Rows that go to the embedder at once; no rows (None): the most."""
    if average_length is None:
        return most
    kb = 1.5 if model in ("all-MiniLM-L6-v2", "text-embedding-3-small") else 4
    factor = 0.5 if average_length > 500 else 0.75 if average_length > 200 else 1.0
    return max(8, min(most, int(max(1, int(256 * 1024 / (kb * 2))) * factor)))


def batch_size_column(average_length: Column, kb: float = 1.5, most: int = 64) -> Column:
    factor = F.when(average_length > 500, 0.5).when(average_length > 200, 0.75).otherwise(1.0)
    size = F.floor(F.lit(float(max(1, int(256 * 1024 / (kb * 2))))) * factor)
    return F.coalesce(F.greatest(F.lit(8), F.least(F.lit(most), size)), F.lit(most)).cast("int")
