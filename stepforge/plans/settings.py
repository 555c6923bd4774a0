"""Search and rerank settings with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = {"llm": ("llm",), "ltr": ("ltr",), "cascade": ("ltr", "llm"), "llm_then_ltr_with_llm_features": ("llm", "ltr")}


@dataclass(frozen=True)
class SearchSettings:
    """Filters of a memory search: equality on fields, and how far a row may share the query's task and variation."""

    base: dict = field(default_factory=dict)
    diversity: str | None = None
    top_k: int = 100

    def condition(self, task=None, variation=None) -> Column:
        out = F.lit(True)
        for name, value in self.base.items():
            if value is not None:
                out = out & (F.col(name) == F.lit(value))
        kind = self.diversity or "none"
        if kind in ("none", "any", ""):
            return out
        if task is None or ("variation" in kind and variation is None):
            raise ValueError(f"{kind} needs the query's task and variation")
        t, v = F.col("task_name"), F.col("variation_idx")
        rules = {"different_task_or_variation": (t != task) | (v != variation), "different_task": t != task, "same_task": t == task, "same_task_different_variation": (t == task) & (v != variation), "same_task_same_variation": (t == task) & (v == variation)}
        if kind not in rules:
            raise ValueError(f"unknown diversity strategy {kind!r}")
        return out & rules[kind]


def stages(mode: str, sizes: list[int], candidates: int) -> list[tuple[str, int]]:
    """(reranker, prefix) of each stage, prefixes cut to the number of candidates."""
    if mode not in MODES:
        raise ValueError(f"unknown rerank mode {mode!r}")
    sizes = [20, 10] if mode == "llm_then_ltr_with_llm_features" else sizes
    return [(kind, min(n, candidates)) for kind, n in zip(MODES[mode], sizes, strict=True)]
