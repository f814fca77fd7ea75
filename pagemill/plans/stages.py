"""Extension surface: named stages around a pipeline, registries of extractors, chunkers and models."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import extraction_prompt, truncate_prompt
from pagemill.operators.chunking import chunker
from pagemill.operators.merge import merged_json

Stage = Callable[[DataFrame], DataFrame]
EVENTS = ("before_fetch", "after_fetch", "before_clean", "after_clean", "before_extract", "after_extract", "before_store", "after_store", "on_start", "on_end")


class Hooks:
    """Stages registered for events; fire applies them in order of registration."""

    def __init__(self) -> None:
        self._stages: dict[str, list[Stage]] = {e: [] for e in EVENTS}

    def register(self, event: str, stage: Stage) -> None:
        if event not in self._stages:
            raise ValueError(f"unknown event: {event}")
        self._stages[event].append(stage)

    def unregister(self, event: str, stage: Stage) -> None:
        if stage in self._stages.get(event, ()):
            self._stages[event].remove(stage)

    def clear(self, event: str | None = None) -> None:
        for e in EVENTS if event is None else (event,):
            self._stages[e] = []

    def fire(self, event: str, df: DataFrame) -> DataFrame:
        for stage in self._stages[event]:
            df = df.transform(stage)
        return df

    def load(self, plugins: Iterable[Any]) -> None:
        """Register every method of a plugin that is named as an event."""
        for plugin in plugins:
            for event in EVENTS:
                if callable(method := getattr(plugin, event, None)):
                    self.register(event, method)


class Registry:
    """Named factories, for extractors, stores and url filters of one's own."""

    def __init__(self, **known: Callable[..., Any]) -> None:
        self._known = dict(known)

    def add(self, name: str, factory: Callable[..., Any]) -> None:
        self._known[name] = factory

    def make(self, name: str, *args: Any, **options: Any) -> Any:
        if name not in self._known:
            raise ValueError(f"unknown name: {name}; known: {sorted(self._known)}")
        return self._known[name](*args, **options)


def extract_with_model(content: Column, task: Column, model: Callable[[str], str], strategy: str = "fixed", size: int = 4000, overlap: int = 200, limit: int = 100_000) -> Column:
    """JSON that a model gives for the content, piece by piece, merged. A piece that fails is passed over."""

    def one(prompts: Any) -> list[str | None] | None:
        if prompts is None:
            return None
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(model(p))
            except Exception:  # the model is the caller's; one piece must not fail the row
                out.append(None)
        return out

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in series], dtype=object)

    pieces = chunker(strategy, size, overlap)(content)
    prompts = F.transform(pieces, lambda p: truncate_prompt(extraction_prompt(p, task), limit))
    return merged_json(F.pandas_udf(run, T.ArrayType(T.StringType()))(prompts))
