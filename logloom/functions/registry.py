"""Named operators: look an estimator up by name and hand it only what it takes."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

_known: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make a function ``(DataFrame, **options) -> DataFrame`` known by ``name``; a taken name is refused."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _known.get(name, f) is not f:
            raise ValueError(f"{name} is taken")
        _known[name] = f
        return f

    return keep


def call(name: str, df: DataFrame, **options: Any) -> DataFrame:
    """Run the function of that name with those options that it declares."""
    if name not in _known:
        raise KeyError(f"unknown estimator {name}; known: {', '.join(sorted(_known))}")
    f = _known[name]
    taken = inspect.signature(f).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in taken.values())
    return f(df, **{k: v for k, v in options.items() if every or k in taken})
