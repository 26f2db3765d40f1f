"""The contract of operators that learn something before they transform, and their registries."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


class Fitted:
    """What an operator learned; :meth:`transform` is lazy."""

    def __init__(self, apply: Callable[[DataFrame], DataFrame], **state: Any) -> None:
        self._apply, self.state = apply, state

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df)


class Operator:
    """``fit`` runs one aggregate job at most."""

    def fit(self, df: DataFrame) -> Fitted:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Registry:
    """Names to constructors; an unknown name raises KeyError and says what there is."""

    def __init__(self, kind: str) -> None:
        self.kind, self.made = kind, {}

    def register(self, *names: str):
        def add(made):
            for n in names:
                self.made[n] = made
            return made

        return add

    def create(self, name: str, **params: Any):
        if name not in self.made:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.made))}")
        return self.made[name](**params)


IMPUTERS, SCALERS, ENCODERS = Registry("imputer"), Registry("scaler"), Registry("encoder")
VECTORIZERS, REDUCERS, SAMPLERS = Registry("vectorizer"), Registry("reducer"), Registry("sampler")
MODELS, EVALUATORS, PROFILES = Registry("model"), Registry("evaluator"), Registry("profile")
CHARTS, EXPERIMENTS = Registry("chart"), Registry("experiment")
