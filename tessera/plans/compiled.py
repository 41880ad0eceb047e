"""Compiled queries: functions of parameters that build a query, and plans chosen by a parameter's value."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from typing import Any

from tessera.operators.query import Query


class Compiled:
    """A query or a function of parameters to one.  It is applied as often as wanted; ``extract`` gives it back."""

    def __init__(self, build: Query | Callable[..., Query]):
        self._build = build

    def __call__(self, *params: Any) -> Query:
        return self._build(*params) if callable(self._build) else self._build

    @property
    def extract(self) -> Query | Callable[..., Query]:
        return self._build

    def map(self, f: Callable[[Query], Query]) -> Compiled:
        """Another compiled query of the same parameters."""
        return Compiled(lambda *params: f(self(*params)))

    def flat_map(self, f: Callable[[Query], Compiled]) -> Compiled:
        """The compiled query that ``f`` gives for this one's query; it takes the same parameters, or none."""

        def build(*params: Any) -> Query:
            inner = f(self(*params))
            made = inner.extract
            takes = callable(made) and any(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD, p.VAR_POSITIONAL) for p in signature(made).parameters.values())
            return inner(*params) if takes else inner()

        return Compiled(build)


def switch(choices: list[tuple[Callable[[Any], bool], Callable[[Any], Query]]], default: Callable[[Any], Query]) -> Compiled:
    """The first plan whose condition holds for the parameter."""
    return Compiled(lambda p: next((plan for holds, plan in choices if holds(p)), default)(p))
