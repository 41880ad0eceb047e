"""Actions: side effects as values that are composed first and run later."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import SparkSession


class Action:
    """Something to do with a session.  ``effects`` say what kind it is: read, write, schema, transactional."""

    def __init__(self, do: Callable[[SparkSession], Any], effects: Iterable[str] = (), name: str = ""):
        self._do, self.effects, self.name = do, frozenset(effects), name

    def run(self, spark: SparkSession) -> Any:
        return self._do(spark)

    def _then(self, do: Callable[[SparkSession], Any], *others: Action) -> Action:
        return Action(do, self.effects.union(*(o.effects for o in others)), self.name)

    def map(self, f: Callable[[Any], Any]) -> Action:
        return self._then(lambda s: f(self.run(s)))

    def flat_map(self, f: Callable[[Any], Action]) -> Action:
        return self._then(lambda s: f(self.run(s)).run(s))

    def and_then(self, other: Action) -> Action:
        """Both, with the second one's result."""
        return self._then(lambda s: (self.run(s), other.run(s))[1], other)

    __rshift__ = and_then

    def zip(self, other: Action) -> Action:
        return self._then(lambda s: (self.run(s), other.run(s)), other)

    def zip_with(self, other: Action, f: Callable[[Any, Any], Any]) -> Action:
        return self.zip(other).map(lambda pair: f(*pair))

    def and_finally(self, other: Action) -> Action:
        """``other`` runs afterwards, whether this one fails or not; an error of this one wins."""

        def do(s: SparkSession) -> Any:
            try:
                out = self.run(s)
            except Exception:
                try:
                    other.run(s)
                except Exception:  # noqa: S110  the first error is the one that is told
                    pass
                raise
            other.run(s)
            return out

        return self._then(do, other)

    def clean_up(self, f: Callable[[Exception | None], Action], keep_failure: bool = True) -> Action:
        """``f`` gets the error, or None, and says what to do then."""

        def do(s: SparkSession) -> Any:
            try:
                out = self.run(s)
            except Exception as e:
                try:
                    f(e).run(s)
                except Exception:
                    if not keep_failure:
                        raise
                raise
            f(None).run(s)
            return out

        return self._then(do)

    def filter(self, p: Callable[[Any], bool]) -> Action:
        def do(s: SparkSession) -> Any:
            out = self.run(s)
            if not p(out):
                raise LookupError("the result was filtered out")
            return out

        return self._then(do)

    def collect(self, f: dict[Any, Any] | Callable[[Any], Any]) -> Action:
        """``f`` of the result where it is defined (a KeyError says it isn't)."""
        return self.map(f.__getitem__ if isinstance(f, dict) else f)

    def void(self) -> Action:
        return self.map(lambda _: None)

    def as_(self, value: Any) -> Action:
        return self.map(lambda _: value)

    def failed(self) -> Action:
        """The error as the result; without one it is an error."""

        def do(s: SparkSession) -> Exception:
            try:
                self.run(s)
            except Exception as e:
                return e
            raise LookupError("the action didn't fail")

        return self._then(do)

    def as_try(self) -> Action:
        """(True, result) or (False, error)."""

        def do(s: SparkSession) -> tuple[bool, Any]:
            try:
                return True, self.run(s)
            except Exception as e:
                return False, e

        return self._then(do)

    def named(self, name: str) -> Action:
        return Action(self._do, self.effects, name)

    def with_pinned_session(self) -> Action:
        """An action runs on one session anyway."""
        return self

    def transactionally(self) -> Action:
        """Every write is one commit of its files; more than that files don't offer."""
        return Action(self._do, self.effects | {"transactional"}, self.name)

    def in_pool(self, pool: str) -> Action:
        """Run with the jobs of a scheduler pool, which bounds what runs at once."""

        def do(s: SparkSession) -> Any:
            s.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            try:
                return self.run(s)
            finally:
                s.sparkContext.setLocalProperty("spark.scheduler.pool", None)

        return self._then(do)


def successful(value: Any) -> Action:
    return Action(lambda _: value)


def failed(error: Exception) -> Action:
    def do(_: SparkSession) -> Any:
        raise error

    return Action(do)


unit = successful(None)


def lift(f: Callable[[], Any]) -> Action:
    """What ``f`` gives when the action runs."""
    return Action(lambda _: f())


def raw(f: Callable[[SparkSession], Any]) -> Action:
    """Anything with the session."""
    return Action(f, ("read", "write", "schema", "transactional"))


def seq(*actions: Action) -> Action:
    """All, one after the other, for their effects."""
    return sequence(actions).void()


def sequence(actions: Iterable[Action]) -> Action:
    todo = list(actions)
    return Action(lambda s: [a.run(s) for a in todo], frozenset().union(*(a.effects for a in todo)))


def sequence_option(action: Action | None) -> Action:
    return action if action is not None else unit


def traverse(values: Iterable[Any], f: Callable[[Any], Action]) -> Action:
    return sequence([f(v) for v in values])


def fold(actions: Iterable[Action], zero: Any, f: Callable[[Any, Any], Any]) -> Action:
    def do(results: list[Any]) -> Any:
        out = zero
        for r in results:
            out = f(out, r)
        return out

    return sequence(actions).map(do)


def result(query: Any) -> Action:
    """The rows of a query."""
    return Action(lambda _: query.result(), ("read",))


def write(df: Any, path: str, mode: str = "append") -> Action:
    """A DataFrame or query as Parquet below ``path``."""
    return Action(lambda _: getattr(df, "df", df).write.mode(mode).parquet(path), ("write",))


def statements(texts: Iterable[str]) -> Action:
    todo = list(texts)
    return Action(lambda s: [s.sql(t) for t in todo] and None, ("schema",))
