"""The metrics of an evaluation and the columns that they fill."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from fluxlake.functions.registry import EVENT_KEYS, REGRESSION_KEYS, Shelf
from fluxlake.functions.regression import REGRESSION_METRICS
from fluxlake.functions.scores import EVENT_SCORES, EXTRA_SCORES


@dataclass(frozen=True)
class MetricSet:
    events: Shelf
    regressions: Shelf

    def with_event(self, name: str, fn: Callable, larger_is_better: bool = False) -> MetricSet:
        return replace(self, events=self.events.plus(name, fn, larger_is_better))

    def with_regression(self, name: str, fn: Callable, space: str = "log", larger_is_better: bool = False) -> MetricSet:
        return replace(self, regressions=self.regressions.plus(name, fn, larger_is_better, space=space))

    def chosen(self, names: Iterable[str] | None) -> frozenset[str]:
        """The names to compute: all, or those given, which must be known."""
        known = {*self.events, *self.regressions}
        if names is None:
            return frozenset(known)
        if strangers := set(names) - known:
            raise KeyError(f"no metric is called {', '.join(sorted(strangers))}")
        return frozenset(names)

    @property
    def event_columns(self) -> list[str]:
        return [*EVENT_KEYS, *(n for n in self.events if n not in EVENT_KEYS)]

    @property
    def regression_columns(self) -> list[str]:
        return [*REGRESSION_KEYS, *(n for n in self.regressions if n not in REGRESSION_KEYS)]

    def ascends(self, column: str) -> bool:
        """Whether small values lead; ``column`` is a metric, or a metric and a channel."""
        name = column.partition("_")[0]
        for shelf in (self.events, self.regressions, EXTRA_SCORES):
            if name in shelf:
                return not shelf[name].larger_is_better
        return True


STANDARD = MetricSet(EVENT_SCORES, REGRESSION_METRICS)
