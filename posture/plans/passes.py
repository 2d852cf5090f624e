"""Registry of evidence passes. A metric is named ``<pass>.<measurement>``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from posture.operators.evidence import Pass
from posture.operators.run import Run


@dataclass(frozen=True)
class PassSpec:
    name: str
    source: str
    scoped: bool
    build: Callable[[Run], Pass]
    #: Metrics of a scoped pass that do not need the scope.
    unscoped: frozenset[str] = frozenset()

    def needs_scope(self, metric: str) -> bool:
        return self.scoped and metric not in self.unscoped


PASSES: dict[str, PassSpec] = {}


def evidence(name: str, source: str, scoped: bool = False, unscoped: Iterable[str] = ()):
    """Register the builder of the pass over a source, which is scanned once."""

    def register(build: Callable[[Run], Pass]):
        if name in PASSES:
            raise ValueError(f"pass {name} is defined twice")
        if any(p.source == source for p in PASSES.values()):
            raise ValueError(f"{source} has a pass already")
        PASSES[name] = PassSpec(name, source, scoped, build, frozenset(unscoped))
        return build

    return register


def pass_of(metric: str) -> PassSpec:
    return PASSES[metric.split(".", 1)[0]]
