"""The registry: what signals, filters, presets and providers an engine knows, and adding to it.

A trajectory is a bundle of payload signals, derived signals, filters, presets, statistics
and a provider that joins its signals onto chunks.  ``Registry.register`` refuses names that
are taken.  ``installed`` puts what is registered where the engine's queries look.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from .plans import catalog, filters, rank, signals


class RegistryError(ValueError):
    pass


@dataclass
class Trajectory:
    name: str
    payload: list[catalog.Signal] = field(default_factory=list)
    derived: dict[str, tuple[catalog.Derived, Callable[[signals.Context], Column]]] = field(default_factory=dict)
    filters: dict[str, Callable] = field(default_factory=dict)
    filter_presets: dict[str, list[catalog.Condition]] = field(default_factory=dict)
    presets: list[catalog.Preset] = field(default_factory=list)
    #: name -> aggregate over chunks, for the collection's statistics
    accumulators: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    #: chunks -> chunks with this trajectory's columns
    provider: Callable[[DataFrame], DataFrame] | None = None
    #: language -> text -> chunks of one file
    chunkers: dict[str, Callable[[str], list[dict]]] = field(default_factory=dict)


class Registry:
    """Trajectories by name; nothing may be named twice, not even by the engine itself."""

    def __init__(self):
        self.trajectories: dict[str, Trajectory] = {}

    def _taken(self) -> dict[str, set[str]]:
        of = lambda f: {x for t in self.trajectories.values() for x in f(t)}
        return {
            "payload signal": set(catalog.SIGNALS) | of(lambda t: [s.key for s in t.payload]), "derived signal": set(catalog.DERIVED) | of(lambda t: t.derived), "filter": set(filters.PARAMETERS) | of(lambda t: t.filters),
            "filter preset": set(catalog.FILTER_PRESETS) | of(lambda t: t.filter_presets), "preset": {p.name for p in catalog.ALL_PRESETS} | of(lambda t: [p.name for p in t.presets]), "accumulator": of(lambda t: t.accumulators), "chunker": of(lambda t: t.chunkers),
        }

    def register(self, t: Trajectory) -> None:
        if t.name in self.trajectories:
            raise RegistryError(f"trajectory {t.name} is registered")
        new = {"payload signal": [s.key for s in t.payload], "derived signal": list(t.derived), "filter": list(t.filters), "filter preset": list(t.filter_presets), "preset": [p.name for p in t.presets], "accumulator": list(t.accumulators), "chunker": list(t.chunkers)}
        taken = self._taken()
        for kind, names in new.items():
            if clash := sorted(set(names) & taken[kind]) or sorted({n for n in names if names.count(n) > 1}):
                raise RegistryError(f"{kind} {clash[0]} is registered")
        known = taken["derived signal"] | set(t.derived)
        for p in t.presets:
            if unknown := set(p.weights) - known:
                raise RegistryError(f"preset {p.name} weighs unknown signals {sorted(unknown)}")
        self.trajectories[t.name] = t
        try:
            validate({s.key: s for x in self.trajectories.values() for s in x.payload} | catalog.SIGNALS, {n: c for x in self.trajectories.values() for n, c in x.filter_presets.items()} | catalog.FILTER_PRESETS)
        except RegistryError:
            del self.trajectories[t.name]
            raise

    @contextmanager
    def installed(self):
        """What is registered, in the engine's own tables, as long as the block lasts."""
        tables = [(catalog.SIGNALS, {s.key: s for t in self.trajectories.values() for s in t.payload}), (catalog.DERIVED, {n: d for t in self.trajectories.values() for n, (d, _) in t.derived.items()}), (signals.SIGNALS, {n: f for t in self.trajectories.values() for n, (_, f) in t.derived.items()}), (filters.PARAMETERS, {n: f for t in self.trajectories.values() for n, f in t.filters.items()}), (catalog.FILTER_PRESETS, {n: c for t in self.trajectories.values() for n, c in t.filter_presets.items()})]
        rows = [catalog.Preset("static", p.name, p.tools, p.level, p.group_by, p.filter, p.weights) for t in self.trajectories.values() for p in t.presets]
        for table, new in tables:
            table.update(new)
        catalog.ALL_PRESETS.extend(rows)
        try:
            yield rank
        finally:
            for table, new in tables:
                for name in new:
                    del table[name]
            for r in rows:
                catalog.ALL_PRESETS.remove(r)

    def enrich(self, chunks: DataFrame) -> DataFrame:
        """Chunks through every provider, in order of registration."""
        for t in self.trajectories.values():
            chunks = t.provider(chunks) if t.provider else chunks
        return chunks

    def accumulate(self, chunks: DataFrame) -> DataFrame:
        """One row of all registered accumulators over the chunks."""
        made = [f(chunks).alias(n) for t in self.trajectories.values() for n, f in t.accumulators.items()]
        return chunks.agg(*made)


def validate(known: dict[str, catalog.Signal] | None = None, presets: dict | None = None) -> None:
    """Every percentile that a filter preset or a label asks for is one that its signal declares to keep."""
    known, presets = known or catalog.SIGNALS, presets or catalog.FILTER_PRESETS
    for name, conditions in presets.items():
        for c in conditions:
            if c.percentile is not None and c.key in known and c.percentile not in known[c.key].percentiles:
                raise RegistryError(f"filter preset {name} asks for p{c.percentile} of {c.key}, which is not kept")
    for key, s in known.items():
        if s.support:
            support = known.get(f"{key.rpartition('.')[0]}.{s.support}")
            for p, _, _ in s.below:
                if support is None or p not in support.percentiles:
                    raise RegistryError(f"labels of {key} ask for p{p} of its support, which is not kept")
