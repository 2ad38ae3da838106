"""Extensions by name with declared capabilities; nothing is allowed that is not granted.

A processor maps events to events, a detector maps them to alerts, a correlator maps alerts and
events to alerts, a storage plugin takes events and keeps them, a selector picks a path through
a campaign's graph, an embedder or scorer is a model by contract. A plugin that may read certain
fields only is given a view that holds no others.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.schema import ALERT

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Manifest:
    name: str
    kind: str  # processor, detector, correlator, selector, storage, embedder, scorer
    capabilities: tuple[str, ...] = ()


class CapabilityError(PermissionError):
    pass


def allows(granted: str, wanted: str) -> bool:
    """``read:field:*`` grants every ``read:field:…``; otherwise names are equal."""
    return granted == wanted or (granted.endswith("*") and wanted.startswith(granted[:-1]))


class Registry:
    def __init__(self, policy: dict[str, list[str]] | None = None):
        self.policy = policy or {}
        self.items: dict[str, tuple[Manifest, Callable]] = {}

    def register(self, manifest: Manifest, run: Callable) -> None:
        granted = self.policy.get(manifest.kind, [])
        for c in manifest.capabilities:
            if c.startswith("net:") and manifest.kind == "processor":
                raise CapabilityError(f"{manifest.name}: processors never reach the network")
            if not any(allows(g, c) for g in granted):
                raise CapabilityError(f"{manifest.name}: {c} is not granted")
        self.items[manifest.name] = (manifest, run)

    def apply(self, names: list[str], events: DataFrame) -> DataFrame:
        """Runs processors in order; unknown names are skipped with a warning."""
        for n in names:
            if n not in self.items:
                log.warning("unknown processor %s is skipped", n)
                continue
            manifest, run = self.items[n]
            events = run(self._view(manifest, events))
        return events

    def _known(self, name: str, kind: str) -> tuple[Manifest, Callable]:
        manifest, run = self.items[name]
        if manifest.kind != kind:
            raise ValueError(f"{name} is a {manifest.kind}, not a {kind}")
        return manifest, run

    def detect(self, names: list[str], events: DataFrame) -> DataFrame:
        """Alerts of detectors, each under its own name unless it names a rule."""
        out = events.sparkSession.createDataFrame([], ALERT)
        for n in names:
            manifest, run = self._known(n, "detector")
            found = run(self._view(manifest, events))
            lacking = {f.name: F.lit(None).cast(f.dataType) for f in ALERT if f.name not in found.columns}
            if "rule_id" in lacking:
                lacking["rule_id"] = F.lit(n)
            if "events" in lacking and "id" in found.columns:
                lacking["events"] = F.array("id")
            out = out.unionByName(found.withColumns(lacking).select(*ALERT.fieldNames()))
        return out

    def correlate(self, names: list[str], alerts: DataFrame, events: DataFrame) -> DataFrame:
        """The alerts with those that correlators make of them."""
        out = alerts
        for n in names:
            manifest, run = self._known(n, "correlator")
            out = out.unionByName(run(alerts, self._view(manifest, events)).select(*ALERT.fieldNames()))
        return out

    def keep(self, names: list[str], events: DataFrame) -> None:
        """Gives events to storage plugins."""
        for n in names:
            manifest, run = self._known(n, "storage")
            run(self._view(manifest, events))

    def selector(self, name: str) -> Callable:
        """A path selector, to be passed to ``campaigns.chains``."""
        return self._known(name, "selector")[1]

    def model(self, name: str, kind: str) -> Callable:
        """An ``embedder`` or ``scorer``, to be passed to ``models.embed`` or ``models.score``."""
        return self._known(name, kind)[1]

    @staticmethod
    def _view(manifest: Manifest, events: DataFrame) -> DataFrame:
        fields = [c.split(":", 2)[2] for c in manifest.capabilities if c.startswith("read:field:")]
        if not fields or "*" in fields or "fields_json" not in events.columns:
            return events
        kept = F.map_filter(F.from_json("fields_json", "map<string,string>"), lambda k, _: k.isin(fields))
        return events.withColumn("fields_json", F.to_json(kept))


def builtin() -> Registry:
    """The processors that come with the engine."""
    from huntframe.functions import enrich

    r = Registry({"processor": ["read:field:*", "enrich:*"]})
    r.register(Manifest("redact", "processor", ("read:field:*",)), enrich.redact_events)
    r.register(Manifest("entropy", "processor", ("read:field:*", "enrich:dga")), enrich.with_entropy)
    return r


def routed(events: DataFrame, pipelines: list[dict], sink: str) -> DataFrame:
    """Events of the inputs whose pipelines lead to a sink; the index takes all if none does."""
    inputs = sorted({i for p in pipelines if sink in p.get("route", []) for i in p.get("inputs", [])})
    if not inputs:
        return events if sink == "index" else events.where(F.lit(False))
    return events.where(F.col("input_id").isin(inputs))
