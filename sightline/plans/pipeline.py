"""Evaluations as lists of steps over a catalog of entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.keys import frame_key
from sightline.operators import metrics
from sightline.operators.matching import SCORES, Matcher, evaluate, matched, verdicts
from sightline.sources.scratch import stored


@dataclass
class Catalog:
    """Entities by path; a step's output is an entity like any other, so results can be queried."""

    entities: dict[str, DataFrame] = field(default_factory=dict)
    statics: dict[str, list[DataFrame]] = field(default_factory=dict)
    heirs: dict[str, str] = field(default_factory=dict)

    def put(self, path: str, rows: DataFrame) -> DataFrame:
        self.entities[_clean(path)] = rows
        return rows

    def get(self, path: str) -> DataFrame:
        if _clean(path) not in self.entities:
            raise KeyError(f"no entity {path}")
        return self.entities[_clean(path)]

    def put_static(self, path: str, row: DataFrame) -> None:
        """Columns of one row that hold at all times; a later write of a column wins."""
        self.statics.setdefault(_clean(path), []).append(row)

    def inherit_static(self, path: str, source: str) -> None:
        """``path`` sees what is static at ``source``, now or later; its own columns win."""
        path, at = _clean(path), _clean(source)
        while at:
            if at == path:
                raise ValueError(f"{path} would inherit from itself")
            at = self.heirs.get(at)
        self.heirs[path] = _clean(source)

    def static(self, path: str) -> DataFrame | None:
        """The static row of an entity; more than one row in a write raises when it is read."""
        path = _clean(path)
        writes = [self.static(self.heirs[path])] if path in self.heirs else []
        writes = [w for w in writes + self.statics.get(path, []) if w is not None]
        if not writes:
            return None
        last = {c: i for i, w in enumerate(writes) for c in w.columns}
        one = lambda i, c: F.when(F.count("*") != 1, F.raise_error(F.lit(f"{path}: static columns need one row")).cast(writes[i].schema[c].dataType)).otherwise(F.first(c)).alias(c)
        out = None
        for i, w in enumerate(writes):
            mine = [c for c in w.columns if last[c] == i]
            if mine:
                row = w.agg(*(one(i, c) for c in mine))
                out = row if out is None else out.crossJoin(F.broadcast(row))
        return out

    def view(self, path: str) -> DataFrame:
        """Rows of an entity with its static columns, which win over its own."""
        rows, static = self.get(path), self.static(path)
        return rows if static is None else rows.drop(*static.columns).crossJoin(F.broadcast(static))

    def under(self, prefix: str) -> list[str]:
        p = _clean(prefix)
        return sorted(x for x in self.entities if x == p or x.startswith(p.rstrip("/") + "/"))


def _clean(path: str) -> str:
    parts = path.strip("/").split("/")
    if not all(parts):
        raise ValueError(f"empty part in {path!r}")
    return "/" + "/".join(parts)


@dataclass(frozen=True)
class Step:
    """``run`` gets the entities at ``reads`` and its result goes to ``writes``.

    A ``kept`` result is written to a table once, for results that several steps read.  ``adds`` are
    columns that the result has besides those of its first input, less ``drops``; ``needs`` are
    columns that inputs must have, by place.  Both are checked before anything runs.
    """

    writes: str
    reads: tuple[str, ...]
    run: Callable[..., DataFrame]
    kept: bool = False
    adds: tuple[str, ...] | None = None
    drops: tuple[str, ...] = ()
    needs: tuple[tuple[str, ...], ...] = ()


class Pipeline:
    def __init__(self, steps: list[Step]):
        targets = [_clean(s.writes) for s in steps]
        if len(set(targets)) != len(targets):
            raise ValueError("two steps write one entity")
        for i, step in enumerate(steps):
            if late := [r for r in step.reads if _clean(r) in targets[i:]]:
                raise ValueError(f"{step.writes} reads what only a later step writes: {late}")
        self.steps = steps

    def check(self, catalog: Catalog) -> None:
        """An input, or a column of one, that neither the catalog nor an earlier step gives raises before anything runs."""
        known: dict[str, set[str] | None] = {p: set(rows.columns) for p, rows in catalog.entities.items()}
        for step in self.steps:
            if lost := [r for r in step.reads if _clean(r) not in known]:
                raise KeyError(f"{step.writes} reads what is not there: {lost}")
            for path, columns in zip(step.reads, step.needs):
                has = known[_clean(path)]
                if has is not None and (lost := sorted(set(columns) - has)):
                    raise KeyError(f"{step.writes} needs columns that {path} lacks: {lost}")
            first = known[_clean(step.reads[0])] if step.reads else None
            known[_clean(step.writes)] = None if step.adds is None or first is None else (first | set(step.adds)) - set(step.drops)

    def run(self, catalog: Catalog) -> Catalog:
        self.check(catalog)
        for step in self.steps:
            rows = step.run(*map(catalog.get, step.reads))
            catalog.put(step.writes, stored(rows, "step") if step.kept else rows)
        return catalog


def matching_step(est: str, gt: str, matcher: Matcher, target: str = "/matching") -> list[Step]:
    """Verdicts with the columns of both sides, written once at ``target``/joined, and alone at ``target``."""
    joined = Step(f"{target}/joined", (est, gt), lambda e, g: evaluate(e, g, matcher), True, needs=(("row_idx", "class"), ("row_idx", "class")))
    plain = Step(target, (f"{target}/joined",), lambda j: j.select(*frame_key(j), "est_index", "gt_index", "score", "status", "threshold"))
    return [joined, plain]


def sweep(est: DataFrame, gt: DataFrame, score: str = "center_distance", thresholds: tuple = (1.0,), **options) -> DataFrame:
    """Verdicts at each of ``thresholds`` (column ``threshold``).

    A pair takes part in the assignment of each threshold that it meets: cutting the matches of the
    loosest one later would differ.
    """
    larger = SCORES[score][1]
    options.setdefault("assignment", "greedy")
    m = Matcher(score, (min if larger else max)(thresholds), **options)
    cuts = F.array(*(F.lit(float(t)) for t in thresholds))
    got = matched(est, gt, m, tuple(map(float, thresholds)))
    both = verdicts(est.withColumn("cut", F.explode(cuts)), gt.withColumn("cut", F.explode(cuts)), got, m, ("cut",))
    return both.withColumn("threshold", F.col("cut")).drop("cut")


def average_precision_sweep(est: str, gt: str, score: str = "center_distance", thresholds: tuple = (1.0,), heading: bool = False, classes: list | None = None, **options) -> list[Step]:
    """Verdicts, AP by threshold (with ``heading`` APH too), and their means."""
    at = f"/matching/{score}"
    steps = [Step(at, (est, gt), lambda e, g: sweep(e, g, score, thresholds, **options), True, needs=(("row_idx", "class"), ("row_idx", "class")))]
    for turn in (False, True)[: 1 + heading]:
        kind = "aph" if turn else "ap"
        steps.append(Step(f"/metrics/{kind}", (at,), lambda j, turn=turn: metrics.average_precision(j, classes, turn, by=("threshold",)), True))
        for i, t in enumerate(thresholds):
            steps.append(Step(f"/metrics/{kind}/{i}", (f"/metrics/{kind}",), lambda a, t=t: a.where(F.col("threshold") == float(t)).drop("threshold")))
        steps.append(Step(f"/metrics/m{kind}", (f"/metrics/{kind}",), metrics.mean_average_precision))
    return steps
