"""Names of classes and instances as small tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, BACKGROUND = -1, -2


@dataclass(frozen=True)
class LabelRegistry:
    """Class names by id (their place), with aliases that stand for a name."""

    names: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if len(set(self.names)) != len(self.names):
            raise ValueError("a class name occurs twice")
        if bad := {v for v in self.aliases.values() if v not in self.names}:
            raise ValueError(f"aliases of unknown classes: {sorted(bad)}")

    def ids(self) -> dict[str, int]:
        own = {n: i for i, n in enumerate(self.names)}
        return {a: own[n] for a, n in self.aliases.items()} | own

    def class_id(self, name: str) -> int:
        if name not in self.ids():
            raise KeyError(f"unknown class {name!r}")
        return self.ids()[name]

    def name(self, class_id: int) -> str:
        return {UNKNOWN: "unknown", BACKGROUND: "background"}.get(class_id) or self.names[class_id]

    def encode(self, name: Column, unknown: str = "error") -> Column:
        """Ids of names; ``unknown`` names raise, become -1 or become null ("drop")."""
        table = F.create_map(*(F.lit(x) for kv in sorted(self.ids().items()) for x in kv))
        got = F.element_at(table, name)
        if unknown == "error":
            return F.coalesce(got, F.raise_error(F.concat(F.lit("unknown class "), name)).cast("int"))
        return got if unknown == "drop" else F.coalesce(got, F.lit(UNKNOWN))

    def decode(self, class_id: Column) -> Column:
        return F.when(class_id == UNKNOWN, "unknown").when(class_id == BACKGROUND, "background").otherwise(F.get(F.array(*map(F.lit, self.names)), class_id))

    def merged(self, groups: dict[str, list[str]]) -> LabelRegistry:
        """Members of each group become aliases of its name."""
        of = {m: g for g, members in groups.items() for m in members}
        names = tuple(dict.fromkeys(of.get(n, n) for n in self.names))
        return LabelRegistry(names, {m: g for m, g in of.items() if m not in names})

    def remap(self, target: LabelRegistry, class_id: Column, missing: str = "error") -> Column:
        """Ids of this registry as ids of another; negative ones stay."""
        there = target.ids()
        lost = [n for n in self.names if n not in there]
        if lost and missing == "error":
            raise KeyError(f"classes without a counterpart: {lost}")
        return F.when(class_id < 0, class_id).otherwise(F.get(F.array(*(F.lit(there.get(n, UNKNOWN)) for n in self.names)), class_id))

    def remap_image(self, target: LabelRegistry, image: Column, missing: str = "error") -> Column:
        """Every pixel of a label image by :meth:`remap`."""
        return F.transform(image, lambda row: F.transform(row, lambda c: self.remap(target, c, missing)))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"names": list(self.names), "aliases": dict(sorted(self.aliases.items()))}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> LabelRegistry:
        got = json.loads(text)
        return LabelRegistry(tuple(got["names"]), got["aliases"])


def intern(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, instance_id): dense numbers in the order in which keys are first seen.

    The numbering needs one order over all keys; only one row a key takes part in it.
    """
    from pyspark.sql import Window

    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(key, (F.row_number().over(Window.orderBy("first", key)) - 1).cast("long").alias("instance_id"))
