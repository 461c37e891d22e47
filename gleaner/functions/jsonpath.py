"""Dot-path queries over JSON text: ``.a.b[]``, ``.[]``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(path: str) -> list[tuple[str | None, bool]]:
    """Steps of a dot path: (field, spread)."""
    text = path.strip().removeprefix(".")
    if not text:
        return []
    return [(name or None, spread == "[]") for name, spread in re.findall(r"([^.\[\]]*)(\[\])?(?:\.|$)", text) if name or spread]


def apply_path(json: Column, path: str) -> Column:
    """Result as JSON text: one result bare, several or none as an array.

    A step that meets something without the field gives nothing; spreading a
    value that is no array takes the value itself.
    """
    current = F.array(F.to_json(F.parse_json(json)))
    for name, spread in parse(path):
        if name is not None:
            current = F.filter(F.transform(current, _field(name)), lambda v: v.isNotNull())
        if spread:
            split = F.transform(current, lambda v: F.coalesce(F.transform(F.try_variant_get(F.parse_json(v), "$", "array<variant>"), lambda x: F.to_json(x)), F.array(v)))
            current = F.flatten(split)
    return F.when(F.size(current) == 1, current[0]).otherwise(F.concat(F.lit("["), F.array_join(current, ","), F.lit("]")))


def _field(name: str):
    path = "$['" + name.replace("'", "\\'") + "']"
    return lambda v: F.to_json(F.try_variant_get(F.parse_json(v), path, "variant"))
