"""The curated registry and reject list: YAML files, a file an entity, its name the slug.  Unknown keys are problems, all reported at once."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import SLUG

GROUP = "slug string, name string, url string, category string, aliases array<string>, venue_slug string, verified_by string, verified_at string, pos int"
VENUE = "slug string, name string, aliases array<string>, address string, city string, state string, zip string, url string, pos int"
SOURCE = "url string, group_slug string, kind string, priority int, enabled boolean"
REJECT = "fingerprint string, reason string, rejected_by string, rejected_at string"
PROBLEM = "scope string, slug string, message string"


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _load(folder: Path, scope: str, known: set[str]) -> tuple[list[tuple[str, dict]], list[tuple]]:
    import yaml

    found, bad = [], []
    for p in sorted(folder.iterdir()) if folder.is_dir() else []:
        if p.suffix != ".yaml" or not re.match(SLUG, p.stem):
            bad.append((scope, p.name, "only <slug>.yaml files belong here"))
            continue
        try:
            x = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
        except yaml.YAMLError as e:
            bad.append((scope, p.stem, f"not YAML: {e}".split("\n")[0]))
            continue
        if not isinstance(x, dict):
            bad.append((scope, p.stem, "not a mapping"))
            continue
        bad += [(scope, p.stem, f"unknown key {k}") for k in sorted(map(str, set(x) - known))]
        for k in ("aliases", "sources"):
            want = str if k == "aliases" else dict
            if x.get(k) is not None and not (isinstance(x[k], list) and all(isinstance(v, want) for v in x[k])):
                bad.append((scope, p.stem, f"{k} must be a list of {'texts' if want is str else 'mappings'}"))
                x[k] = None
        for f in x.get("sources") or []:
            for k, kind in (("priority", int), ("enabled", bool)):
                if k in f and type(f[k]) is not kind:
                    bad.append((scope, p.stem, f"{k} of a source must be {'a number' if kind is int else 'true or false'}"))
                    del f[k]
        found.append((p.stem, x))
    return found, bad


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """groups, venues, sources and problems of a folder with ``groups/`` and ``venues/``; a registry is small and read by the driver."""
    gs, bad = _load(Path(root, "groups"), "group", {"name", "url", "category", "aliases", "venue", "verified_by", "verified_at", "active", "sources"})
    vs, more = _load(Path(root, "venues"), "venue", {"name", "aliases", "address", "city", "state", "zip", "url"})
    text = lambda x, k: None if x.get(k) in (None, "") else str(x[k])
    groups = [(s, text(x, "name"), text(x, "url"), text(x, "category"), x.get("aliases"), text(x, "venue"), text(x, "verified_by"), text(x, "verified_at"), i) for i, (s, x) in enumerate(gs)]
    venues = [(s, text(x, "name"), x.get("aliases"), *(text(x, k) for k in ("address", "city", "state", "zip", "url")), i) for i, (s, x) in enumerate(vs)]
    sources = [(text(f, "url"), s, text(f, "kind"), int(f.get("priority", 10)), bool(f.get("enabled", True))) for s, x in gs for f in x.get("sources") or []]
    make = spark.createDataFrame
    return {"groups": make(groups, GROUP), "venues": make(venues, VENUE), "sources": make(sources, SOURCE), "problems": make(bad + more, PROBLEM)}


def load_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The reject list; a missing file is an empty list."""
    import yaml

    p = Path(path)
    rows = yaml.safe_load(p.read_text(encoding="utf-8")) or [] if p.exists() else []
    return spark.createDataFrame([tuple(None if r.get(k) is None else str(r[k]) for k in _fields(REJECT)) for r in rows], REJECT)
