"""Data contracts: YAML to a frozen value that compiles to a schema and rules; checks of contracts and of their changes."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

SEVERITIES = ("error", "warn", "info")
RULE_TYPES = ("not_null", "range", "unique", "quality_gate")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class Rule:
    name: str
    rule_id: str
    severity: str
    type: str
    columns: tuple[str, ...] = ()
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Contract:
    dataset: str
    owner: str
    version: Any
    schema: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    watermark: str | None = None
    late_arrival_days: int | None = None
    rules: tuple[Rule, ...] = field(default=())


def parse(raw: dict[str, Any]) -> Contract:
    rules = []
    for x in raw.get("expectations") or []:
        name = str(x.get("name") or "").strip()
        if not name:
            raise ValueError("a rule needs a name")
        severity = str(x.get("severity") or "error").strip().lower()
        if severity not in SEVERITIES:
            raise ValueError(f"unsupported severity '{severity}' in rule '{name}'")
        columns = x.get("columns") or ([x["column"]] if x.get("column") else [])
        rules.append(Rule(name, str(x.get("rule_id") or name), severity, str(x.get("type") or "").strip().lower(), tuple(map(str, columns)), x.get("min"), x.get("max")))
    schema = tuple(Field(str(f["name"]), str(f["type"]), bool(f.get("nullable", True))) for f in raw.get("schema") or [])
    return Contract(str(raw["dataset"]), str(raw.get("owner", "")), raw.get("version", 1), schema, tuple(raw.get("primary_key") or ()), raw.get("watermark"), raw.get("late_arrival_days"), tuple(rules))


def load(folder: str | Path, dataset: str) -> Contract:
    for path in sorted(Path(folder).rglob("*.yml")):
        raw = yaml.safe_load(path.read_text())
        if isinstance(raw, dict) and raw.get("dataset") == dataset:
            return parse(raw)
    raise FileNotFoundError(f"no contract for '{dataset}' under {folder}")


def problems(raw: Any) -> list[str]:
    """What is wrong with a contract's raw form; nothing if it is sound."""
    if not isinstance(raw, dict):
        return ["a contract is a mapping"]
    found = [f"missing '{k}'" for k in ("dataset", "owner", "version", "schema") if raw.get(k) in (None, "", [])]
    names = [f.get("name") for f in raw.get("schema") or [] if isinstance(f, dict)]
    found += [f"schema entry without name or type: {f}" for f in raw.get("schema") or [] if not isinstance(f, dict) or not f.get("name") or not f.get("type")]
    found += [f"column '{n}' appears twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
    found += [f"primary key column '{k}' is not in the schema" for k in raw.get("primary_key") or [] if k not in names]
    if raw.get("watermark") and raw["watermark"] not in names:
        found.append(f"watermark '{raw['watermark']}' is not in the schema")
    days = raw.get("late_arrival_days")
    if days is not None and (not isinstance(days, int) or days < 0):
        found.append("late_arrival_days is a whole number from 0")
    try:
        version_key(raw.get("version", 1))
    except ValueError as e:
        found.append(str(e))
    for x in raw.get("expectations") or []:
        if not x.get("name"):
            found.append("a rule needs a name")
        if x.get("severity", "error") not in SEVERITIES:
            found.append(f"unsupported severity '{x.get('severity')}'")
        if x.get("type") not in RULE_TYPES:
            found.append(f"unknown rule type '{x.get('type')}'")
        found += [f"rule '{x.get('name')}' names unknown column '{c}'" for c in [*(x.get("columns") or []), *([x["column"]] if x.get("column") else [])] if c not in names]
        if x.get("type") == "range" and x.get("min") is not None and x.get("max") is not None and x["min"] > x["max"]:
            found.append(f"rule '{x.get('name')}' has min above max")
    return found


def version_key(version: Any) -> tuple[int, ...]:
    """A version of dotted whole numbers as a tuple, without zeros at its end."""
    parts = str(version).strip().split(".")
    if isinstance(version, bool) or not all(p.isdigit() for p in parts):
        raise ValueError(f"unsupported version '{version}'")
    numbers = [int(p) for p in parts]
    while len(numbers) > 1 and numbers[-1] == 0:
        numbers.pop()
    return tuple(numbers)


def breaking_changes(old: Contract, new: Contract) -> list[str]:
    now = {f.name: f for f in new.schema}
    found = []
    for f in old.schema:
        if f.name not in now:
            found.append(f"column '{f.name}' removed")
            continue
        if now[f.name].type != f.type:
            found.append(f"column '{f.name}' changed from {f.type} to {now[f.name].type}")
        if f.nullable and not now[f.name].nullable:
            found.append(f"column '{f.name}' no longer takes nulls")
    if old.primary_key != new.primary_key:
        found.append("primary key changed")
    if old.watermark and old.watermark != new.watermark:
        found.append("watermark changed" if new.watermark else "watermark removed")
    return found


def evolution_errors(old: dict[str, Contract], new: dict[str, Contract]) -> list[str]:
    """Removed datasets, and breaking changes without a higher version."""
    found = [f"{d}: dataset removed" for d in sorted(old.keys() - new.keys())]
    for d in sorted(old.keys() & new.keys()):
        changes = breaking_changes(old[d], new[d])
        if changes and version_key(new[d].version) <= version_key(old[d].version):
            found.append(f"{d}: {'; '.join(changes)} need a version above {old[d].version}")
    return found
