from __future__ import annotations

import pytest
import yaml

from tidemark import cli
from tidemark.plans.pipeline import CONTRACTS
from tidemark.sources import contracts as c

RAW = {
    "dataset": "silver.t",
    "owner": "o",
    "version": 1,
    "primary_key": ["trip_id"],
    "watermark": "updated_at",
    "late_arrival_days": 1,
    "schema": [{"name": "trip_id", "type": "string", "nullable": False}, {"name": "updated_at", "type": "timestamp", "nullable": False}],
    "expectations": [{"name": "required", "type": "not_null", "columns": ["trip_id"]}],
}


def test_defaults(tmp_path):
    (tmp_path / "a.yml").write_text(yaml.safe_dump(RAW))
    found = c.load(tmp_path, "silver.t")
    assert (found.rules[0].severity, found.rules[0].rule_id) == ("error", "required")
    with pytest.raises(FileNotFoundError):
        c.load(tmp_path, "silver.other")


def test_unsupported_severity():
    with pytest.raises(ValueError, match="unsupported severity"):
        c.parse(RAW | {"expectations": [{"name": "x", "severity": "critical"}]})


def test_own_contracts_are_sound():
    for p in CONTRACTS.glob("*.yml"):
        assert c.problems(yaml.safe_load(p.read_text())) == []


def test_problems():
    found = c.problems(RAW | {"primary_key": ["x"], "version": "a.b", "expectations": [{"name": "r", "type": "range", "column": "nope", "min": 3, "max": 1}]})
    assert len(found) == 4


def test_breaking_changes_need_a_version():
    base = c.parse({"dataset": "d", "owner": "o", "version": 2, "primary_key": ["trip_id"], "watermark": "updated_at", "schema": [{"name": "trip_id", "type": "string", "nullable": False}, {"name": "updated_at", "type": "timestamp"}, {"name": "fare_amount", "type": "double"}]})
    raw = {"dataset": "d", "owner": "o", "primary_key": ["trip_id"], "watermark": "updated_at", "schema": [{"name": "trip_id", "type": "string", "nullable": False}, {"name": "updated_at", "type": "timestamp"}, {"name": "fare_amount", "type": "decimal(18,2)"}]}
    assert c.breaking_changes(base, c.parse(raw | {"version": 2}))
    assert c.evolution_errors({"d": base}, {"d": c.parse(raw | {"version": 2})})
    assert not c.evolution_errors({"d": base}, {"d": c.parse(raw | {"version": 3})})
    assert c.evolution_errors({"d": base}, {}) == ["d: dataset removed"]


@pytest.mark.parametrize(("v", "key"), [(1, (1,)), ("1.2.0", (1, 2)), ("2.0", (2,)), (0, (0,))])
def test_versions(v, key):
    assert c.version_key(v) == key


def test_commands(tmp_path, capsys):
    assert cli.main(["check-contracts"]) == 0
    (tmp_path / "a.yml").write_text(yaml.safe_dump(RAW))
    changed = tmp_path / "new"
    changed.mkdir()
    (changed / "a.yml").write_text(yaml.safe_dump(RAW | {"primary_key": ["updated_at"]}))
    base = ["compare-contracts", "--contracts", str(changed), "--base-contracts", str(tmp_path)]
    (tmp_path / "new" / "b.yml").write_text(yaml.safe_dump(RAW | {"dataset": "other"}))
    assert cli.main([*base[:-1], str(tmp_path / "none")]) == 0
    old = tmp_path / "old"
    old.mkdir()
    (old / "a.yml").write_text(yaml.safe_dump(RAW))
    assert cli.main([*base[:-1], str(old)]) == 2
    assert "primary key changed" in capsys.readouterr().err
