"""Ranges of months with a checkpoint file, so that a stopped backfill goes on where it was."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

Month = tuple[int, int]


def parse_month(token: str) -> Month:
    found = re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])", token)
    if not found:
        raise ValueError(f"not a month (YYYY-MM): {token!r}")
    return int(found[1]), int(found[2])


def token(month: Month) -> str:
    return f"{month[0]:04d}-{month[1]:02d}"


def next_month(m: Month) -> Month:
    return m[0] + m[1] // 12, m[1] % 12 + 1


def months(first: Month, last: Month) -> list[Month]:
    if first > last:
        raise ValueError("the first month is after the last")
    out = [first]
    while out[-1] < last:
        out.append(next_month(out[-1]))
    return out


def resolve_range(start: str | None = None, end: str | None = None, year: int | None = None, month: int | None = None) -> list[Month]:
    """From two tokens, or from one year and month; not both."""
    if (start or end) and (year or month):
        raise ValueError("give a range of months or a year and month, not both")
    if start and end:
        return months(parse_month(start), parse_month(end))
    if year and month:
        return [parse_month(f"{year:04d}-{month:02d}")]
    raise ValueError("give both ends of the range, or a year and a month")


@dataclass
class Checkpoint:
    run_id: str
    started_at: str
    months_planned: list[str]
    settings_snapshot: dict[str, Any]
    finished_at: str | None = None
    months_completed: list[str] = field(default_factory=list)
    current_month: str | None = None

    def pending(self) -> list[str]:
        return [m for m in self.months_planned if m not in self.months_completed]

    def save(self, folder: str | Path) -> Path:
        """By rename, so that a reader never sees half a file."""
        path = Path(folder) / f"backfill_{self.run_id}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        fresh = path.with_suffix(f".{os.getpid()}.tmp")
        fresh.write_text(json.dumps(asdict(self), indent=1, sort_keys=True))
        fresh.replace(path)
        return path


def unfinished(folder: str | Path, settings: dict[str, Any]) -> Checkpoint | None:
    """The latest run with these settings that did not end."""
    found = [Checkpoint(**json.loads(p.read_text())) for p in Path(folder).glob("backfill_*.json")]
    open_ = [c for c in found if c.finished_at is None and c.settings_snapshot == settings]
    return max(open_, key=lambda c: c.started_at, default=None)


def purge(folder: str | Path) -> int:
    """Removes the files of ended runs."""
    old = [p for p in Path(folder).glob("backfill_*.json") if json.loads(p.read_text()).get("finished_at")]
    for p in old:
        p.unlink()
    return len(old)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def run(folder: str | Path, run_id: str, planned: list[Month], settings: dict[str, Any], each: Callable[[Month, str], Any]) -> Checkpoint:
    """Runs `each` for every pending month in order; what a failed run did is not done again."""
    state = unfinished(folder, settings) or Checkpoint(run_id, now(), [token(m) for m in planned], settings)
    for m in state.pending():
        state.current_month = m
        state.save(folder)
        each(parse_month(m), state.run_id)
        state.months_completed.append(m)
        state.current_month = None
        state.save(folder)
    state.finished_at = now()
    state.save(folder)
    return state
