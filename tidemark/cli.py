"""Command line: inspect (tables, or an input file), run-bronze, run-silver, run-gold, run-quality, run-all, run-backfill, report, reset, clean,
check-contracts (a folder is sound) and compare-contracts (no breaking change without a higher version)."""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import datetime, timezone
from pathlib import Path

import yaml

from tidemark.plans import backfill
from tidemark.plans.pipeline import CONTRACTS, Pipeline
from tidemark.sources import contracts
from tidemark.sources.session import log_to, resolve_input, session
from tidemark.sources.store import TableStore

STAGES = {"run-bronze": "raw", "run-silver": "clean", "run-gold": "daily", "run-quality": "quality", "run-all": "all"}
#: Options of the pipeline, all off by default.
SWITCHES = ("enforce_unfiltered", "quality_in_window", "append_summary", "strict_defaults", "enforce_raw", "reject_nan")
PREVIEW = 5  # rows that inspect shows of an input file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("command", choices=[*STAGES, "run-backfill", "inspect", "report", "reset", "clean", "check-contracts", "compare-contracts"])
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--input")
    p.add_argument("--root", default=".")
    p.add_argument("--year", type=int)
    p.add_argument("--month", type=int)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--max-invalid-ratio", type=float, default=0.001)
    p.add_argument("--no-strict-quality", action="store_true")
    p.add_argument("--master")
    p.add_argument("--contracts", default=str(CONTRACTS))
    p.add_argument("--base-contracts")
    for switch in SWITCHES:
        p.add_argument(f"--{switch.replace('_', '-')}", action="store_true")
    p.add_argument("--output", help="file for the report, beside printing it")
    return p


def check_contracts(args: argparse.Namespace) -> None:
    """Raises with everything that is wrong; needs no session."""

    def raw(folder: str) -> list[tuple[Path, dict]]:
        return [(p, yaml.safe_load(p.read_text())) for p in sorted(Path(folder).rglob("*.yml"))]

    found = [f"{p.name}: {x}" for p, c in raw(args.contracts) for x in contracts.problems(c)]
    if args.command == "compare-contracts" and not found:
        if not args.base_contracts:
            raise ValueError("compare-contracts needs --base-contracts")
        old, new = ({c["dataset"]: contracts.parse(c) for _, c in raw(f)} for f in (args.base_contracts, args.contracts))
        found = contracts.evolution_errors(old, new)
    if found:
        raise ValueError("; ".join(found))


def command(args: argparse.Namespace) -> None:
    if args.command.endswith("-contracts"):
        return check_contracts(args)
    spark = session(master=args.master)
    store = TableStore(args.warehouse, spark)
    log = log_to(Path("logs") / "tidemark.jsonl")
    run_id = str(uuid.uuid4())

    def pipeline(run: str, year: int | None, month: int | None) -> Pipeline:
        return Pipeline(spark, store, run, datetime.now(timezone.utc), year, month, args.max_invalid_ratio, not args.no_strict_quality, **{k: getattr(args, k) for k in SWITCHES})

    log.info(args.command, extra={"fields": {"run_id": run_id}})
    if args.command == "inspect" and args.input:
        df = spark.read.parquet(str(resolve_input(args.root, args.input)))
        print(df.schema.simpleString())
        for r in df.limit(PREVIEW).collect():
            print(r.asDict())
        print(args.input, df.count())
    elif args.command == "inspect":
        for t in store.tables():
            print(t, store.read(spark, t).count())
    elif args.command == "reset":
        for t in store.tables():
            store.drop(t)
    elif args.command == "clean":
        for t in store.tables():
            store.vacuum(t)
        backfill.purge(Path(args.root) / "checkpoints")
    elif args.command == "report":
        text = pipeline(run_id, args.year, args.month).report()
        print(text, end="")
        if args.output:
            Path(args.output).parent.mkdir(parents=True, exist_ok=True)
            Path(args.output).write_text(text)
    elif args.command == "run-backfill":
        planned = backfill.resolve_range(args.start, args.end, args.year, args.month)
        settings = {"months": [backfill.token(m) for m in planned], "max_invalid_ratio": args.max_invalid_ratio, "strict": not args.no_strict_quality} | {k: True for k in SWITCHES if getattr(args, k)}
        backfill.run(Path(args.root) / "checkpoints", run_id, planned, settings, lambda m, run: pipeline(run, *m).all(str(resolve_input(args.root, None, *m))))
    else:
        stage = getattr(pipeline(run_id, args.year, args.month), STAGES[args.command])
        takes_input = args.command in ("run-bronze", "run-all")
        stage(*([str(resolve_input(args.root, args.input, args.year, args.month))] if takes_input else []))
    log.info(f"{args.command} done", extra={"fields": {"run_id": run_id}})
    return None


def main(argv: list[str] | None = None) -> int:
    try:
        command(parser().parse_args(argv))
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
