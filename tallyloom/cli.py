"""Command line over a store folder: version, status, backfill, normalize, classify, run, follow, verify, views."""

from __future__ import annotations

import argparse
import tomllib
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from .constants import ACTIVITY_BY_SKILL
from .plans import checks, views
from .plans.ledger import Derivation, Reclassified, derive
from .sources import store as stores
from .sources import transcripts
from .streaming import spool
from .tables import stored

VERSION = "0.1.0"


def activity_map(config: str | None) -> dict[str, str]:
    """skill -> activity from a TOML file's [ai_activity.by_anchor_skill], else the default."""
    if not config or not Path(config).exists():
        return ACTIVITY_BY_SKILL
    return tomllib.loads(Path(config).read_text()).get("ai_activity", {}).get("by_anchor_skill", {})


def _hold(frame):
    return stored(frame, "ledger")


def ledger(spark: SparkSession, store: str, config: str | None = None, ran_at: str = "", outcomes: bool = False) -> Derivation:
    """Everything from the raw table."""
    raw = transcripts.load_store(spark, f"{store}/raw_event")
    if raw is None:
        raise FileNotFoundError(f"nothing is stored in {store}; run backfill first")
    return derive(transcripts.records(raw), raw, activities=activity_map(config), ran_at=ran_at, parse_failures=transcripts.parse_failures(raw), hold=_hold, outcomes=outcomes)


def classified(spark: SparkSession, store: str, config: str | None = None, outcomes: bool = False) -> Reclassified:
    """Classification and verdicts anew from the stored calls, units and tools."""
    tables = load(spark, store)
    return Reclassified(tables, transcripts.records(tables.raw_event), activities=activity_map(config), hold=_hold, outcomes=outcomes)


save, load = stores.save, stores.load


def main(args: list[str] | None = None, spark: SparkSession | None = None, echo=print) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom")
    parser.add_argument("command", choices=["version", "status", "backfill", "normalize", "classify", "run", "follow", "verify", "views"])
    for option in ("--projects", "--store", "--config", "--repo"):
        parser.add_argument(option)
    parser.add_argument("--outcomes", action="store_true", help="let outcome signals make verdicts Underprovisioned")
    given = parser.parse_args(args)
    if given.command == "version":
        echo(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("tallyloom").getOrCreate()
    now = datetime.now(timezone.utc).isoformat()
    if given.command in ("backfill", "run"):
        stores.migrate(spark, given.store, now)
        echo(transcripts.backfill(spark, given.projects, f"{given.store}/raw_event", now))
    if given.command in ("normalize", "run"):
        save(ledger(spark, given.store, given.config, now, given.outcomes), given.store)
    if given.command == "classify":
        stores.reclassify(classified(spark, given.store, given.config, given.outcomes), given.store, now)
    if given.command == "follow":
        spool.follow(spark, given.projects, given.store, f"{given.store}/checkpoint", activity_map(given.config)).awaitTermination()
    if given.command == "views":
        for name, (title, text) in views.ABOUT.items():
            echo(f"{name}: {title}. {text}")
    if given.command in ("status", "run"):
        tables = load(spark, given.store)
        for name, table in tables.tables().items():
            echo(f"{name}: {table.count()}")
        views.shown(tables, "v_summary").show(truncate=False)
    if given.command == "verify":
        tables = load(spark, given.store)
        assistants = transcripts.records(tables.raw_event).where("type = 'assistant'").count()
        found, failed = checks.run_checks(tables, assistants, checks.Reference.load(given.config or ""), given.repo)
        for check in found:
            echo(f"{check.name}: expected {check.expected}, is {check.actual}: {check.status}")
        return int(failed > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
