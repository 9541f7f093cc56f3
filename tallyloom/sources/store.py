"""The store folder: an append-only raw table, a folder of derived tables for each run, and
the history of runs, whose last row names the folder that counts.

A run writes its tables to a folder of its own and then appends itself to the
history, which is one committed file: readers see the whole old state or the whole
new one, and a run that dies leaves the old one. A rebuild has all sessions. An update has those of
some groups of sessions, which it replaces: a group's rows are those of the last run that has
it. A run that only classifies has the tables that follow from the others. Schema versions are
numbered migrations, each applied once, recorded after it has succeeded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ledger import NAMES, Ledger, Tables
from .transcripts import RAW_SCHEMA

HISTORY, VERSIONS = "normalize_run", "schema_version"
_RUN = """run_id long, folder string, ran_at string, raw_events long, parse_failures long, api_calls long, unknown_models long, work_units long,
    prompt_units long, unscored_arcs long, verdicts long, score_zero long, classified string, groups array<int>"""
#: Groups of sessions, the unit of replacement. A store's history is bound to it.
GROUPS = 256
#: Tables that a classification makes anew from the others.
CLASSIFIED = ("classification", "verdict")
Migration = Callable[[SparkSession, str], None]


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def _empty(schema: str, name: str) -> Migration:
    """A migration that makes an empty table, unless it is there."""

    def make(spark: SparkSession, store: str) -> None:
        if not exists(spark, f"{store}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{store}/{name}")

    return make


#: In order of their versions; only ever appended to.
MIGRATIONS: tuple[tuple[int, str, Migration], ...] = ((1, "raw events", _empty(RAW_SCHEMA, "raw_event")), (2, "run history", _empty(_RUN, HISTORY)))


def migrate(spark: SparkSession, store: str, at: str = "", migrations: tuple[tuple[int, str, Migration], ...] = MIGRATIONS) -> list[str]:
    """Applies what has not been applied yet; the names of what was. One that fails is not
    recorded and is tried again next time."""
    path, applied = f"{store}/{VERSIONS}", []
    done = {r.version for r in spark.read.parquet(path).collect()} if exists(spark, path) else set()
    for version, name, apply in sorted(migrations, key=lambda m: m[0]):
        if version not in done:
            apply(spark, store)
            spark.createDataFrame([(version, name, at)], "version int, name string, applied_at string").write.mode("append").parquet(path)
            applied.append(name)
    return applied


def history(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_RUN).parquet(f"{store}/{HISTORY}")


def latest(spark: SparkSession, store: str):
    """The last run's row, or None."""
    return history(spark, store).orderBy(F.desc("run_id")).first() if exists(spark, f"{store}/{HISTORY}") else None


def group_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(GROUPS)).cast("int")


def session_column(name: str) -> Column:
    """The session of a derived table's rows."""
    of_unit = lambda c: F.regexp_extract(c, r"(?s)^(.*):(?:arc:\d+|prompt:\d+|remainder)$", 1)
    return of_unit("unit_id") if name == "classification" else of_unit("work_unit_id") if name in ("verdict", "outcome_signal") else F.col("session")


def _record(spark: SparkSession, store: str, counts: DataFrame, **fields) -> None:
    row = counts.withColumns({k: F.lit(v) for k, v in fields.items()})
    have = set(row.columns)
    fields_of = [c.strip().split(" ", 1) for c in _RUN.replace("\n", " ").split(",")]
    row.select([(F.col(name) if name in have else F.lit(None)).cast(kind.strip()).alias(name) for name, kind in fields_of]).coalesce(1).write.mode("append").parquet(f"{store}/{HISTORY}")


def save(tables: Tables, store: str) -> int:
    """Writes all derived tables and then their run; the run's number."""
    spark = tables.api_call.sparkSession
    migrate(spark, store)
    last = latest(spark, store)
    run_id, folder = (last.run_id if last else 0) + 1, f"derived/{uuid.uuid4().hex}"
    for name, table in tables.tables().items():
        if name not in ("raw_event", HISTORY):
            table.write.parquet(f"{store}/{folder}/{name}")
    _record(spark, store, tables.normalize_run, run_id=run_id, folder=folder)
    return run_id


def counts_of(tables: Tables, ran_at: str, parse_failures: int) -> DataFrame:
    """The counts of a run, from tables that are there."""
    count = lambda frame, **more: frame.agg(*[x.alias(k) for k, x in more.items()])
    classes = tables.classification
    parts = (
        count(tables.raw_event, raw_events=F.count("*")), count(tables.api_call, api_calls=F.count("*"), unknown_models=F.count_if(F.col("model_tier") == "unknown")), count(tables.work_unit, work_units=F.count("*")),
        count(tables.prompt_unit, prompt_units=F.count("*")), count(tables.verdict, verdicts=F.count("*")),
        count(classes, unscored_arcs=F.count_if((F.col("unit_grain") == "work_unit") & (F.col("task_complexity") == "Unscored")), score_zero=F.count_if((F.col("unit_grain") == "prompt_unit") & (F.col("complexity_score") == 0))),
    )
    row = parts[0]
    for more in parts[1:]:
        row = row.crossJoin(more)  # one row each
    return row.withColumns({"ran_at": F.lit(ran_at), "parse_failures": F.lit(parse_failures).cast("long")})


def reclassify(tables: Tables, store: str, ran_at: str = "") -> int:
    """Writes what a classification makes anew and a run that takes all else from the last one."""
    spark = tables.api_call.sparkSession
    last, folder = latest(spark, store), f"derived/{uuid.uuid4().hex}"
    for name, table in tables.tables().items():
        if name in CLASSIFIED or name == "outcome_signal":
            table.write.parquet(f"{store}/{folder}/{name}")
    state = load(spark, store)
    state.classification, state.verdict = (spark.read.parquet(f"{store}/{folder}/{name}") for name in CLASSIFIED)
    _record(spark, store, counts_of(state, ran_at, last.parse_failures), run_id=last.run_id + 1, folder=last.folder, classified=folder, groups=last.groups)
    return last.run_id + 1


def update(tables: Tables, store: str, groups: list[int], ran_at: str = "", parse_failures: int = 0) -> int:
    """Writes the rows of some groups of sessions and a run that replaces these groups."""
    spark = tables.api_call.sparkSession
    last, folder = latest(spark, store), f"derived/{uuid.uuid4().hex}"
    for name, table in tables.tables().items():
        if name not in ("raw_event", HISTORY, "model_registry"):
            table.where(group_of(session_column(name)).isin(groups)).write.parquet(f"{store}/{folder}/{name}")
    _record(spark, store, counts_of(load(spark, store, (folder, sorted(groups))), ran_at, parse_failures), run_id=last.run_id + 1, folder=folder, groups=sorted(groups))
    return last.run_id + 1


def _owners(runs: list, name: str) -> list[tuple[str, set[int] | None]]:
    """Folders of a table and the groups that count there (None: all); ``runs`` has the newest first."""
    taken: set[int] = set()
    out: list[tuple[str, set[int] | None]] = []
    seen: set[str] = set()
    for folder, classified, groups in runs:
        where = classified if classified and name in CLASSIFIED else folder
        whole = groups is None or (classified and name in CLASSIFIED)  # a classification has all groups
        if where not in seen:
            seen.add(where)
            mine = None if whole and not taken else set(range(GROUPS)) - taken if whole else set(groups) - taken
            if mine is None or mine:
                out.append((where, mine))
        if whole:
            break
        taken |= set(groups)
    return out


def load(spark: SparkSession, store: str, newest: tuple[str, list[int]] | None = None) -> Ledger:
    """The tables as of the last run, and the whole history of runs. ``newest``: folder and groups of
    an update that is not recorded yet."""
    last = latest(spark, store)
    if last is None:
        raise FileNotFoundError(f"nothing is derived in {store}; run normalize first")
    known = [(r.folder, r.classified, r.groups) for r in history(spark, store).select("run_id", "folder", "classified", "groups").orderBy(F.desc("run_id")).collect()]  # a row a run
    runs = ([(newest[0], None, newest[1])] if newest else []) + known
    derived = {}
    for name in NAMES:
        if name in ("raw_event", HISTORY):
            continue
        table = None
        for folder, groups in _owners([r for r in runs if r[2] is None][:1] if name == "model_registry" else runs, name):
            part = spark.read.parquet(f"{store}/{folder}/{name}")
            if groups is not None and name != "model_registry":
                part = part.where(group_of(session_column(name)).isin(sorted(groups)))
            table = part if table is None else table.unionByName(part)
        derived[name] = table
    return Ledger(raw_event=spark.read.schema(RAW_SCHEMA).parquet(f"{store}/raw_event"), normalize_run=history(spark, store), **derived)
