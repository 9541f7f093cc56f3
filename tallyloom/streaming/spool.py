"""Structured Streaming over a spool folder of transcript files.

New files are appended to the raw table, each line once; the derived tables are then
recomputed for what they touch. An arc stays open until its session ends, so
results are replaced, not appended: no watermark could close them. ``follow`` does both for each
batch; what it leaves equals a rebuild, in all tables but the run history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ACTIVITY_BY_SKILL
from ..plans.ledger import derive
from ..sources import store as stores
from ..sources.transcripts import load_store, new_rows, numbered, parse_failures, raw_lines, records
from ..tables import stored


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str, ingested_at: str = ""):
    """Reads what is in the folder and stops; the checkpoint remembers the files."""

    def append(batch: DataFrame, _: int) -> None:
        new_rows(numbered(batch, ingested_at), load_store(batch.sparkSession, path)).write.mode("append").parquet(path)

    return raw_lines(spark, folder, stream=True).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _responses(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'assistant' and session is not null").select("session", F.struct("message_id", "request_id").alias("response")).distinct()


def connected(known: DataFrame, seeds: DataFrame) -> DataFrame:
    """The sessions of ``seeds`` and all that share a response with them, directly or through others: a response counts in
    one of its sessions only. A round for each step from session to session."""
    seen, n = stored(seeds.select("session").distinct(), "touched"), -1
    while seen.count() != n:
        n = seen.count()
        shared = known.join(seen, "session", "left_semi").select("response").distinct()
        seen = stored(known.join(shared, "response", "left_semi").select("session").unionByName(seen).distinct(), "touched")
    return seen


def _sessions_since(raw: DataFrame, since: str) -> DataFrame:
    return raw.where(raw.ingested_at >= since).select(F.nullif("session_id", F.lit("")).alias("session")).where("session is not null")


def touched(raw: DataFrame, since: str) -> DataFrame:
    """Records of the sessions with rows ingested at ``since`` or later and of all that are derived with them."""
    rows = records(raw)
    return rows.join(connected(_responses(rows), _sessions_since(raw, since)), "session", "left_semi").select(*rows.columns)


def refresh(spark: SparkSession, store: str, since: str, activities: dict[str, str] | None = None, ran_at: str = "") -> int | None:
    """Derives anew the groups of sessions that rows ingested at ``since`` or later touch and replaces them in one commit;
    the run's number. Without a run before, everything is derived; without new rows, nothing is done.

    Sessions of the same groups are derived too, and for them what shares responses with them; of these others
    nothing is written, as nothing in them has changed."""
    raw = load_store(spark, f"{store}/raw_event")
    activities = ACTIVITY_BY_SKILL if activities is None else activities
    hold = lambda frame: stored(frame, "ledger")
    if stores.latest(spark, store) is None:
        return stores.save(derive(records(raw), raw, activities=activities, ran_at=ran_at, parse_failures=parse_failures(raw), hold=hold), store)
    rows = records(raw)
    known = stored(_responses(rows), "responses")
    changed = connected(known, _sessions_since(raw, since))
    groups = [r.g for r in changed.select(stores.group_of(F.col("session")).alias("g")).distinct().collect()]  # GROUPS numbers at most
    if not groups:
        return None
    members = raw.select(F.nullif("session_id", F.lit("")).alias("session")).where("session is not null").where(stores.group_of(F.col("session")).isin(groups))
    around = connected(known, members)
    made = derive(rows.join(around, "session", "left_semi").select(*rows.columns), raw, activities=activities, hold=hold)
    return stores.update(made, store, groups, ran_at, parse_failures(raw))


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str, activities: dict[str, str] | None = None, most_files: int | None = None):
    """Ingests what is in the folder, at most ``most_files`` files a batch, and refreshes the derived tables after
    each batch. A batch has its number as its time of ingestion, so one that is repeated after a failure replaces what it had
    written: rows that are in the raw table already are not appended again, and its groups are derived again."""

    def take(batch: DataFrame, number: int) -> None:
        spark_ = batch.sparkSession
        stores.migrate(spark_, store)
        when = f"batch-{number:012d}"
        new_rows(numbered(batch, when), load_store(spark_, f"{store}/raw_event")).write.mode("append").parquet(f"{store}/raw_event")
        refresh(spark_, store, when, activities, when)

    return raw_lines(spark, folder, stream=True, most_files=most_files).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
