"""Transcripts (JSON lines) as an append-only raw table, and raw rows as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "source string, ingested_at string, session_id string, payload string, content_hash string, file_path string, line_no int"
_HEAD = """type string, sessionId string, session_id string, requestId string, timestamp string, cwd string, gitBranch string, version string, attributionSkill string,
    isSidechain boolean, isMeta boolean, error string, apiErrorStatus string, message string"""
_MESSAGE = """id string, model string, content string,
    usage struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>"""
_BLOCKS = "array<struct<type: string, text: string, name: string, input: string, is_error: boolean>>"


def raw_lines(spark: SparkSession, folder: str, stream: bool = False, most_files: int | None = None) -> DataFrame:
    """file_path, file_name, block and payload of the non-blank lines of all ``*.jsonl`` files below a folder, trimmed. Files
    are split like any text: a task reads a block of a file, which begins at byte ``block``. Files that vanish are skipped."""
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("ignoreMissingFiles", "true")
    if stream and most_files:
        reader = reader.option("maxFilesPerTrigger", str(most_files))
    about = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file_path"), ("file_name", "file_name"), ("file_block_start", "block"))]
    lines = reader.schema("value string").format("text").load(folder).select(*about, F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("payload"))
    return lines.where("payload <> ''")


def numbered(lines: DataFrame, ingested_at: str = "") -> DataFrame:
    """The lines in RAW_SCHEMA, numbered from 1 in their files. A line's number is its place in its block and the counts of
    the blocks before, so no task needs a whole file. The hash covers session, file name, line number and line, so a
    grown file adds its tail only and equal lines stay apart."""
    placed = lines.withColumn("place", F.monotonically_increasing_id())  # a block's lines follow each other in one partition
    blocks = placed.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    order = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file_path", "block", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    named = lambda key: F.nullif(F.get_json_object("payload", key), F.lit(""))
    session = F.coalesce(named("$.sessionId"), named("$.session_id"), F.regexp_replace("file_name", r"\.jsonl$", ""))
    number = (F.col("place") - F.col("first") + F.col("before") + 1).cast("int")
    rows = placed.join(before, ["file_path", "block"]).select("file_path", "file_name", "payload", number.alias("line_no"), session.alias("session_id"))
    digest = F.sha2(F.concat_ws("\u0000", "session_id", "file_name", F.col("line_no").cast("string"), "payload"), 256)
    return rows.select(F.lit("transcript").alias("source"), F.lit(ingested_at).alias("ingested_at"), "session_id", "payload", digest.alias("content_hash"), "file_path", "line_no")


def read_lines(spark: SparkSession, folder: str, ingested_at: str = "") -> DataFrame:
    """All lines below a folder in RAW_SCHEMA."""
    return numbered(raw_lines(spark, folder), ingested_at)


def new_rows(lines: DataFrame, store: DataFrame | None) -> DataFrame:
    """Lines whose hash the store doesn't have, each hash once."""
    fresh = lines.dropDuplicates(["content_hash"])
    return fresh if store is None else fresh.join(store.select("content_hash"), "content_hash", "left_anti").select(*lines.columns)


def load_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The raw table at ``path``, or None before the first backfill."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def backfill(spark: SparkSession, folder: str, path: str, ingested_at: str = "") -> dict[str, int]:
    """Appends what is new; running it again adds nothing. Unparseable lines are stored and counted."""
    lines = read_lines(spark, folder, ingested_at)
    store = load_store(spark, path)
    seen = lines.agg(F.count_distinct("file_path"), F.count("*"), F.count_if(~parseable(F.col("payload")))).first()
    before = 0 if store is None else store.count()
    new_rows(lines, store).write.mode("append").parquet(path)
    inserted = load_store(spark, path).count() - before
    return {"files": seen[0], "lines": seen[1], "inserted": inserted, "duplicates": seen[1] - inserted, "unparseable": seen[2]}


def parseable(payload):
    """Whether a line is JSON of any kind."""
    return F.try_parse_json(payload).isNotNull()


def parse_failures(raw: DataFrame) -> int:
    return raw.agg(F.count_if(~parseable(F.col("payload")))).first()[0]


def records(raw: DataFrame) -> DataFrame:
    """Records of the raw table's JSON objects in the form that the operators take. A
    line's place is its path's components and its number there."""
    parsed = raw.where(F.startswith(F.ltrim("payload"), F.lit("{")) & parseable(F.col("payload"))).withColumn("r", F.from_json("payload", _HEAD))
    parsed = parsed.withColumn("m", F.from_json("r.message", _MESSAGE))
    listed = F.startswith(F.col("m.content"), F.lit("["))
    text = F.nullif("session_id", F.lit(""))
    tokens = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_write_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}
    return parsed.select(
        F.struct(F.split("file_path", "/").alias("path"), "line_no", "content_hash").alias("pos"), text.alias("session"), F.col("r.type").alias("type"), F.col("r.timestamp").alias("ts"),
        F.col("m.id").alias("message_id"), F.col("r.requestId").alias("request_id"), F.col("m.model").alias("model"),
        *[F.coalesce(f"m.usage.{v}", F.lit(0)).alias(k) for k, v in tokens.items()], F.col("r.attributionSkill").alias("skill"), F.coalesce("r.isSidechain", F.lit(False)).alias("sidechain"),
        F.coalesce("r.isMeta", F.lit(False)).alias("meta"), F.col("r.cwd").alias("cwd"), F.col("r.gitBranch").alias("branch"), F.col("r.version").alias("version"), F.col("r.error").alias("error_kind"),
        F.col("r.apiErrorStatus").try_cast("long").alias("api_error_status"), (F.col("m.content").isNotNull() & ~listed).alias("is_text"),
        F.when(~listed, F.col("m.content")).alias("text"), F.when(listed, F.from_json("m.content", _BLOCKS)).alias("blocks"),
    )


def latest(raw: DataFrame) -> DataFrame:
    """The newest row of each session, for staleness."""
    order = Window.partitionBy("session_id").orderBy(F.desc("ingested_at"), F.desc("line_no"), "content_hash")
    return raw.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
