"""All derived tables as one function of the records: turns, calls, units, scores, verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.pricing import priced, registry
from ..functions.text import branch_kind, project_family, repo_of, usd
from ..operators import enrich, outcomes
from ..operators.prompts import boundaries, language
from ..operators.scan import Sizes, sizes
from ..operators.tools import tool_calls
from ..operators.turns import FIRST_SEEN, deduplicated, walked


class Tables:
    """What has a ledger's tables as attributes."""

    def names(self) -> tuple[str, ...]:
        return NAMES

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names()}

    @property
    def unscored(self) -> DataFrame:
        """The ids of the work units that no prompt covers."""
        return self.classification.where("unit_grain = 'work_unit' and task_complexity = 'Unscored'").select(F.col("unit_id").alias("id"))

    def register(self) -> None:
        """Temporary views of the tables' names."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(name)


@dataclass
class Ledger(Tables):
    """Tables that are there already."""

    raw_event: DataFrame
    normalize_run: DataFrame
    model_registry: DataFrame
    api_call: DataFrame
    work_unit: DataFrame
    prompt_unit: DataFrame
    tool_call: DataFrame
    classification: DataFrame
    verdict: DataFrame


NAMES = tuple(Ledger.__dataclass_fields__)


def unit_id(session, arc):
    return F.when(arc >= 0, F.concat_ws(":", session, F.lit("arc"), arc)).otherwise(F.concat_ws(":", session, F.lit("remainder")))


#: What pricing adds to a call, and what of a call needs its session's prompts.
_VALUED = {"model_tier", "allowance_pool", "billable", "value_e8", "notional_list_value_usd"}
_PROMPTED = {"prompt", "prompt_unit_id"}


def calls_of(records: DataFrame, rates: DataFrame, marks: DataFrame | None = None, known: Sizes | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Deduplicated, ordered and priced turns with their arc and prompt. Of ``columns`` only these, and no more is shuffled and
    ordered than they are made of."""
    asked = lambda names: columns is None or not names.isdisjoint(columns)
    valued, prompted = asked(_VALUED), asked(_PROMPTED)
    needed = {"session", "ts"} | ({"model"} if valued else set())
    turns = deduplicated(records, tuple(c for c in FIRST_SEEN if c in needed or asked({c})))
    if valued:
        turns = priced(turns, rates, records.where("type = 'assistant'"))
    if prompted and marks is None:
        marks = boundaries(records, known=known)
    out = walked(turns, marks if prompted else None, known)
    ids = F.concat_ws("|", F.coalesce("message_id", F.lit("")), F.coalesce("request_id", F.lit("")))
    out = out.withColumns({"id": ids, "work_unit_id": unit_id(F.col("session"), F.col("arc"))})
    if prompted:
        out = out.withColumn("prompt_unit_id", F.when(F.col("prompt").isNotNull(), F.concat_ws(":", "session", F.lit("prompt"), "prompt")))
    if valued:
        out = out.withColumn("notional_list_value_usd", usd(F.col("value_e8")))
    return out if columns is None else out.select(*columns)


def work_units(calls: DataFrame) -> DataFrame:
    """Units of the calls' arcs; of calls that lack times, directories, branches, versions or values, without what is made of these."""
    first, has = lambda c: F.min_by(c, "idx").alias(c), set(calls.columns).issuperset
    ends = [F.min_by("ts", "idx").alias("started_at"), F.max_by("ts", "idx").alias("ended_at")] if has({"ts"}) else []
    more = [first(c) for c in ("cwd", "branch", "version") if has({c})] + ([F.sum("value_e8").alias("value_e8")] if has({"value_e8"}) else [])
    grouped = calls.groupBy("session", "arc").agg(first("skill"), F.min("idx").alias("start_turn"), F.max("idx").alias("end_turn"), F.count("*").alias("turns"), *ends, *more)
    made = {
        "id": unit_id(F.col("session"), F.col("arc")), "session": F.col("session"), "kind": F.when(F.col("arc") >= 0, "arc").otherwise("unattributable"), "rule_id": F.lit(C.ARC_RULE),
        "anchor_skill": F.when(F.col("arc") >= 0, F.col("skill")), "start_turn": F.col("start_turn"), "end_turn": F.col("end_turn"), "turns": F.col("turns"),
    }
    if ends:
        made |= {"started_at": F.col("started_at"), "ended_at": F.col("ended_at")}
    if has({"cwd"}):
        made |= {"repo": repo_of(F.col("cwd")), "project_family": project_family(F.col("cwd"))}
    if has({"branch"}):
        made["git_branch_kind"] = branch_kind(F.col("branch"))
    if has({"version"}):
        made["cc_version"] = F.col("version")
    made["allowance_pool"] = F.lit(C.POOL)
    if has({"value_e8"}):
        made |= {"value_e8": F.col("value_e8"), "notional_list_value_usd": usd(F.col("value_e8"))}
    return grouped.select(*[column.alias(name) for name, column in made.items()], F.lit(0).alias("parse_degraded"))


def prompt_units(calls: DataFrame, shares: DataFrame) -> DataFrame:
    """Units of the calls' prompts; of calls that lack times or directories, without what is made of these."""
    has = calls.columns.__contains__
    ends = [F.min_by("ts", "idx").alias("started_at"), F.max_by("ts", "idx").alias("ended_at")] if has("ts") else []
    where = [F.min_by("cwd", "idx").alias("cwd")] if has("cwd") else []
    members = calls.where("prompt is not null").groupBy("session", "prompt").agg(F.min("idx").alias("start_turn"), F.max("idx").alias("end_turn"), F.count("*").alias("turns"), *ends, *where, F.min_by("work_unit_id", "idx").alias("work_unit_id"))
    at_least = lambda c: F.coalesce(F.col(c) >= C.LANGUAGE_SHARE_THRESHOLD, F.lit(False))
    placed = [repo_of(F.col("cwd")).alias("repo"), project_family(F.col("cwd")).alias("project_family")] if where else []
    return members.join(shares, ["session", "prompt"], "left").select(
        F.concat_ws(":", "session", F.lit("prompt"), "prompt").alias("id"), "session", "work_unit_id", F.lit(C.PROMPT_RULE).alias("rule_id"), "start_turn", "end_turn", "turns",
        *(["started_at", "ended_at"] if ends else []), *placed, at_least("debug_share").alias("has_debug_language"), at_least("correction_share").alias("has_self_correction"),
    )


def owned_tools(records: DataFrame, calls: DataFrame, known: Sizes | None = None) -> DataFrame:
    units = [c for c in ("work_unit_id", "prompt_unit_id") if c in calls.columns]
    return tool_calls(records, calls, *units, known=known).select(
        F.concat_ws(":", "session", F.lit("tool"), "ordinal").alias("id"), "session", *units, "tool_name", "target", F.lit(0).alias("is_error"),
        F.col("sidechain").alias("is_sidechain"), "turn_index",
    )


_API_CALL = """id session message_id request_id work_unit_id prompt_unit_id turn_index started_at model model_tier allowance_pool billable input_tokens output_tokens
    cache_write_tokens cache_read_tokens is_sidechain skill error_kind api_error_status cc_version value_e8 notional_list_value_usd""".split()

_CALLED = {"turn_index": "idx", "started_at": "ts", "is_sidechain": "sidechain", "cc_version": "version"}


class Derivation(Tables):
    """The ledger of some records. Each table is derived when it is first asked for, from the records
    and the tables it is made of; nothing outlives the object. A session's windows are partitioned by
    session, deduplication by message and request.

    ``hold`` gets the tables that several others are made of, to keep them between uses
    (tables.stored, DataFrame.persist). With ``outcomes`` there is a table outcome_signal, and two
    of its signals make a verdict Underprovisioned.

    ``columns`` and ``once`` serve those who ask for some tables only: the columns of calls that these are made of, by the
    calls' names, and the tables (calls, work_unit, prompt_unit, tool_call, classes) that are read once, so not held. A table in
    ``narrow`` is held with the columns that it names."""

    def __init__(self, records: DataFrame, raw_event: DataFrame | None = None, rates: DataFrame | None = None, activities: dict[str, str] | None = None, ran_at: str = "", parse_failures: int = 0, hold: Callable[[DataFrame], DataFrame] = lambda frame: frame, outcomes: bool = False, columns: tuple[str, ...] | None = None, once: tuple[str, ...] = ("work_unit",), narrow: dict[str, str] | None = None):
        self.columns, self.once, self.narrow = columns, once, narrow or {}
        self.records, self.hold, self.outcomes, self.ran_at, self.parse_failures = records, hold, outcomes, ran_at, parse_failures
        self.model_registry = registry(records.sparkSession) if rates is None else rates
        self.activities = C.ACTIVITY_BY_SKILL if activities is None else activities
        self.raw_event = records.select(F.col("session").alias("session_id"), F.lit(None).cast("string").alias("ingested_at")) if raw_event is None else raw_event

    def names(self) -> tuple[str, ...]:
        return (*NAMES, "outcome_signal") if self.outcomes else NAMES

    def _held(self, name: str, table: DataFrame) -> DataFrame:
        if name in self.narrow:
            table = table.select(*self.narrow[name].split())
        return table if name in self.once else self.hold(table)

    @cached_property
    def _sizes(self) -> Sizes:
        """Of the sessions' records and blocks: upper bounds of their turns, marks and tools."""
        return sizes(self.records, 1 + F.coalesce(F.greatest(F.size("blocks"), F.lit(0)), F.lit(0)))

    @cached_property
    def _marks(self) -> DataFrame:
        return boundaries(self.records, known=self._sizes)

    @cached_property
    def _calls(self) -> DataFrame:
        return self._held("calls", calls_of(self.records, self.model_registry, self._marks, self._sizes, self.columns))

    @cached_property
    def api_call(self) -> DataFrame:
        has = self._calls.columns
        calls = self._calls.withColumns({name: F.col(of) for name, of in _CALLED.items() if of in has})
        return calls.select(*[c for c in _API_CALL if c in calls.columns])

    @cached_property
    def work_unit(self) -> DataFrame:
        return self._held("work_unit", work_units(self._calls))

    @cached_property
    def prompt_unit(self) -> DataFrame:
        return self._held("prompt_unit", prompt_units(self._calls, language(self.records, self._marks, self._sizes)))

    @cached_property
    def tool_call(self) -> DataFrame:
        return self._held("tool_call", owned_tools(self.records, self._calls, self._sizes))

    @cached_property
    def _scored(self) -> DataFrame:
        return enrich.prompt_scores(self.prompt_unit, self.tool_call)

    @cached_property
    def _classes(self) -> DataFrame:
        return self._held("classes", enrich.classified(self.work_unit, enrich.best_prompts(self._calls, self._scored), self.tool_call, self.activities))

    @cached_property
    def classification(self) -> DataFrame:
        units = self._classes.drop("prompt_units")
        return units.unionByName(enrich.classified_prompts(self._scored).select(*units.columns))

    @cached_property
    def unscored(self) -> DataFrame:
        return self._calls.groupBy(F.col("work_unit_id").alias("id")).agg(F.count("prompt_unit_id").alias("prompted")).where("prompted = 0").select("id")

    @cached_property
    def outcome_signal(self) -> DataFrame:
        return self.hold(outcomes.signals(self.records, self._calls, self.work_unit, self.prompt_unit, self.tool_call, self._classes, self.hold, self._sizes))

    @cached_property
    def verdict(self) -> DataFrame:
        return enrich.verdicts(self._classes, enrich.tier_votes(self._calls), self.outcome_signal if self.outcomes else None)

    @cached_property
    def normalize_run(self) -> DataFrame:
        """One row of counts."""
        count = lambda frame, **more: frame.agg(*[x.alias(k) for k, x in more.items()])
        return (
            count(self.records, raw_events=F.count("*")).crossJoin(count(self._calls, api_calls=F.count("*"), unknown_models=F.count_if(F.col("model_tier") == "unknown")))
            .crossJoin(count(self.work_unit, work_units=F.count("*"))).crossJoin(count(self.prompt_unit, prompt_units=F.count("*")))
            .crossJoin(count(self._classes, unscored_arcs=F.count_if(F.col("task_complexity") == "Unscored"))).crossJoin(count(self.verdict, verdicts=F.count("*")))
            .crossJoin(count(self._scored, score_zero=F.count_if(F.col("score") == 0)))
            .withColumns({"ran_at": F.lit(self.ran_at), "parse_failures": F.lit(self.parse_failures).cast("long")})
        )


class Reclassified(Derivation):
    """A ledger whose calls, units and tools are there already: only what a classification makes of them is derived."""

    def __init__(self, tables: Tables, records: DataFrame, **more):
        super().__init__(records, tables.raw_event, tables.model_registry, **more)
        self.api_call, self.work_unit, self.prompt_unit, self.tool_call = tables.api_call, tables.work_unit, tables.prompt_unit, tables.tool_call
        self._calls = tables.api_call.withColumnsRenamed(_CALLED)


derive = Derivation
