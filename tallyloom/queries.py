"""The ledger's operators and views as queries over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from . import constants as C
from .functions import text
from .functions.pricing import priced, registry, resolve
from .operators import allowance, delegation, enrich, outcomes, prompts, reconcile, scan, turns
from .oracle import _FIRED, _MATRIX, _RATES, branch_kind, command_verb, over_allowance, over_delegated, over_events, over_headroom, over_limits, over_outcomes, over_sources, over_usage, path_class, vocabulary, web_host
from .plans import checks, ledger, views
from .tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = " ".join(sql.split())


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sizes(spark: SparkSession, sf_dir: str) -> scan.Sizes:
    """Of the usage records' sessions, which bounds those of the turns: a turn is of its first record's session."""
    return scan.sizes(adapters.usage(spark, sf_dir))


def _arced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.walked(turns.deduplicated(adapters.usage(spark, sf_dir)), known=_sizes(spark, sf_dir))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their arcs, values and work units. They are priced first: a value is less to shuffle than what it is made of."""
    known = _sizes(spark, sf_dir)
    calls = priced(turns.deduplicated(adapters.usage(spark, sf_dir)), registry(spark), adapters.usage_models(spark, sf_dir))
    return turns.walked(calls, known=known).withColumn("work_unit_id", ledger.unit_id(F.col("session"), F.col("arc")))


def _claims(rule: Callable[[DataFrame], DataFrame]) -> Query:
    """The claims of a rule, whose arcs and turns are derived once."""

    def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = _sizes(spark, sf_dir)
        arced = turns.walked(turns.deduplicated(adapters.usage(spark, sf_dir)), known=known)
        arced = stored(arced.select("session", "idx", "arc", "skill"), "arced")  # for the rule and for the turns
        return turns.claims(arced, rule(arced), known)

    return claims


def _usage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.work_units(_priced(spark, sf_dir))


def _ledger(spark: SparkSession, sf_dir: str, columns: str | None = None, **more) -> ledger.Derivation:
    """The ledger of a folder's events, derived anew as far as a query asks for it: ``columns`` and ``more`` as Derivation says. What several of its
    tables are made of is stored once in the shared folder; so are the records, whose text and blocks are else put together by each reader."""
    return ledger.derive(stored(adapters.records(spark, sf_dir), "records"), hold=lambda frame: stored(frame, "ledger"), columns=columns and tuple(columns.split()), **more)


def _over_ledger(make: Callable[[ledger.Ledger], DataFrame], columns: str | None = None, once: str = "work_unit", **narrow: str) -> Query:
    return lambda spark, sf_dir: make(_ledger(spark, sf_dir, columns, once=tuple(once.split()), narrow=narrow))


#: What the tables below read of the calls: units, prompts and tools of a classification; their values by tier; what else a unit shows.
_CLASSED = "session ts idx arc skill prompt work_unit_id prompt_unit_id"
_VOTED = f"{_CLASSED} billable model_tier allowance_pool value_e8"
_SHAPED = "session ts idx arc skill cwd branch version value_e8 work_unit_id sidechain error_kind model"
_ALL = f"{_VOTED} cwd branch version sidechain error_kind model"
#: The tools' columns that units and prompts are classed by; the ordinal is left out, and with it a sort of them.
_TOOLED = "work_unit_id prompt_unit_id tool_name target"

_USD = "cast({v} as bigint) / 1e8"
_CENTS = "((cast({v} as bigint) + 500000) // 1000000 * 1000000) / 1e8"
usd = lambda v: _USD.format(v=v)
cents = lambda v: _CENTS.format(v=v)
percent = lambda part, whole: f"cast((2000 * cast({part} as bigint) + cast({whole} as bigint)) // nullif(2 * cast({whole} as bigint), 0) as double) / 10"
_JUDGED = f"'{C.PROVISIONAL}' as classification_status"
_LABEL = f"'{C.VALUE_LABEL}' as value_label"

# --- turns and arcs over lineitem and orders ---------------------------------------

_TURN = ["message_id", "request_id", "session", "ts", "model", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "skill", "sidechain"]
_add("dedup_max", lambda s, d: turns.deduplicated(adapters.usage(s, d)).select(*_TURN), over_usage(f"select {', '.join(_TURN)} from dedup"))
_add("turn_sequence", lambda s, d: turns.sequenced(turns.deduplicated(adapters.usage(s, d)), _sizes(s, d)).select("session", "idx", "message_id", "request_id", "skill"), over_usage("select session, idx, message_id, request_id, skill from turns"))
_add(
    "anchor_runs", lambda s, d: turns.anchor_runs(_arced(s, d)),
    over_usage("""select session, arc, first(skill order by idx) as skill, min(idx) as start_turn, max(idx) as tag_end from
        (select *, bool_or(skill is null) over (partition by session, arc order by idx rows unbounded preceding) as gap from arced where arc >= 0) g where not gap group by session, arc"""),
)
_ARCS = "select session, arc, first(skill order by idx) as skill, min(idx) as start_turn, max(idx) as end_turn from arced where arc >= 0 group by session, arc"
_add("arcs", lambda s, d: turns.arcs(_arced(s, d)), over_usage(_ARCS))
_add("unattributable_turns", lambda s, d: _arced(s, d).where("arc < 0").select("session", "idx", "message_id"), over_usage("select session, idx, message_id from arced where arc < 0"))
_add(
    "tagged_only", lambda s, d: _claims(turns.tagged_only)(s, d).groupBy("claimed").agg(F.count("*").alias("turns")),
    over_usage("""select cast(case when arc >= 0 and not gap then 1 else 0 end as bigint) as claimed, count(*) as turns from
        (select *, bool_or(skill is null) over (partition by session, arc order by idx rows unbounded preceding) as gap from arced) g group by 1"""),
)
_add("baseline_overlap", _claims(turns.to_session_end), over_usage("select session, idx, cast(greatest(arc + 1, 0) as bigint) as claimed from arced"))
_add("claimed_counts", _claims(turns.arcs), over_usage("select session, idx, cast(case when arc >= 0 then 1 else 0 end as bigint) as claimed from arced"))
_UNITS = "select work_unit_id as id, session, arc, case when arc >= 0 then first(skill order by idx) end as anchor_skill, min(idx) as start_turn, max(idx) as end_turn, count(*) as turns, sum(value_e8) as v from priced group by work_unit_id, session, arc"
_add(
    "arc_ledger", lambda s, d: _usage_units(s, d).select("id", "session", "kind", "anchor_skill", "start_turn", "end_turn", "turns", "notional_list_value_usd"),
    over_usage(f"select id, session, case when arc >= 0 then 'arc' else 'unattributable' end as kind, anchor_skill, start_turn, end_turn, turns, {usd('v')} as notional_list_value_usd from ({_UNITS}) u"),
)


def _conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = stored(_priced(spark, sf_dir).select("session", "arc", "idx", "skill", "ts", "cwd", "branch", "version", "value_e8"), "calls")  # for both sums
    units = ledger.work_units(calls).agg(F.sum("value_e8").alias("units_e8"), F.sum("turns").alias("unit_turns"))
    return calls.agg(F.sum("value_e8").alias("calls_e8"), F.count("*").alias("calls")).crossJoin(units)  # one row each


_add("arc_conservation", _conservation, over_usage(f"select * from (select sum(value_e8)::bigint as calls_e8, count(*) as calls from priced) a, (select sum(v)::bigint as units_e8, sum(turns)::bigint as unit_turns from ({_UNITS}) u) b"))


def _routines(units: DataFrame) -> DataFrame:
    return views.routine_ledger(ledger.Ledger(units, units, units, units, units, units, units, units, units))


_ROUTINES = "select anchor_skill as routine, '{pool}' as allowance_pool, count(*) as runs, {usd} as notional_list_value_usd, {mean} as mean_per_run_notional_list_value_usd, sum(turns)::bigint as turns from {units} where {arc} group by anchor_skill"
_add("routine_ledger", lambda s, d: _routines(_usage_units(s, d)), over_usage(_ROUTINES.format(pool=C.POOL, usd=usd("sum(v)"), mean=cents("(sum(v)::bigint // count(*))"), units=f"({_UNITS}) u", arc="arc >= 0")))
_add(
    "pricing_four_fields", lambda s, d: priced(turns.deduplicated(adapters.usage(s, d)), registry(s), adapters.usage_models(s, d)).groupBy("model", "model_tier").agg(F.count("*").alias("calls"), F.sum("value_e8").alias("value_e8")),
    over_usage("select model, model_tier, count(*) as calls, sum(value_e8)::bigint as value_e8 from priced group by model, model_tier"),
)
_add(
    "duplicate_ratio", lambda s, d: adapters.usage(s, d).agg(F.count("*").alias("raw")).crossJoin(turns.deduplicated(adapters.usage(s, d)).agg(F.count("*").alias("unique_calls"))).withColumn("duplicates", F.col("raw") - F.col("unique_calls")),
    over_usage("select raw, unique_calls, raw - unique_calls as duplicates from (select count(*) as raw from records) a, (select count(*) as unique_calls from dedup) b"),
)

# --- the whole ledger over events --------------------------------------------------

_add("prompt_boundaries", lambda s, d: prompts.boundaries(adapters.records(s, d)).select("session", "ts", "prompt"), over_events("select session, ts, cast(prompt as int) as prompt from marks"))
_CALLS = "id session message_id request_id work_unit_id prompt_unit_id turn_index model model_tier allowance_pool billable input_tokens output_tokens cache_write_tokens cache_read_tokens error_kind api_error_status".split()
_add("api_calls", _over_ledger(lambda t: t.api_call.select(*_CALLS, "notional_list_value_usd"), once="calls prompt_unit tool_call classes work_unit"), over_events(f"select message_id || '|' || request_id as id, {', '.join(_CALLS[1:])}, {usd('value_e8')} as notional_list_value_usd from api_call"))
_add("prompt_assign_asof", _over_ledger(lambda t: t.api_call.select("session", "turn_index", "prompt_unit_id"), "session idx prompt_unit_id", once="calls"), over_events("select session, turn_index, prompt_unit_id from api_call"))
_UNIT = "id session kind anchor_skill start_turn end_turn turns started_at ended_at repo project_family git_branch_kind allowance_pool".split()
_add("work_units", _over_ledger(lambda t: t.work_unit.select(*_UNIT, "notional_list_value_usd"), once="calls prompt_unit tool_call classes work_unit"), over_events(f"select {', '.join(_UNIT)}, {usd('value_e8')} as notional_list_value_usd from work_unit"))
_PROMPT = "id session work_unit_id start_turn end_turn turns repo project_family has_debug_language has_self_correction".split()
_add("prompt_units", _over_ledger(lambda t: t.prompt_unit.select(*_PROMPT), "session ts idx arc prompt cwd work_unit_id", once="calls prompt_unit"), over_events(f"select {', '.join(_PROMPT)} from prompt_unit"))
_TOOL = "id session work_unit_id prompt_unit_id tool_name target turn_index".split()
_add("tool_asof", _over_ledger(lambda t: t.tool_call.select(*_TOOL), "session ts idx work_unit_id prompt_unit_id", once="calls tool_call"), over_events(f"select {', '.join(_TOOL[:-1])}, cast(turn_index as int) as turn_index from tool_call"))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.records(spark, sf_dir)
    return prompts.language(rows, prompts.boundaries(rows)).select("session", F.col("prompt").cast("long").alias("prompt"), "debug_share", "correction_share")


_add("language_share", _language, over_events("select session, cast(mark as bigint) as prompt, cast(d as double) as debug_share, cast(c as double) as correction_share from shares"))
_add(
    "six_signals", _over_ledger(lambda t: t.classification.where("unit_grain = 'prompt_unit'").select(F.col("unit_id").alias("id"), "complexity_score", "task_complexity", "signals"), _CLASSED, once="prompt_unit tool_call classes work_unit"),
    over_events("""select id, cast(len(fired) as int) as complexity_score, case when len(fired) = 0 then 'Low' when len(fired) <= 2 then 'Medium' else 'High' end as task_complexity,
        '[' || array_to_string(list_transform(fired, lambda x: '"' || x || '"'), ', ') || ']' as signals from fired"""),
)
_CLASS = "ai_activity work_type task_complexity stakes complexity_score signals provenance".split()
_add("classification", _over_ledger(lambda t: t.classification.where("unit_grain = 'work_unit'").select(F.col("unit_id").alias("id"), *_CLASS), _CLASSED, once="prompt_unit classes work_unit", tool_call=_TOOLED), over_events(f"select id, {', '.join(_CLASS)} from classification"))
_add("complexity_bucket", _over_ledger(lambda t: t.classification.where("unit_grain = 'work_unit'").groupBy("task_complexity").agg(F.count("*").alias("units")), _CLASSED, once="prompt_unit classes work_unit", tool_call=_TOOLED), over_events("select task_complexity, count(*) as units from classification group by 1"))
_VERDICT = "allowance_pool justification expected_tier used_tier max_tier tier_delta evidence".split()
_add("verdicts", _over_ledger(lambda t: t.verdict.select(F.col("work_unit_id").alias("id"), *_VERDICT), _VOTED, once="prompt_unit classes work_unit", tool_call=_TOOLED), over_events(f"select id, {', '.join(_VERDICT)} from verdict"))
_add("tier_vote_per_pool", _over_ledger(lambda t: enrich.tier_votes(t.api_call).withColumnRenamed("work_unit_id", "id"), "work_unit_id billable model_tier allowance_pool value_e8", once="calls"), over_events("select id, allowance_pool, used_tier, max_tier from voted"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of work type, complexity, stakes and used tier with none, one or two signals."""
    kinds = spark.createDataFrame(sorted({(w,) for w, _ in C.TIER_MATRIX}), "work_type string")
    axes = [("task_complexity", ["Low", "Medium", "High"]), ("stakes", ["routine", "high"]), ("used_tier", list(C.TIERS)), ("under_signals", [0, 1, 2])]
    rows = kinds.select("*", *[F.array(*map(F.lit, v)).alias(k) for k, v in axes])
    for name, _ in axes:
        rows = rows.withColumn(name, F.explode(name))
    rows = rows.withColumn("expected_tier", enrich.expected_tier(F.col("work_type"), F.col("task_complexity"), F.col("stakes")))
    rows = rows.withColumn("tier_delta", enrich.ordinal(F.col("used_tier")) - enrich.ordinal(F.col("expected_tier")))
    return rows.withColumn("justification", enrich.decide(F.col("task_complexity"), F.col("stakes"), F.col("tier_delta"), F.col("under_signals")))


_add("verdict_matrix", _matrix, f"""with matrix(work_type, task_complexity, tier) as (values {_MATRIX}), tiers(tier, rank) as (values ('small', 0), ('mid', 1), ('frontier', 2)),
    cells as (select m.work_type, m.task_complexity, s.stakes, u.tier as used_tier, n.under_signals, u.rank as used, least(t.rank + case when s.stakes = 'high' then 1 else 0 end, 2) as wanted
        from matrix m join tiers t using (tier), (values ('routine'), ('high')) s(stakes), tiers u, (values (0), (1), (2)) n(under_signals))
    select work_type, task_complexity, stakes, used_tier, under_signals, w.tier as expected_tier, used - wanted as tier_delta,
        case when under_signals >= 2 then 'Underprovisioned' when used - wanted >= 2 or (used - wanted = 1 and task_complexity = 'Low') then 'Overprovisioned' when used - wanted = 1 then 'Acceptable'
            when used = wanted then 'Justified' when stakes = 'high' then 'Acceptable (high stakes)' else 'Acceptable' end as justification from cells join tiers w on w.rank = wanted""")

# --- views --------------------------------------------------------------------------

_add("v_caveats", lambda s, d: s.createDataFrame(views.CAVEATS, "caveat string, summary string, detail string"), "select * from (values " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in views.CAVEATS) + ") v(caveat, summary, detail)")
_add("v_prompt_unit_value", _over_ledger(views.prompt_unit_value, "session idx prompt cwd work_unit_id prompt_unit_id allowance_pool value_e8", once="prompt_unit"), over_events(f"select p.id as prompt_unit_id, p.session, p.work_unit_id, p.repo, p.turns, a.allowance_pool, {usd('sum(a.value_e8)')} as notional_list_value_usd, count(*) as api_calls from prompt_unit p join api_call a on a.prompt_unit_id = p.id group by all"))
_JOINED = "work_unit w join classification c using (id) left join verdict v on v.id = w.id and v.allowance_pool = w.allowance_pool"
_add("v_activity_ledger", _over_ledger(views.activity_ledger, _VOTED, once="prompt_unit", tool_call=_TOOLED, work_unit="id anchor_skill allowance_pool value_e8"), over_events(f"select ai_activity, w.allowance_pool, work_type, c.task_complexity, used_tier, justification, count(distinct w.id) as work_units, {usd('sum(value_e8)')} as notional_list_value_usd, {_JUDGED} from {_JOINED} group by 1, 2, 3, 4, 5, 6"))
_OTHER = "sum(case when ai_activity = 'other' then value_e8 else 0 end)"
_add("v_activity_other_share", _over_ledger(views.activity_other_share, _VOTED, once="prompt_unit tool_call classes", work_unit="id anchor_skill allowance_pool value_e8"), over_events(f"select allowance_pool, {usd(_OTHER)} as other_notional_list_value_usd, {usd('sum(value_e8)')} as total_notional_list_value_usd, {percent(_OTHER, 'sum(value_e8)')} as other_pct, cast(10 as double) as review_threshold_pct from work_unit join classification using (id) group by allowance_pool"))
_add("v_work_type_distribution", _over_ledger(views.work_type_distribution, _VOTED, once="prompt_unit tool_call classes", work_unit="id anchor_skill allowance_pool value_e8"), over_events(f"select work_type, provenance, allowance_pool, count(*) as work_units, {usd('sum(value_e8)')} as notional_list_value_usd from work_unit join classification using (id) group by 1, 2, 3"))
_add("v_unattributable", _over_ledger(views.unattributable, "session arc idx skill value_e8", once="calls work_unit"), over_events(f"select session, allowance_pool, turns, {usd('value_e8')} as notional_list_value_usd, 'work before a session first anchor, or a session with no anchor at all' as why from work_unit where kind = 'unattributable'"))
_add("v_routine_ledger", _over_ledger(views.routine_ledger, "session arc idx skill value_e8", once="calls work_unit"), over_events(_ROUTINES.format(pool=C.POOL, usd=usd("sum(value_e8)"), mean=cents("(sum(value_e8)::bigint // count(*))"), units="work_unit", arc="kind = 'arc'")))
_add(
    "v_data_quality", _over_ledger(lambda t: views.data_quality(t).drop("last_ingest", "last_normalize")),
    over_events("""select (select count(*) from records) as raw_events, (select count(distinct session) from records) as sessions, (select count(*) from api_call) as api_calls, (select count(*) from work_unit) as work_units, cast(0 as bigint) as degraded_work_units,
        cast(0 as bigint) as parse_failures_last_run, (select count(*) from classification where task_complexity = 'Unscored') as unscored_arcs_last_run, (select count(*) from api_call where model_tier = 'unknown') as unknown_models_last_run,
        (select count(*) from api_call where model_tier = 'unknown') as calls_with_unknown_tier, cast(0 as bigint) as orphaned_calls, (select count(*) from api_call where error_kind is not null) as error_records,
        (select count(*) from api_call where error_kind = 'rate_limit') as limit_hits, (select max(started_at) from api_call) as last_api_call"""),
)
_add("v_unscored_arcs", _over_ledger(views.unscored_arcs, "session idx arc skill cwd value_e8 work_unit_id prompt_unit_id"), over_events(f"select id, session, anchor_skill, project_family, turns, allowance_pool, {usd('value_e8')} as notional_list_value_usd, 'no prompt unit covers this arc' as why from work_unit join classification using (id) where task_complexity = 'Unscored'"))
_add("v_work_unit_ledger", _over_ledger(views.work_unit_ledger, _VOTED + " cwd", once="prompt_unit", tool_call=_TOOLED), over_events(f"select w.id, ai_activity, anchor_skill as routine, project_family, kind, turns, c.task_complexity, complexity_score, signals, justification, expected_tier, used_tier, max_tier, tier_delta, w.allowance_pool, {usd('value_e8')} as notional_list_value_usd, {_JUDGED}, {_LABEL} from {_JOINED}"))
_SHAPE = f"""select w.id, w.session, w.kind, w.anchor_skill, w.project_family, w.repo, w.git_branch_kind, w.turns, w.started_at, w.ended_at,
    cast(round((epoch_us(cast(replace(w.ended_at, 'Z', '') as timestamp)) - epoch_us(cast(replace(w.started_at, 'Z', '') as timestamp))) / 6e7) as bigint) as elapsed_minutes,
    coalesce(tool_calls, 0) as tool_calls, coalesce(bash_calls, 0) as bash_calls, coalesce(edit_calls, 0) as edit_calls, coalesce(subagent_calls, 0) as subagent_calls, coalesce(distinct_files, 0) as distinct_files,
    coalesce(sidechain_calls, 0) as sidechain_calls, coalesce(rate_limit_hits, 0) as rate_limit_hits, coalesce(distinct_models, 0) as distinct_models, w.allowance_pool, w.value_e8, {usd('w.value_e8')} as notional_list_value_usd
    from work_unit w left join (select work_unit_id as id, count(*) as tool_calls, count(*) filter (where tool_name = 'Bash') as bash_calls, count(*) filter (where tool_name in ('Edit', 'Write', 'NotebookEdit')) as edit_calls,
        count(*) filter (where tool_name in ('Task', 'Agent')) as subagent_calls, count(distinct target) filter (where contains(target, '/')) as distinct_files from tool_call group by 1) t on t.id = w.id
    left join (select work_unit_id as id, count(*) filter (where sidechain) as sidechain_calls, count(*) filter (where error_kind = 'rate_limit') as rate_limit_hits, count(distinct model) as distinct_models from api_call group by 1) a on a.id = w.id"""
_VERBS = "select work_unit_id, string_agg(target, '/' order by rank) as top_verbs from (select *, row_number() over (partition by work_unit_id order by n desc, target) as rank from (select work_unit_id, target, count(*) as n from tool_call where tool_name = 'Bash' and target <> 'other' and work_unit_id is not null group by 1, 2) x) y where rank <= 3 group by 1"
_add("v_work_unit_shape", _over_ledger(views.work_unit_shape, _SHAPED, once="tool_call work_unit"), over_events(_SHAPE))
_add("v_work_unit_verbs", _over_ledger(views.work_unit_verbs, "session ts idx work_unit_id", once="calls tool_call"), over_events(_VERBS))
_SUMMARY = f"""select s.id, coalesce(s.anchor_skill, '(no routine)') as routine, c.ai_activity, c.task_complexity, v.justification, {cents('s.value_e8')} as notional_list_value_usd,
    case when s.kind = 'unattributable' then 'unattributed work in this session' else coalesce(s.anchor_skill, 'untagged work') end || ' · ' || case when elapsed_minutes is null then 'unknown span' when elapsed_minutes < 60 then elapsed_minutes || 'm'
        when elapsed_minutes < 2880 then (elapsed_minutes // 60) || 'h' else (elapsed_minutes // 1440) || 'd' end || ' · ' || s.turns || ' turns' || case when bash_calls > 0 then ' · ' || bash_calls || ' bash' else '' end
        || case when top_verbs is not null then ' (' || top_verbs || ')' else '' end || case when edit_calls > 0 then ' · ' || edit_calls || ' edits' else '' end || case when distinct_files > 0 then ' · ' || distinct_files || ' files' else '' end
        || case when subagent_calls > 0 then ' · ' || subagent_calls || ' subagents' else '' end || case when rate_limit_hits > 0 then ' · HIT LIMIT' else '' end as summary,
    s.project_family, s.git_branch_kind, s.elapsed_minutes, s.turns, s.tool_calls, s.distinct_files, s.subagent_calls, s.started_at, s.allowance_pool, {_JUDGED}, {_LABEL}
    from ({_SHAPE}) s left join ({_VERBS}) b on b.work_unit_id = s.id left join classification c on c.id = s.id left join verdict v on v.id = s.id and v.allowance_pool = s.allowance_pool"""
_add("v_work_unit_summary", _over_ledger(views.work_unit_summary, _ALL, once="prompt_unit", tool_call=_TOOLED), over_events(_SUMMARY))
_add(
    "v_verdict_readable", _over_ledger(views.verdict_readable, _ALL, once="prompt_unit", tool_call=_TOOLED),
    over_events(f"""select coalesce(w.anchor_skill, '(no routine)') as routine, c.ai_activity, v.justification as verdict, s.summary as what_happened,
        case v.justification when 'Overprovisioned' then 'used ' || used_tier || ' where ' || work_type || '/' || c.task_complexity || ' expects ' || expected_tier || ' — ' || tier_delta || ' tier' || case when tier_delta = 1 then '' else 's' end || ' above'
            when 'Justified' then 'used ' || used_tier || ', which is exactly what ' || work_type || '/' || c.task_complexity || ' expects'
            when 'Acceptable' then case when tier_delta > 0 then 'used ' || used_tier || ' against an expected ' || expected_tier || ' — a mild overshoot, not an overspend' else 'used ' || used_tier || ' below the expected ' || expected_tier || ' and the work completed — a downgrade that worked' end
            when 'Acceptable (high stakes)' then 'used ' || used_tier || ' below the expected ' || expected_tier || ' on HIGH-STAKES work — a risk flag for review, not a saving' else v.justification end as reasoning,
        case when c.signals = '[]' then 'no complexity signal fired (score 0 of 6)' else 'score ' || complexity_score || ' of 6: ' || replace(replace(replace(c.signals, '[', ''), ']', ''), '"', '') end as evidence,
        {cents('w.value_e8')} as notional_list_value_usd, expected_tier, used_tier, max_tier, tier_delta, w.project_family, w.turns, v.allowance_pool, w.started_at, '{C.RULES_VERSION}' as rules_version, {_JUDGED}, {_LABEL},
        'Underprovisioned is never emitted by this slice — see v_caveats' as known_gap, v.id as work_unit_id
        from verdict v join work_unit w on w.id = v.id left join classification c on c.id = v.id left join ({_SUMMARY}) s on s.id = v.id"""),
)
_OVER = "case when justification = 'Overprovisioned' then {x} else 0 end"
_add(
    "v_summary", _over_ledger(views.summary, _VOTED, once="prompt_unit", tool_call=_TOOLED, work_unit="id anchor_skill allowance_pool turns value_e8"),
    over_events(f"""select allowance_pool, ai_activity, work_units, turns, {cents('v')} as notional_list_value_usd, {percent('v', 'sum(v) over (partition by allowance_pool)')} as pct_of_pool, overprovisioned_units, {cents('o')} as overprovisioned_notional_usd,
        'upper bound — assumes the cheaper tier finishes in the same tokens' as overprovisioned_caveat, {_LABEL}, {_JUDGED} from
        (select w.allowance_pool, ai_activity, count(*) as work_units, sum(turns)::bigint as turns, sum(value_e8)::bigint as v, sum({_OVER.format(x=1)})::bigint as overprovisioned_units, sum({_OVER.format(x='value_e8')})::bigint as o from {_JOINED} group by 1, 2) g"""),
)

# --- checks -------------------------------------------------------------------------

_add("check_arc_overlap", _over_ledger(lambda t: checks.overlapping_turns(t).agg(F.count("*").alias("overlaps"))), over_events("select count(*) as overlaps from (select session, turn_index from api_call group by 1, 2 having count(distinct work_unit_id) > 1) x"))
_add("first_n_runs", _over_ledger(lambda t: checks.first_runs(t, "release-prod", 10).select("id", "started_at", "notional_list_value_usd"), "session ts idx arc skill value_e8", once="calls work_unit"), over_events(f"select id, started_at, {usd('value_e8')} as notional_list_value_usd from work_unit where kind = 'arc' and anchor_skill = 'release-prod' order by started_at, id limit 10"))
_add(
    "check_reported", _over_ledger(lambda t: t.verdict.agg(F.count_if(F.col("max_tier") != F.col("used_tier")).alias("mixed"), F.count("*").alias("verdicts")).crossJoin(t.api_call.agg(F.count_if(F.col("model_tier") == "frontier").alias("frontier"), F.sum(F.when(F.col("model_tier") == "frontier", F.col("value_e8"))).alias("frontier_e8"))), _VOTED, once="prompt_unit classes work_unit", tool_call=_TOOLED),
    over_events("select * from (select count(*) filter (where max_tier <> used_tier) as mixed, count(*) as verdicts from verdict) a, (select count(*) filter (where model_tier = 'frontier') as frontier, cast(sum(value_e8) filter (where model_tier = 'frontier') as bigint) as frontier_e8 from api_call) b"),
)

# --- reports ------------------------------------------------------------------------

_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("input_tokens", "cache_write_tokens", "cache_read_tokens"))
_add("cache_efficiency", _over_ledger(lambda t: outcomes.cache_efficiency(t.api_call)), over_events(f"select *, (1000 * cache_read_tokens) // nullif(input_tokens + cache_write_tokens + cache_read_tokens, 0) as cached_per_mille from (select allowance_pool, model, count(*) as calls, {_SUMS} from api_call group by 1, 2) x"))
_add(
    "cohort_turns", _over_ledger(lambda t: outcomes.cohorts(t.work_unit, t.classification), _CLASSED, once="prompt_unit tool_call", work_unit="id anchor_skill turns", classes="unit_id unit_grain ai_activity work_type"),
    over_events("select ai_activity, work_type, id, turns, p75_turns, turns > 1.5 * p75_turns as turn_excess from work_unit join classification using (id) join (select ai_activity, work_type, cast(quantile_cont(turns, 0.75) as double) as p75_turns from work_unit join classification using (id) group by 1, 2) p using (ai_activity, work_type)"),
)
_add(
    "limit_episodes", _over_ledger(lambda t: outcomes.limit_episodes(t.api_call)),
    over_events("""select allowance_pool, session, episode, count(*) as hits, min(started_at) as first_hit, max(started_at) as last_hit from
        (select *, cast(sum(new) over (partition by allowance_pool, session order by us rows unbounded preceding) as bigint) as episode from
            (select *, case when us - lag(us) over (partition by allowance_pool, session order by us) <= 3600000000 then 0 else 1 end as new from
                (select allowance_pool, session, started_at, epoch_us(cast(replace(started_at, 'Z', '') as timestamp)) as us from api_call where error_kind = 'rate_limit') h) n) e group by 1, 2, 3"""),
)

# --- outcome signals, allowances, reconciliation ---------------------------------------

_LIST = """'[' || array_to_string(list_transform(fired, lambda x: '"' || x || '"'), ', ') || ']'"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).outcome_signal.withColumn("fired", text.json_list(F.col("fired")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir, outcomes=True).verdict.select(F.col("work_unit_id").alias("id"), *_VERDICT)


_add("outcome_signals", _outcomes, over_outcomes(f"select {_FIRED}, {_LIST} as fired from outcome_signal"))
_SIGNALS = "', \"outcome_signals\": ' || " + _LIST + " || '}'"
_add(
    "verdicts_with_outcomes", _judged,
    over_outcomes(f"""select v.id, allowance_pool, case when len(fired) >= 2 then 'Underprovisioned' else justification end as justification, expected_tier, used_tier, max_tier, tier_delta,
        replace(evidence, ', "underprovisioned_unreachable": true}}', '') || {_SIGNALS} as evidence from verdict v join outcome_signal o on o.work_unit_id = v.id"""),
)


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allowance.trailing_use(_ledger(spark, sf_dir).api_call)


_add("allowance_windows", lambda s, d: _used(s, d).drop("value_e8"), over_allowance("select id, allowance_pool, limited, \"at\", used_5h_e8, used_week_e8 from in_use"))
_add("allowance_capacity", lambda s, d: allowance.capacities(_used(s, d)), over_allowance("select * from ceiling"))
_add("allowance_fitted", lambda s, d: allowance.fitted(_used(s, d)), over_allowance("select id, allowance_pool, \"at\", used_5h_e8, used_week_e8, max(used_5h_e8) over w as capacity_5h_e8, max(used_week_e8) over w as capacity_week_e8 from in_use where limited window w as (partition by allowance_pool order by \"at\", id rows unbounded preceding)"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = stored(_used(spark, sf_dir), "used")
    return allowance.shares(used, allowance.capacities(used))


_WIDE = "(select allowance_pool, max(capacity_e8) filter (where \"window\" = '5h') as c5, max(capacity_e8) filter (where \"window\" = 'week') as cw from ceiling group by 1) c"
_add("allowance_shares", _shares, over_allowance(f"select id, allowance_pool, \"at\", (1000000 * used_5h_e8) // nullif(c5, 0) as share_5h_ppm, (1000000 * used_week_e8) // nullif(cw, 0) as share_week_ppm from in_use join {_WIDE} using (allowance_pool)"))
_add("reconciliation", lambda s, d: reconcile.reconciled(*adapters.sources(s, d)), over_sources("select * from reconciled"))
_TOKENS = "(input_tokens + output_tokens + cache_write_tokens + cache_read_tokens)"
_add(
    "reconciliation_coverage", lambda s, d: reconcile.coverage(reconcile.reconciled(*adapters.sources(s, d))),
    over_sources(f"select *, 100 * delta > 2 * tokens as alarm from (select sources, count(*) as records, sum({_TOKENS})::bigint as tokens, coalesce(sum(abs(reconciliation_delta)), 0)::bigint as delta from reconciled group by 1) x"),
)

_add("limit_resets", lambda s, d: outcomes.limit_resets(adapters.records(s, d)), over_limits('select "limit", resets_at, count(*) as hits, count(distinct session) as sessions, min(ts) as first_hit, max(ts) as last_hit from resets group by "limit", resets_at, alone'))
_add(
    "headroom", _over_ledger(lambda t: outcomes.headroom(t.api_call, t.verdict, t.model_registry)),
    over_headroom("select h.*, cast(reclaimable_e8::hugeint * 1000000 // nullif(pool_e8, 0) as bigint) as share_ppm, true as upper_bound from headroom h join pools using (headroom_pool)"),
)
_add(
    "delegated_calls", lambda s, d: delegation.attributed(*adapters.delegated(s, d)),
    over_delegated("""select d.id as delegation_id, a.id as agent_id, parent_prompt_id, coalesce(d.cwd, a.cwd) as cwd, coalesce(d.ts, a.ts) as ts, tokens, coalesce(trust, 'none') as trust, a.id is null as orphaned
        from delegations d left join given2 g on g.delegation_id = d.id full join agent_runs a on a.id = g.agent_id"""),
)

# --- scalar functions ----------------------------------------------------------------

_PATHS = "source || '/' || lang || '/' || cast(doc_id as varchar) || case when doc_id % 3 = 0 then '.tar.gz' when doc_id % 3 = 1 then '.md' else '' end"
_add("path_class", lambda s, d: _table(s, d, "documents").select("doc_id", text.path_class(F.expr(_PATHS.replace("varchar", "string"))).alias("target")), f"select doc_id, {path_class('p')} as target from (select doc_id, {_PATHS} as p from documents) x")
_COMMAND = "case when p_partkey % 5 = 0 then '  /usr/bin/git  status' when p_partkey % 5 = 1 then 'pytest -q x' when p_partkey % 5 = 2 then lower(p_name) when p_partkey % 5 = 3 then ' ' else './' || p_brand || '/jq .' end"
_add("command_verb", lambda s, d: _table(s, d, "part").select("p_partkey", text.command_verb(F.expr(_COMMAND)).alias("verb")), f"select p_partkey, {command_verb('c')} as verb from (select p_partkey, {_COMMAND} as c from part) x")
_BRANCH = "case n_nationkey % 5 when 0 then ' Fix/' || n_name when 1 then n_name when 2 then 'MAIN' when 3 then '' end"
_add("branch_kind", lambda s, d: _table(s, d, "nation").select("n_nationkey", text.branch_kind(F.expr(_BRANCH)).alias("kind")), f"select n_nationkey, {branch_kind('b')} as kind from (select n_nationkey, {_BRANCH} as b from nation) x")
_add("url_host", lambda s, d: _table(s, d, "pages").select("page_id", text.web_host(F.col("url")).alias("host")), f"select page_id, {web_host('url')} as host from pages")
_add(
    "vocabulary", lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", text.debug_language(F.col("text")).alias("debug"), text.self_correction(F.col("text")).alias("correction"), text.speaks(F.col("text"), r"\b(?:the|nicht|qui)\b").alias("common")),
    f"select conv_id, turn, regexp_matches(text, '{vocabulary(C.DEBUG_LANGUAGE)}') as debug, regexp_matches(text, '{vocabulary(C.SELF_CORRECTION)}') as correction, regexp_matches(text, '{vocabulary('(?:the|nicht|qui)')}') as common from conversations",
)
_MODEL = "case when n_nationkey % 4 = 0 then 'claude-haiku-4-5-' || n_name when n_nationkey % 4 = 1 then 'claude-haiku-4' when n_nationkey % 4 = 2 then 'claude-opus-5x' else n_name end"
_add(
    "registry_longest_glob", lambda s, d: resolve(_table(s, d, "nation").select(F.expr(_MODEL).alias("model")), registry(s)).select("model", "pattern", "tier", "in_cents"),
    f"with rates(pattern, tier, billable, i, o, w, r) as (values {_RATES}) select model, replace(pattern, '%', '*') as pattern, tier, cast(i as bigint) as in_cents from (select distinct {_MODEL} as model from nation) m join rates on model like pattern qualify row_number() over (partition by model order by length(pattern) desc) = 1",
)
