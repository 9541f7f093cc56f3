"""The ledger on hand-written transcripts: shapes of arcs, order, duplicates, prompts,
tools, privacy, scores, verdicts, views, ingestion, streaming and checks."""

import itertools
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom import cli
from tallyloom import constants as C
from tallyloom.functions import text
from tallyloom.functions.pricing import priced, registry, resolve
from tallyloom.operators import enrich, turns
from tallyloom.operators.prompts import boundaries
from tallyloom.plans import checks, views
from tallyloom.plans.ledger import derive
from tallyloom.sources import store as stores
from tallyloom.sources import transcripts
from tallyloom.streaming import spool
from tallyloom.tables import stored


def answer(session, mid, ts, skill=None, rid=None, usage=(10, 20, 0, 0), model="claude-opus-4-x", content=None, **more):
    keys = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    message = {"id": mid, "model": model, "usage": dict(zip(keys, usage, strict=True)), "content": content or []}
    return {"type": "assistant", "sessionId": session, "requestId": rid or f"r-{mid}", "timestamp": ts, "attributionSkill": skill, "message": message, **more}


def ask(session, ts, content, **more):
    return {"type": "user", "sessionId": session, "timestamp": ts, "message": {"role": "user", "content": content}, **more}


def at(i):
    return f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z"


def write(folder, records, name="s.jsonl"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records) + "\n")


def records_of(spark, tmp_path, records):
    write(tmp_path / "in", records)
    return transcripts.records(transcripts.read_lines(spark, str(tmp_path / "in")))


def shape(spark, tmp_path, skills, session="S"):
    """Arcs of a session whose turns have these skills."""
    rows = [answer(session, f"m{i:03d}", at(i), s) for i, s in enumerate(skills)]
    found = turns.arcs(turns.with_arcs(turns.sequenced(turns.deduplicated(records_of(spark, tmp_path, rows)))))
    return [(r.skill, r.start_turn, r.end_turn) for r in found.orderBy("arc").collect()]


@pytest.mark.parametrize(
    ("skills", "arcs"),
    [
        (["a", "a", None, None, None], [("a", 0, 4)]),
        (["a", None, "b", None], [("a", 0, 1), ("b", 2, 3)]),
        (["a", None, "a", None], [("a", 0, 1), ("a", 2, 3)]),
        ([None, None, "a"], [("a", 2, 2)]),
        (["a", None, "a"], [("a", 0, 1), ("a", 2, 2)]),
        (["a", "a", "a", None, "b", "b", None], [("a", 0, 3), ("b", 4, 6)]),
        ([None, None, None], []),
        (["a", "b", "a", "b"], [("a", 0, 0), ("b", 1, 1), ("a", 2, 2), ("b", 3, 3)]),
        (["", "a", ""], [("a", 1, 2)]),
    ],
)
def test_arc_shapes(spark, tmp_path, skills, arcs):
    assert shape(spark, tmp_path, skills) == arcs


def test_dedup_takes_maxima_first_seen_and_first_skill(spark, tmp_path):
    rows = [
        answer("S", "m1", at(5), None, "r", (1, 9, 2, 0), error=""), answer("S", "m1", at(6), "late", "r", (3, 1, 0, 4), isSidechain=True, error="rate_limit"),
        answer("T", "m1", at(1), "other", "r", (2, 2, 2, 2), model="claude-haiku-3"),
    ]
    (r,) = turns.deduplicated(records_of(spark, tmp_path, rows)).collect()
    assert (r.session, r.ts, r.model, r.skill, r.error_kind, r.sidechain) == ("S", at(5), "claude-opus-4-x", "late", "rate_limit", True)
    assert (r.input_tokens, r.output_tokens, r.cache_write_tokens, r.cache_read_tokens) == (3, 9, 2, 4)


def test_order_of_lines_changes_nothing(spark, tmp_path):
    rows = [answer("S", f"m{i}", at(i // 2), [None, "a", None, "b"][i % 4]) for i in range(12)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = turns.sequenced(turns.deduplicated(records_of(spark, tmp_path / str(seed), rows)))
        seen.add(tuple((r.idx, r.message_id) for r in found.orderBy("idx").collect()))
    assert len(seen) == 1


def test_values_are_conserved_and_rules_differ(spark, tmp_path):
    skills = [None, "a", None, "b", "b", None, "a"]
    rows = [answer("S", f"m{i}", at(i), s, usage=(1000 * i, 7, 3, 11)) for i, s in enumerate(skills)]
    arced = turns.with_arcs(turns.sequenced(turns.deduplicated(records_of(spark, tmp_path, rows))))
    count = lambda rule: [r.claimed for r in turns.claims(arced, rule).orderBy("idx").collect()]
    assert count(turns.arcs(arced)) == [0, 1, 1, 1, 1, 1, 1]
    assert count(turns.to_session_end(arced)) == [0, 1, 1, 2, 2, 2, 3]
    assert count(turns.tagged_only(arced)) == [0, 1, 0, 1, 1, 0, 1]
    ledger = derive(records_of(spark, tmp_path, rows))
    total = sum(1000 * i * 1500 + 7 * 7500 + 3 * 1875 + 11 * 150 for i in range(7))
    assert ledger.work_unit.agg(F.sum("value_e8")).first()[0] == total == ledger.api_call.agg(F.sum("value_e8")).first()[0]


def test_models_resolve_to_the_longest_pattern(spark):
    models = spark.createDataFrame([("claude-haiku-4-5-2",), ("claude-haiku-4",), ("claude-haiku-4",), ("xclaude-opus-4",), ("<synthetic>",), (None,)], "model string")
    assert {r.model: r.pattern for r in resolve(models, registry(spark)).collect()} == {"claude-haiku-4-5-2": "claude-haiku-4-5*", "claude-haiku-4": "claude-haiku-4*", "<synthetic>": "<synthetic>"}
    calls = models.withColumns({c: F.lit(1_000_000) for c in turns.TOKENS})
    found = {r.model: (r.model_tier, r.value_e8) for r in priced(calls, registry(spark)).collect()}
    assert found["claude-haiku-4-5-2"] == ("small", 735 * 1_000_000) and found["xclaude-opus-4"] == ("unknown", 0) == found[None]
    with pytest.raises(LookupError):
        resolve(models, registry(spark).limit(0))


@pytest.mark.parametrize(
    ("content", "more", "expected"),
    [
        ("do it", {}, 1), ("  \n", {}, 0), ([{"type": "text", "text": "x"}], {}, 1), ([{"type": "image"}], {}, 1), ([{"type": "tool_result"}], {}, 0),
        ([{"type": "tool_result"}, {"type": "text", "text": "x"}], {}, 0), ("x", {"isMeta": True}, 0), ("x", {"isSidechain": True}, 0), ([{"type": "odd"}], {}, 0), ([], {}, 0),
    ],
)
def test_prompt_boundaries(spark, tmp_path, content, more, expected):
    assert boundaries(records_of(spark, tmp_path, [ask("S", at(0), content, **more)])).count() == expected


def test_prompts_take_turns_as_of_their_time(spark, tmp_path):
    rows = [answer("S", "m0", at(0)), ask("S", at(1), "one"), answer("S", "m1", at(1)), ask("S", at(2), "two"), ask("S", at(3), "three"), answer("S", "m2", at(9))]
    ledger = derive(records_of(spark, tmp_path, rows))
    assert [r.prompt_unit_id for r in ledger.api_call.orderBy("turn_index").collect()] == [None, "S:prompt:0", "S:prompt:2"]
    assert {r.id for r in ledger.prompt_unit.collect()} == {"S:prompt:0", "S:prompt:2"}


def test_paths_match_pathlib(spark):
    paths = ["a/b.py", "a.tar.gz", ".bashrc", "x/.bashrc", "foo.", "..", "../x.y", "./a//b/", "/", "/a", "src/x", "SRC/x.md", "a/b.c/d", "é/ü.ß", "", "...a", "a..b", " ", "...", "src/.a.b"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.path_class(F.col("p")).alias("c")).collect()
    import hashlib

    short = lambda x: hashlib.sha256(x.encode()).hexdigest()[:8]
    for r in rows:
        q = pathlib.PurePath(r.p)
        parent = q.parent.name if q.parent.name.lower() in C.SAFE_DIRS else short(q.parent.name) if q.parent.name else ""
        leaf = (short(q.stem) if q.stem else "") + q.suffix
        assert r.c == ("" if not r.p else f"{parent}/{leaf}" if parent else leaf), r.p


def test_verbs_branches_projects_hosts(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    lit = F.lit
    assert [one(text.command_verb(lit(c))) for c in ("git push", " /bin/rg x", "acme-tool", "", "  ", "\tls")] == ["git", "rg", "other", "", "", "ls"]
    assert [one(text.branch_kind(lit(b))) for b in ("Fix/secret", "main", "acme/x", "", None)] == ["fix", "main", "other", None, None]
    assert [one(text.project_family(lit(c))) for c in ("/u/p-worktrees/w", "/A/b/worktrees/c", "/u/me/proj/worktrees/x", "worktrees/x", "/u/site", "", None)] == ["p", "A", "me", "x", "site", None, None]
    assert [one(text.repo_of(lit(c))) for c in ("/u/site/", "/", None)] == ["site", "", None]
    assert [one(text.web_host(lit(u))) for u in ("https://h.example/x?y", "h/x", "x//" + "a" * 80)] == ["h.example", "", "a" * 64]
    assert [one(text.debug_language(lit(t))) for t in ("an ERROR here", "éerror", "terror", "why isn't it", "root cause")] == [True, False, False, True, True]
    assert [one(text.self_correction(lit(t))) for t in ("Wait", "awaits", "i misread it", "plain")] == [True, False, True, False]
    assert [one(text.rounded(lit(v).cast("long"), 2)) for v in (500_000, 499_999, 28_500_000, 0)] == [0.01, 0.0, 0.29, 0.0]


def test_every_verdict(spark):
    rank = {t: i for i, t in enumerate(C.TIERS)}
    cells = list(itertools.product(("Retrieval", "Synthesis", "Agentic", "Reasoning"), ("Low", "Medium", "High"), ("routine", "high"), C.TIERS, (0, 1, 2)))
    rows = spark.createDataFrame(cells, "w string, c string, s string, u string, n int").withColumn("e", enrich.expected_tier(F.col("w"), F.col("c"), F.col("s")))
    rows = rows.withColumn("v", enrich.decide(F.col("c"), F.col("s"), enrich.ordinal(F.col("u")) - enrich.ordinal(F.col("e")), F.col("n")))
    for r in rows.collect():
        wanted = min(2, rank[C.TIER_MATRIX[r.w, r.c]] + (r.s == "high"))
        delta = rank[r.u] - wanted
        said = "Underprovisioned" if r.n >= 2 else "Overprovisioned" if delta >= 2 or (delta == 1 and r.c == "Low") else "Acceptable" if delta == 1 else "Justified" if delta == 0 else "Acceptable (high stakes)" if r.s == "high" else "Acceptable"
        assert (rank[r.e], r.v) == (wanted, said)


def use(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


SECRET = "zeus-acquisition"


def corpus():
    yield ask("S", at(0), f"start {SECRET}", cwd=f"/u/{SECRET}")
    yield answer("S", "m0", at(1), content=[use("Bash", command=f"grep {SECRET} x")], cwd="/u/p-worktrees/w", gitBranch=f"fix/{SECRET}")
    yield ask("S", at(10), "why does it fail? the error")
    for i in range(6):
        tools = [use("Bash", command="pytest -q"), use("Edit", file_path=f"{SECRET}/f{i}.py"), use("Task", prompt=SECRET), {"type": "text", "text": "Actually, wait: an error"}]
        yield answer("S", f"n{i}", at(11 + i), "release-prod", content=tools, cwd="/u/p-worktrees/w", usage=(1000, 1000, 0, 0))
    yield answer("S", "n0", at(11), "release-prod", usage=(5, 2000, 0, 0))
    yield answer("S", "k", at(30), "fix-issue", model="gpt-z", cwd="/u/p-worktrees/w")
    yield answer("S", "z", at(31), "fix-issue", model="<synthetic>", usage=(0, 0, 0, 0), error="rate_limit", apiErrorStatus=429)
    yield answer("S", "l", at(40), "loop", cwd="/u/p-worktrees/w", model="claude-haiku-3-5")


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    return derive(records_of(spark, tmp_path_factory.mktemp("corpus"), list(corpus())), ran_at="now", hold=lambda frame: stored(frame, "ledger"))


def test_units_signals_and_verdicts(ledger):
    units = {r.id: r for r in ledger.work_unit.collect()}
    assert list(sorted(units)) == ["S:arc:0", "S:arc:1", "S:arc:2", "S:remainder"]
    assert units["S:arc:0"].turns == 6 and units["S:arc:0"].project_family == "p" and units["S:remainder"].git_branch_kind == "fix"
    classes = {r.unit_id: r for r in ledger.classification.where("unit_grain = 'work_unit'").collect()}
    assert classes["S:arc:0"].signals == '["distinct_files", "debugging_language", "self_correction", "subagent_use", "repeated_test_runs"]'
    assert (classes["S:arc:0"].task_complexity, classes["S:arc:0"].stakes, classes["S:arc:0"].ai_activity) == ("High", "high", "automation")
    assert classes["S:remainder"].task_complexity == "Low" and classes["S:remainder"].ai_activity == "other"
    verdicts = {r.work_unit_id: r for r in ledger.verdict.collect()}
    assert verdicts["S:arc:0"].justification == "Justified" and verdicts["S:remainder"].justification == "Overprovisioned"
    assert "S:arc:1" not in verdicts  # unknown and unbillable models give no tier
    evidence = json.loads(verdicts["S:arc:0"].evidence)
    assert evidence == {"signals": json.loads(classes["S:arc:0"].signals), "score": 5, "prompt_units": 1, "underprovisioned_unreachable": True}
    calls = {r.message_id: r for r in ledger.api_call.collect()}
    assert calls["k"].model_tier == "unknown" and calls["z"].error_kind == "rate_limit" and calls["n0"].output_tokens == 2000


def test_views(ledger, spark):
    views.register(ledger)
    for name in views.VIEWS:
        assert spark.table(name).count() > 0 or name == "v_unscored_arcs", name
    line = spark.sql("select summary from v_work_unit_summary where id = 'S:arc:0'").first()[0]
    assert line == "release-prod · 0m · 6 turns · 6 bash (pytest) · 6 edits · 6 files · 6 subagents"
    assert spark.sql("select sum(pct_of_pool) from v_summary").first()[0] == pytest.approx(100, abs=0.2)
    quality = views.data_quality(ledger).first()
    assert (quality.orphaned_calls, quality.limit_hits, quality.calls_with_unknown_tier, quality.last_normalize) == (0, 1, 1, "now")
    assert views.caveats(ledger).count() == 8


def test_nothing_private_is_derived(ledger, spark):
    for name, table in [*ledger.tables().items(), *((n, v(ledger)) for n, (v, _) in views.VIEWS.items())]:
        for row in table.collect():
            assert SECRET not in json.dumps(row.asDict(), default=str), name


def test_an_arc_without_a_prompt_is_unscored(spark, tmp_path):
    t = derive(records_of(spark, tmp_path, [answer("S", "a", at(0), "loop"), ask("S", at(1), "x"), answer("S", "b", at(2), "design")]))
    found = {r.unit_id: (r.task_complexity, r.complexity_score) for r in t.classification.where("unit_grain = 'work_unit'").collect()}
    assert found == {"S:arc:0": ("Unscored", None), "S:arc:1": ("Low", 0)}
    assert [r.work_unit_id for r in t.verdict.collect()] == ["S:arc:1"]
    assert [r.id for r in views.unscored_arcs(t).collect()] == ["S:arc:0"]


def test_verdicts_of_two_pools(spark, tmp_path):
    own = registry(spark).unionByName(registry(spark).where("pattern = 'claude-opus-4*'").withColumns({"pattern": F.lit("gpt-*"), "pool": F.lit("other-seat"), "tier": F.lit("mid")}))
    t = derive(records_of(spark, tmp_path, list(corpus())), rates=own)
    found = {(r.work_unit_id, r.allowance_pool): r.used_tier for r in t.verdict.collect()}
    assert found["S:arc:1", "other-seat"] == "mid" and ("S:arc:1", "anthropic-seat") not in found


def test_backfill_is_idempotent_and_appends(spark, tmp_path):
    folder, store = tmp_path / "in" / "deep", str(tmp_path / "store")
    same = json.dumps(answer("S", "a", at(0)))
    folder.mkdir(parents=True)
    (folder / "s.jsonl").write_text(f"{same}\n\n{same}\r\nnot json\n[1]\n  {json.dumps({'type': 'user', 'session_id': 'T'})}  \n{json.dumps({'type': 'x'})}\n")
    assert transcripts.backfill(spark, str(tmp_path / "in"), store) == {"files": 1, "lines": 6, "inserted": 6, "duplicates": 0, "unparseable": 1}
    assert transcripts.backfill(spark, str(tmp_path / "in"), store)["inserted"] == 0
    with (folder / "s.jsonl").open("a") as f:
        f.write(same + "\n")
    assert transcripts.backfill(spark, str(tmp_path / "in"), store)["inserted"] == 1
    raw = transcripts.load_store(spark, store)
    assert sorted(r.session_id for r in raw.collect()) == ["S", "S", "S", "T", "s", "s", "s"]
    assert transcripts.parse_failures(raw) == 1 and transcripts.records(raw).count() == 5


def test_spool_equals_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    write(tmp_path / "in", list(corpus())[:4], "a.jsonl")
    spool.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), "1").awaitTermination()
    write(tmp_path / "in", list(corpus())[4:], "b.jsonl")
    spool.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), "2").awaitTermination()
    batch = transcripts.read_lines(spark, str(tmp_path / "in"))
    hashes = lambda t: sorted(r.content_hash for r in t.select("content_hash").collect())
    raw = transcripts.load_store(spark, store)
    assert hashes(raw) == hashes(batch)
    ids = lambda r: sorted(map(tuple, derive(r).work_unit.select("id", "value_e8").collect()))
    assert ids(spool.touched(raw, "2")) == ids(transcripts.records(batch))


def test_touched_sessions_bring_those_they_share_responses_with(spark, tmp_path):
    """``a`` stands in two sessions and counts in the first; deriving the second alone would count it twice."""
    store = str(tmp_path / "store")
    chain = [("S", "a"), ("T", "a"), ("T", "b"), ("U", "b"), ("V", "c")]
    for k, (session, mid) in enumerate(chain):
        write(tmp_path / "in", [answer(session, mid, at(k))], f"{k}.jsonl")
        transcripts.backfill(spark, str(tmp_path / "in"), store, str(k))
    raw = transcripts.load_store(spark, store)
    assert {r.session for r in spool.touched(raw, "3").collect()} == {"S", "T", "U", "V"}
    assert {r.session for r in spool.touched(raw, "4").collect()} == {"V"}
    whole = {(r.session, r.message_id) for r in turns.deduplicated(transcripts.records(raw)).collect()}
    assert {(r.session, r.message_id) for r in turns.deduplicated(spool.touched(raw, "3")).collect()} == whole


def test_store_keeps_the_history_and_the_last_whole_run(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    records = records_of(spark, tmp_path, [ask("S", at(0), "x"), answer("S", "a", at(1), "loop")])
    made = derive(records, ran_at="1", hold=lambda frame: stored(frame, "ledger"))
    assert stores.save(made, store) == 1 and stores.save(made, store) == 2
    runs = stores.load(spark, store).normalize_run.orderBy("run_id").collect()
    assert [r.run_id for r in runs] == [1, 2] and (runs[1].verdicts, runs[1].score_zero, runs[1].unscored_arcs) == (1, 1, 0)
    before = stores.latest(spark, store).folder
    broken = derive(records, ran_at="2")
    broken.verdict = broken.verdict.withColumn("bad", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        stores.save(broken, store)
    t = stores.load(spark, store)  # a rebuild that dies changes nothing
    assert stores.latest(spark, store).folder == before and t.verdict.count() == 1
    assert views.data_quality(t).first().last_normalize == "1"


def test_migrations_run_once_and_failed_ones_again(spark, tmp_path):
    store, ran = str(tmp_path / "store"), []
    fail = [True]

    def second(spark, store):
        ran.append(2)
        if fail.pop():
            raise RuntimeError("half way")

    steps = ((2, "second", second), (1, "first", lambda *_: ran.append(1)))
    fail[:] = [False, True]
    with pytest.raises(RuntimeError):
        stores.migrate(spark, store, "now", steps)
    assert stores.migrate(spark, store, "now", steps) == ["second"] and ran == [1, 2, 2]
    assert stores.migrate(spark, store, "now", steps) == []


def test_command_line_and_checks(spark, tmp_path):
    write(tmp_path / "in", list(corpus()))
    said = []
    run = lambda *a: cli.main([*a, "--store", str(tmp_path / "store"), "--projects", str(tmp_path / "in")], spark, said.append)
    assert run("version") == 0 and run("run") == 0
    assert run("verify") == 1  # nothing to compare with: skipped checks have not passed
    config = tmp_path / "c.toml"
    config.write_text("[reference]\nrelease_target = 0.66\nrelease_runs = 1\nrelease_tolerance = 0.2\nprompt_unit_band = [1, 3]\nduplicate_ratio_band = [0.0, 0.5]\n")
    said.clear()
    assert run("verify", "--config", str(config), "--repo", "P") == 0, said
    config.write_text("[reference]\nrelease_runs = 1\n")
    with pytest.raises(ValueError):
        checks.Reference.load(str(config))
    assert checks.Reference.load(str(tmp_path / "none.toml")) is None
    assert cli.activity_map(None) == C.ACTIVITY_BY_SKILL


def test_empty_ledger(spark, tmp_path):
    t = derive(records_of(spark, tmp_path, [ask("S", at(0), "x")]))
    assert t.work_unit.count() == 0 and views.data_quality(t).first().api_calls == 0
