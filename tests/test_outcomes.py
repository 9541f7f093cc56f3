"""Outcome signals, allowance windows and reconciliation against brute force; queries see the tables as they are."""

import hashlib
import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_ledger import answer, ask, at, records_of, write

import __spark_entry__ as entry
from tallyloom import cli
from tallyloom.operators import allowance, outcomes, reconcile
from tallyloom.plans import checks, views
from tallyloom.plans.ledger import derive
from tallyloom.sources import store as stores
from tallyloom.sources import transcripts
from tallyloom.streaming import spool
from tallyloom.tables import stored

DATA = "/root/testdata/sf0.001"


def test_a_query_sees_a_folder_that_has_changed(spark, tmp_path):
    """In one session: all events, then half of them."""
    events = pq.read_table(f"{DATA}/events.parquet")
    path = tmp_path / "events.parquet"
    pq.write_table(events, path)
    whole = entry.queries()["api_calls"](spark, str(tmp_path)).count()
    path.unlink()
    pq.write_table(events.slice(0, events.num_rows // 2), path)
    spark.catalog.clearCache()
    half = entry.queries()["api_calls"](spark, str(tmp_path)).count()
    (tmp_path / "other").mkdir()
    pq.write_table(events.slice(0, events.num_rows // 2), tmp_path / "other/events.parquet")
    assert whole > half == entry.queries()["api_calls"](spark, str(tmp_path / "other")).count()


def test_derivations_ask_for_no_more_than_they_need(spark, tmp_path):
    """A table's ancestors are stored, others aren't."""
    held = []
    made = derive(records_of(spark, tmp_path, [answer("S", "m1", at(1), "a"), ask("S", at(0), "hello")]), hold=lambda frame: held.append(frame.columns) or frame)
    assert made.work_unit.count() == 1 and len(held) == 1
    assert made.prompt_unit.count() == 1 and len(held) == 2
    assert made.verdict.count() == 1 and len(held) == 4 and "outcome_signal" not in made.tables()


# outcome signals -------------------------------------------------------------------


def tool(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


def result(error):
    return {"type": "tool_result", "is_error": error, "content": "x"}


def struggle(session, base=0):
    """A unit in which most signals fire: edits of one file, errors, a higher tier, corrections, a repeated prompt, then an interruption."""
    rows = [ask(session, at(base), "please make the parser faster than before")]
    rows += [answer(session, f"{session}{i}", at(base + 1 + i), "fix-issue" if not i else None, model="claude-haiku-4-5-1" if i < 5 else "claude-opus-4-x", content=[tool("Read", file_path="src/a.py")]) for i in range(12)]
    rows += [ask(session, at(base + 3), [result(True), result(True), result(False)]), ask(session, at(base + 4), [result(True)])]
    rows += [ask(session, at(base + 5), "Actually, that's wrong"), ask(session, at(base + 7), "wait, revert it"), ask(session, at(base + 8), "Please make the PARSER faster than before!")]
    rows += [ask(session, at(base + 20), [{"type": "text", "text": "[Request interrupted by user]"}])]
    return rows


def calm(session, n=3, base=0):
    rows = [ask(session, at(base), f"do thing {session}")]
    return rows + [answer(session, f"{session}{i}", at(base + 1 + i), "fix-issue" if not i else None, model="claude-haiku-4-5-1", content=[tool("Edit", file_path="src/b.py"), tool("Bash", command="git commit")]) for i in range(n)]


def test_outcome_signals(spark, tmp_path):
    rows = struggle("A") + [r for i in range(8) for r in calm(f"B{i}", 3 + i % 2)]
    made = derive(records_of(spark, tmp_path, rows), outcomes=True)
    found = {r.work_unit_id: r for r in made.outcome_signal.collect()}
    a = found["A:arc:0"]
    assert (a.turns, a.tool_calls, a.tool_errors, a.edit_thrash, a.user_interrupted, a.model_escalated, a.corrective_turns, a.prompt_restated, a.completed) == (12, 12, 3, 0, 1, 1, 2, 1, False)
    assert a.fired == ["turn_excess", "tool_error_rate", "model_escalated", "corrective_turns", "prompt_restated", "abandoned"]
    assert all(r.fired == (["edit_thrash"] if r.edit_thrash >= 4 else []) for k, r in found.items() if k != "A:arc:0")
    judged = {r.work_unit_id: r for r in made.verdict.collect()}
    assert {k: r.justification == "Underprovisioned" for k, r in judged.items()} == {k: k == "A:arc:0" for k in judged}
    assert '"outcome_signals": ["turn_excess", "tool_error_rate"' in judged["A:arc:0"].evidence and "unreachable" not in judged["A:arc:0"].evidence
    plain = {r.work_unit_id: r for r in derive(records_of(spark, tmp_path / "2", rows)).verdict.collect()}
    assert all(r.justification != "Underprovisioned" and "unreachable" in r.evidence for r in plain.values())


def test_restatements_look_back_a_bounded_number_of_prompts(spark, tmp_path):
    """Each of many prompts of one session meets those of its block and the next only, and finds what brute force finds."""
    rnd = random.Random(4)
    said = [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "Ff"]) for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    rows = [answer("S", "m", at(0), "a")] + [x for i, s in enumerate(said) for x in (ask("S", at(2 * i + 1), s), answer("S", f"m{i}", at(2 * i + 2)))]
    records = records_of(spark, tmp_path, rows)
    made = derive(records)
    got = outcomes.restatements(records, made.prompt_unit).collect()
    words = [set(s.lower().split()) for s in said]
    spoken = [i for i, w in enumerate(words) if w]
    place = {i: n for n, i in enumerate(spoken)}
    want = sum(any(0 < place[i] - place[j] <= 5 and 100 * len(words[i] & words[j]) >= 80 * len(words[i] | words[j]) for j in spoken) for i in spoken)
    assert want > 5 and sum(r.prompt_restated for r in got) == want


def test_outcomes_of_nothing(spark, tmp_path):
    made = derive(records_of(spark, tmp_path, [{"type": "user"}]), outcomes=True)
    assert made.outcome_signal.count() == 0 == made.verdict.count()


def test_outcomes_are_stored_and_read_again(spark, tmp_path):
    rows = struggle("A") + [r for i in range(8) for r in calm(f"B{i}")]
    cli.save(derive(records_of(spark, tmp_path, rows), outcomes=True), str(tmp_path / "store"))
    assert {r.justification for r in stores.load(spark, str(tmp_path / "store")).verdict.collect()} >= {"Underprovisioned"}


# transcripts -----------------------------------------------------------------------


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Lines of blocks of a few hundred bytes have the numbers and hashes that a walk through the file gives them."""
    rnd = random.Random(1)
    for name, n in (("a", 400), ("sub/b", 3), ("c", 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        lines = [rnd.choice([json.dumps({"sessionId": f"s{i % 3}", "x": "y" * rnd.randint(0, 90)}), "", "  ", "\u2003{}\u00a0", "no json", json.dumps({"session_id": "é"})]) + rnd.choice(["\n", "\r\n"]) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(lines) + ("{}" if n else ""), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        made = transcripts.read_lines(spark, str(tmp_path))
        assert transcripts.raw_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r.file_path.rsplit("/", 1)[1], r.line_no, r.session_id, r.payload, r.content_hash) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for path in tmp_path.rglob("*.jsonl"):
        kept = [x.strip() for x in path.read_bytes().decode().replace("\r\n", "\n").split("\n") if x.strip()]
        for n, line in enumerate(kept, 1):
            about = json.loads(line) if line.startswith("{") else {}
            session = about.get("sessionId") or about.get("session_id") or path.stem
            want.append((path.name, n, session, line, hashlib.sha256("\0".join((session, path.name, str(n), line)).encode()).hexdigest()))
    assert got == sorted(want) and len(want) > 200


# updates ---------------------------------------------------------------------------

DERIVED = ("api_call", "work_unit", "prompt_unit", "tool_call", "classification", "verdict", "model_registry")


def state(tables):
    return {name: sorted(map(repr, getattr(tables, name).select(sorted(getattr(tables, name).columns)).collect())) for name in DERIVED}


def test_updates_equal_a_rebuild_after_every_batch(spark, tmp_path, monkeypatch):
    """Batches that add sessions, go on with old ones and take over responses of others. Few groups, so that
    sessions share them."""
    monkeypatch.setattr(stores, "GROUPS", 3)
    store, folder = str(tmp_path / "store"), tmp_path / "in"
    batches = [
        [*calm("A"), *calm("B"), *calm("C:arc:1")], [*calm("D"), answer("E", "B1", at(0), "loop")],  # E holds an earlier copy of a response of B
        [{"type": "user"}, answer(None, "x", at(3)), ask("B", at(90), "what else"), answer("B", "B9", at(95), "deploy_thing")],
    ]
    for n, rows in enumerate(batches):
        write(folder, rows, f"{'a' if n == 1 else 'b'}{n}.jsonl")
        spool.follow(spark, str(folder), store, str(tmp_path / "checkpoint")).awaitTermination()
        whole = derive(transcripts.records(transcripts.load_store(spark, f"{store}/raw_event")))
        assert state(stores.load(spark, store)) == state(whole), n
        last, want = stores.latest(spark, store), whole.normalize_run.first()
        counts = ("raw_events", "api_calls", "unknown_models", "work_units", "prompt_units", "unscored_arcs", "verdicts", "score_zero")
        assert [last[c] for c in counts[1:]] == [want[c] for c in counts[1:]]
    runs = stores.history(spark, store).orderBy("run_id").collect()
    assert runs[0].groups is None and all(r.groups for r in runs[1:]) and any(len(r.groups) < 3 for r in runs[1:])
    stores.reclassify(cli.classified(spark, store), store)
    assert state(stores.load(spark, store)) == state(whole)


def test_an_update_that_dies_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    write(tmp_path / "in", calm("A"))
    spool.follow(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint")).awaitTermination()
    before = state(stores.load(spark, store))
    broken = derive(records_of(spark, tmp_path / "x", struggle("A")))
    broken.verdict = broken.verdict.withColumn("rules_version", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        stores.update(broken, store, list(range(stores.GROUPS)))
    assert state(stores.load(spark, store)) == before and stores.history(spark, store).count() == 1
    assert spool.refresh(spark, store, "batch-999") is None  # nothing new, no run


def test_classify_derives_nothing_else(spark, tmp_path):
    """Another map of activities: classes and verdicts change, and the stored calls and units stay where they are."""
    write(tmp_path / "in", calm("A"))
    (tmp_path / "c.toml").write_text('[ai_activity.by_anchor_skill]\nfix-issue = "testing"\n')
    run = lambda *a: cli.main([*a, "--store", str(tmp_path / "store"), "--projects", str(tmp_path / "in")], spark, lambda _: None)
    assert run("run") == 0
    before = stores.latest(spark, str(tmp_path / "store"))
    assert run("classify", "--config", str(tmp_path / "c.toml")) == 0
    after = stores.latest(spark, str(tmp_path / "store"))
    assert after.folder == before.folder and after.classified and after.run_id == before.run_id + 1
    assert {r.ai_activity for r in stores.load(spark, str(tmp_path / "store")).classification.where("unit_grain = 'work_unit'").collect()} == {"testing"}
    assert run("classify", "--outcomes") == 0


def test_every_view_has_a_title(spark, tmp_path):
    made = derive(records_of(spark, tmp_path, calm("A")))
    rows = {r["name"]: r for r in views.catalogue(made).collect()}
    assert rows.keys() == views.VIEWS.keys() == views.ABOUT.keys() and all(r.title and r.description and (r.sort_desc is None or r.sort_desc in r["columns"]) for r in rows.values())


@pytest.mark.parametrize(("repo", "n"), [("pro", 1), ("P%J", 1), ("p_oj", 1), ("p_j", 0), ("\\", 0)])
def test_families_are_matched_like_sql(spark, tmp_path, repo, n):
    made = derive(records_of(spark, tmp_path, [ask("S", at(0), "x"), answer("S", "a", at(1), "loop", cwd="/home/u/proj")]))
    reference = checks.Reference(1.0, 1, 1.0, (n, n), (0.0, 1.0))
    found, _ = checks.run_checks(made, 1, reference, repo)
    assert next(c for c in found if c.name == "prompt units").status == "PASS"


# allowances ------------------------------------------------------------------------

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
CALLS = "id string, session string, turn_index int, allowance_pool string, value_e8 long, error_kind string, started_at string"


def calls_of_pools(n=400, seed=3):
    rnd = random.Random(seed)
    rows, when = [], START
    for i in range(n):
        when += timedelta(microseconds=rnd.choice([0, 1, 10**6, 300 * 10**6, 299_999_999, 3 * 3600 * 10**6, 5 * 3600 * 10**6, 2 * 86400 * 10**6]))
        rows.append((f"c{i}", f"s{i % 7}", i, "one" if i % 10 else "two", rnd.randint(0, 10**9), "rate_limit" if i % 37 == 5 else None, when.isoformat().replace("+00:00", "Z")))
    return rows + [("bad", "s", 0, "one", 5, None, "no time"), ("none", "s", 1, "one", 5, None, None)]


def test_trailing_use_against_brute_force(spark):
    rows = calls_of_pools()
    micros = lambda r: (datetime.fromisoformat(r[6]) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    timed = [(r, micros(r)) for r in rows if r[6] and "T" in r[6]]
    use = lambda pool, t, seconds: sum(r[4] for r, u in timed if r[3] == pool and t - seconds * 10**6 < u <= t)
    want = {r[0]: (r[3], t, use(r[3], t, 18000), use(r[3], t, 604800)) for r, t in timed}
    for step in (60, 300, 10**6):  # the width of the steps changes nothing
        got = {r.id: (r.allowance_pool, r.at, r.used_5h_e8, r.used_week_e8) for r in allowance.trailing_use(spark.createDataFrame(rows, CALLS), step=step).collect()}
        assert got == want


def test_capacities(spark):
    rows = calls_of_pools()
    used = stored(allowance.trailing_use(spark.createDataFrame(rows, CALLS)), "used")
    known = {(r.allowance_pool, r.window): r for r in allowance.capacities(used).collect()}
    by_pool = defaultdict(list)
    for r in used.collect():
        by_pool[r.allowance_pool].append(r)
    for pool, mine in by_pool.items():
        limits, passed = [r.used_5h_e8 for r in mine if r.limited], [r.used_5h_e8 for r in mine if not r.limited]
        k = known[pool, "5h"]
        assert (k.limit_hits, k.reached_e8, k.passed_e8) == (len(limits), max(limits, default=None), max(passed)) and k.capacity_e8 == (max(*limits, *passed) if limits else None)
    top = allowance.shares(used, allowance.capacities(used)).agg(F.max("share_5h_ppm"), F.max("share_week_ppm")).first()
    assert tuple(top) == (1_000_000, 1_000_000)
    grown = [r.capacity_5h_e8 for r in allowance.fitted(used).where("allowance_pool = 'one'").orderBy("at", "id").collect()]
    assert grown == sorted(grown) and grown[-1] == known["one", "5h"].reached_e8
    assert allowance.capacities(used.where("not limited")).where("capacity_e8 is not null").count() == 0  # no limit seen, no ceiling


def test_no_task_sums_a_whole_pool(spark):
    """The only window over a pool runs over its steps, whose number doesn't grow with the calls."""
    plan = allowance.trailing_use(spark.createDataFrame(calls_of_pools(50), CALLS))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("step" in line.split("windowspecdefinition")[1].split("ASC")[0].rsplit(",", 1)[0] for line in windows) == 1


# reconciliation --------------------------------------------------------------------

SOURCE = "id string, session string, uuid string, ts string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long"


def when(ms):
    return (START + timedelta(milliseconds=ms)).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def both(spark, left, right):
    make = lambda rows: spark.createDataFrame([(i, s, u, t if t is None or isinstance(t, str) else when(t), *n) for i, s, u, t, *n in rows], SOURCE)
    return make(left), make(right)


def test_reconciliation(spark):
    left = [("a", "S", "u1", 0, 1, 1, 1, 1), ("b", "S", None, 10_000, 2, 0, 0, 0), ("c", "S", None, 11_000, 3, 0, 0, 0), ("d", "S", None, 30_000, 4, 0, 0, 0), ("e", None, None, 0, 5, 0, 0, 0), ("f", "S", None, None, 6, 0, 0, 0), ("g", "S", "u2", 50_000, 7, 0, 0, 0), ("h", "S", "u2", 51_000, 7, 0, 0, 0)]
    right = [("A", "S", "u1", 90_000, 1, 1, 1, 2), ("B", "S", None, 10_900, 2, 0, 0, 9), ("C", "S", None, 12_900, 3, 0, 0, 0), ("D", "S", None, 32_001, 4, 0, 0, 0), ("E", "T", None, 10_000, 5, 0, 0, 0), ("G", "S", "u2", 50_500, 70, 0, 0, 0)]
    rows = {(r.transcript_id, r.metric_id): r for r in reconcile.reconciled(*both(spark, left, right)).collect()}
    # by id whatever the time; B is nearest to c; b, whose nearest is gone, is left without one within 2 s; D is 1 ms too late
    assert {k: r.sources for k, r in rows.items()} == {("a", "A"): 3, ("c", "B"): 3, ("b", None): 1, (None, "C"): 2, ("d", None): 1, (None, "D"): 2, ("e", None): 1, ("f", None): 1, (None, "E"): 2, ("g", "G"): 3, ("h", None): 1}
    assert rows["a", "A"].cache_read_tokens == 2 and rows["a", "A"].reconciliation_delta == 1 and rows["c", "B"].reconciliation_delta == 8
    alarms = {r.sources: r.alarm for r in reconcile.coverage(reconcile.reconciled(*both(spark, left, right))).collect()}
    assert alarms == {1: False, 2: False, 3: True}


@pytest.mark.parametrize("seed", range(3))
def test_each_record_is_matched_once(spark, seed):
    rnd = random.Random(seed)
    side = lambda p: [(f"{p}{i}", rnd.choice("ST"), rnd.choice([None, None, f"u{rnd.randint(0, 9)}"]), rnd.randint(0, 60_000), 1, 1, 1, 1) for i in range(60)]
    left, right = side("l"), side("r")
    rows = reconcile.reconciled(*both(spark, left, right)).collect()
    assert sorted(r.transcript_id for r in rows if r.transcript_id) == sorted(x[0] for x in left)
    assert sorted(r.metric_id for r in rows if r.metric_id) == sorted(x[0] for x in right)
    where = {x[0]: x for x in left + right}
    for r in rows:
        if r.sources == 3:
            a, b = where[r.transcript_id], where[r.metric_id]
            assert a[1] == b[1] and (a[2] == b[2] is not None or abs(a[3] - b[3]) <= 2000)


def test_reconciliation_of_nothing(spark):
    assert reconcile.reconciled(*both(spark, [], [])).count() == 0
    assert reconcile.reconciled(*both(spark, [("a", "S", None, 0, 1, 1, 1, 1)], [])).first().sources == 1
