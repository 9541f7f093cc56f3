"""Scans of sessions cut into pieces: the same results as a walk over each session, whatever the size of a piece."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom import adapters
from tallyloom.functions.pricing import registry
from tallyloom.operators import scan, turns
from tallyloom.operators.outcomes import escalations
from tallyloom.operators.prompts import as_of, latest
from tallyloom.plans import ledger
from tallyloom.tables import stored


@pytest.fixture(params=[5, 1 << 20])
def piece(request, monkeypatch):
    monkeypatch.setattr(scan, "PIECE", request.param)
    return request.param


def turns_of(spark, rows):
    """Turns (session, ts, message_id, skill), as deduplication leaves them."""
    schema = "session string, ts string, message_id string, skill string, pos long, request_id string"
    return spark.createDataFrame([(*r, i, "r") for i, r in enumerate(rows)], schema)


def walked(rows):
    """{(session, idx): (message_id, arc)}, (session, arc, skill, first, last tagged, last) by a walk."""
    places, found = {}, []
    for session in {r[0] for r in rows if r[0]}:
        ordered = sorted(((r[1] or "", r[2] or "", i, r[3]) for i, r in enumerate(rows) if r[0] == session))
        before, arc = None, -1
        for idx, (_, message, _, skill) in enumerate(ordered):
            if skill is not None and skill != before:
                arc += 1
                found.append([session, arc, skill, idx, idx, idx])
            elif arc >= 0:
                found[-1][4 + (skill is None)] = idx
                found[-1][5] = idx
            before = skill
            places[session, idx] = (message or None, arc)
    return places, sorted(map(tuple, found))


@pytest.mark.parametrize("sessions", [["S"], ["S", "S", "S", "T", "U", None, ""]])
def test_arcs_equal_a_walk(spark, piece, sessions):
    deal = random.Random(3)
    rows = [(deal.choice(sessions), deal.choice([None, "t1", "t2", "t3"]), deal.choice([None, "m1", f"m{i}"]), deal.choice([None, None, "a", "a", "b"])) for i in range(300)]
    places, found = walked(rows)
    arced = stored(turns.with_arcs(turns.sequenced(turns_of(spark, rows))), "arced")
    assert {(r.session, r.idx): (r.message_id, r.arc) for r in arced.collect()} == places
    runs = {(r.session, r.arc): (r.skill, r.start_turn, r.tag_end) for r in turns.anchor_runs(arced).collect()}
    spans = {(r.session, r.arc): (r.skill, r.start_turn, r.end_turn) for r in turns.arcs(arced).collect()}
    assert runs == {f[:2]: f[2:5] for f in found} and spans == {f[:2]: (*f[2:4], f[5]) for f in found}
    for rule, last in ((turns.tagged_only(arced), 4), (turns.arcs(arced), 5), (turns.to_session_end(arced), None)):
        claimed = {(r.session, r.idx): r.claimed for r in turns.claims(arced, rule).collect()}
        assert claimed == {(s, i): sum(f[0] == s and f[3] <= i and (last is None or i <= f[last]) for f in found) for s, i in places}


def test_marks_of_the_same_time_count(spark, piece):
    deal = random.Random(5)
    times = [None, *[f"2026-01-01T00:00:{i:02d}" for i in range(9)]]
    rows = [(deal.choice("ST"), deal.choice(times), i) for i in range(150)]
    marks = [(deal.choice("SU"), deal.choice(times)) for _ in range(40)]
    found = as_of(spark.createDataFrame(rows, "session string, ts string, id int"), spark.createDataFrame(marks, "session string, ts string"), "mark")
    assert found.columns == ["session", "ts", "id", "mark"]
    want = {i: sum(m[0] == s and (m[1] or "") <= (t or "") for m in marks) - 1 for s, t, i in rows}
    assert {r.id: r.mark for r in found.collect()} == {i: n if n >= 0 else None for i, n in want.items()}


def test_no_window_takes_more_than_a_piece(spark, monkeypatch):
    """One session has all rows, all at one time: its places still fall into pieces of PIECE at most, and
    every window over rows is partitioned by piece; what is left are windows over pieces."""
    monkeypatch.setattr(scan, "PIECE", 16)
    rows = turns_of(spark, [("S", "t", f"m{i:04d}", "a" if i % 5 == 0 else None) for i in range(1000)])
    ordered = scan.in_order(rows, "session", "ts", "message_id")
    assert ordered.select("at").distinct().count() == 1000
    assert ordered.groupBy(F.expr("at div 16")).count().agg(F.max("count")).first()[0] <= 16
    assert [r.message_id for r in ordered.orderBy("at").collect()] == [f"m{i:04d}" for i in range(1000)]
    arced = turns.with_arcs(turns.sequenced(rows))
    assert arced.agg(F.max("arc"), F.max("idx")).first() == (199, 999)
    windows = [line[line.index("Window [") :].split("], [") for line in arced._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows
    for *_, partition, order in windows:  # over rows within a piece, or over a session's pieces: a row each
        assert "_piece" in partition or order.startswith(("_piece", "_part"))


def test_empty_tables(spark, piece):
    arced = turns.with_arcs(turns.sequenced(turns_of(spark, [])))
    assert arced.count() == turns.claims(arced, turns.arcs(arced)).count() == 0
    nothing = spark.createDataFrame([], "session string, ts string")
    assert as_of(nothing, nothing, "n").count() == 0
    assert [r.n for r in as_of(spark.createDataFrame([("S", "t")], nothing.schema), nothing, "n").collect()] == [None]


def test_escalations_across_pieces(spark, piece):
    tiers = ["small", "mid", "mid", "small", "frontier", "small", "small", "mid"] * 6
    calls = spark.createDataFrame([("u", 3 * i, t, True, i % 7 == 6) for i, t in enumerate(tiers)], "work_unit_id string, idx int, model_tier string, billable boolean, sidechain boolean")
    kept = [("small", "mid", "frontier").index(t) for i, t in enumerate(tiers) if i % 7 != 6]
    assert [tuple(r) for r in escalations(calls).collect()] == [("u", sum(b > a for a, b in zip(kept, kept[1:], strict=False)))]


def test_small_and_large_sessions_together(spark, monkeypatch):
    """Sessions of up to PIECE rows take one window, longer ones are cut: both as the walk says, in one table."""
    monkeypatch.setattr(scan, "PIECE", 20)
    deal = random.Random(7)
    rows = [(deal.choice(["S", "S", "S", "T", f"u{i % 30}", None, ""]), deal.choice([None, "t1", "t2", "t3"]), f"m{i}", deal.choice([None, None, "a", "b"])) for i in range(300)]
    marks = [(deal.choice(["S", "T", "u1", "u2"]), deal.choice([None, "t1", "t2"])) for _ in range(60)]
    known = scan.sizes(turns_of(spark, rows))
    assert known.small and {"S", "T"} <= set(known.large)
    places, found = walked(rows)
    marked = stored(turns.walked(turns_of(spark, rows), spark.createDataFrame(marks, "session string, ts string")), "walked")
    assert {(r.session, r.idx): (r.message_id, r.arc) for r in marked.collect()} == places
    earlier = lambda r: sum(m[0] == r.session and (m[1] or "") <= (r.ts or "") for m in marks)
    assert all(r.prompt == (earlier(r) - 1 if earlier(r) else None) for r in marked.collect())
    plain = turns.walked(turns_of(spark, rows))
    assert {(r.session, r.idx): (r.message_id, r.arc) for r in plain.collect()} == places
    claimed = {(r.session, r.idx): r.claimed for r in turns.claims(plain, turns.arcs(plain)).collect()}
    assert claimed == {(s, i): sum(f[0] == s and f[3] <= i <= f[5] for f in found) for s, i in places}
    asked = spark.createDataFrame([(deal.choice("STu"), deal.choice([None, "t0", "t1", "t3"]), i) for i in range(40)], "session string, ts string, id int")
    got = {r.id: (r.idx, r.arc) for r in latest(asked, marked, "idx", "arc").collect()}
    last = lambda r: max((m.idx for m in marked.collect() if m.session == r.session and (m.ts or "") <= (r.ts or "")), default=None)
    assert got == {r.id: (last(r), None if last(r) is None else places[r.session, last(r)][1]) for r in asked.collect()}


def test_calls_of_small_sessions_are_dealt_once(spark, tmp_path):
    """After deduplication one shuffle by session and no shuffled join, where there had been a sort and a join for each scan."""
    plan = ledger.calls_of(adapters.records(spark, "/root/testdata/sf0.001"), registry(spark))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(session") == 1 and "SortMergeJoin" not in plan
