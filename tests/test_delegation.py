"""Delegated calls, limits by their stated end, headroom."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from test_ledger import answer, ask, at, records_of

from tallyloom.functions.pricing import registry
from tallyloom.operators import delegation, outcomes
from tallyloom.plans.ledger import derive

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def when(s):
    return None if s is None else (START + timedelta(seconds=s)).isoformat(timespec="microseconds").replace("+00:00", "Z")


def both(spark, calls, runs):
    one = spark.createDataFrame([(i, r, c, when(t), f"p-{i}") for i, r, c, t in calls], "id string, run_id string, cwd string, ts string, parent_prompt_id string")
    return one, spark.createDataFrame([(i, r, c, when(t), n) for i, r, c, t, n in runs], "id string, run_id string, cwd string, ts string, tokens long")


def test_delegations_are_joined_by_trust(spark):
    calls = [("d1", "r1", "/a", 0), ("d2", None, "/a", 10), ("d3", None, "/a", 12), ("d4", "r9", "/b", 0), ("d5", None, "/c", 0), ("d6", None, None, 0), ("d7", "r7", "/d", 0), ("d8", "r7", "/d", 5), ("d9", None, "/e", None)]
    runs = [("a1", "r1", "/z", 9999, 7), ("a2", None, "/a", 13, 8), ("a3", None, "/a", 15, 9), ("a4", None, "/b", 20, 1), ("a5", None, "/c", 20.000001, 1), ("a6", None, "/c", -1, 1), ("a7", "r7", "/d", 3, 1), ("a8", "r7", "/d", 1, 2)]
    rows = {(r.delegation_id, r.agent_id): (r.trust, r.orphaned, r.tokens, r.parent_prompt_id) for r in delegation.attributed(*both(spark, calls, runs)).collect()}
    # d3 is the last call before a2; a3 goes to d2 in the second round; a5 is a microsecond too late, a6 before the call
    assert rows == {
        ("d1", "a1"): ("run_id", False, 7, "p-d1"), ("d3", "a2"): ("time", False, 8, "p-d3"), ("d2", "a3"): ("time", False, 9, "p-d2"), ("d4", "a4"): ("time", False, 1, "p-d4"), ("d7", "a8"): ("run_id", False, 2, "p-d7"), ("d8", "a7"): ("run_id", False, 1, "p-d8"),
        ("d5", None): ("none", True, None, "p-d5"), ("d6", None): ("none", True, None, "p-d6"), ("d9", None): ("none", True, None, "p-d9"), (None, "a5"): ("none", False, 1, None), (None, "a6"): ("none", False, 1, None),
    }
    assert delegation.attributed(*both(spark, [], [])).count() == 0


def test_a_run_is_given_once(spark):
    rnd = random.Random(2)
    calls = [(f"d{i}", rnd.choice([None, None, f"r{rnd.randint(0, 20)}"]), rnd.choice("ab"), rnd.randint(0, 300)) for i in range(80)]
    runs = [(f"a{i}", rnd.choice([None, None, f"r{rnd.randint(0, 20)}"]), rnd.choice("ab"), rnd.randint(0, 300), i) for i in range(80)]
    rows = delegation.attributed(*both(spark, calls, runs)).collect()
    assert sorted(r.delegation_id for r in rows if r.delegation_id) == sorted(c[0] for c in calls)
    assert sorted(r.agent_id for r in rows if r.agent_id) == sorted(r[0] for r in runs)
    known = {c[0]: c for c in calls + runs}
    for r in rows:
        if r.trust == "run_id":
            assert known[r.delegation_id][1] == known[r.agent_id][1] is not None
        if r.trust == "time":
            assert known[r.delegation_id][2] == known[r.agent_id][2] and 0 <= known[r.agent_id][3] - known[r.delegation_id][3] <= 20
        assert r.orphaned == (r.agent_id is None)


# limits ----------------------------------------------------------------------------


def hit(session, mid, ts, said):
    return answer(session, mid, ts, model="<synthetic>", content=[{"type": "text", "text": said}], error="rate_limit")


def micros(*date):
    return int(datetime(*date, tzinfo=timezone.utc).timestamp() * 1_000_000)


def test_limits_by_their_end(spark, tmp_path):
    rows = [
        hit("A", "1", "2026-08-21T20:00:00.000Z", "You've hit your session limit · resets 11:40pm (America/Los_Angeles)"), hit("B", "2", "2026-08-21T20:03:00.000Z", "You've hit your session limit · resets 11:40pm (America/Los_Angeles)"),
        hit("A", "3", "2026-08-22T06:39:59.000Z", "You've hit your session limit · resets 11:40pm (America/Los_Angeles)"), hit("A", "4", "2026-08-22T06:40:00.000Z", "You've hit your session limit · resets 11:40pm (America/Los_Angeles)"),
        hit("A", "5", "2026-08-21T20:00:00.000Z", "You've hit your weekly limit · resets Aug 27, 5pm (UTC)"), hit("C", "6", "2026-12-30T20:00:00.000Z", "You've hit your weekly limit · resets Jan 2 at 12am (Europe/Paris)"),
        hit("D", "7", "2026-08-21T20:00:00.000Z", "You've hit your session limit · resets 12pm (Nowhere/Land)"), hit("D", "8", "2026-08-21T21:00:00.000Z", "rate limited"), hit("E", "9", "2026-08-21T20:00:00.000Z", "You've hit your session limit · resets 13:70pm (UTC)"),
        hit("F", "10", "no time", "You've hit your session limit · resets 3pm (UTC)"), answer("G", "11", at(0), content=[{"type": "text", "text": "hit your session limit resets 3pm (UTC)"}]),
    ]
    got = sorted(((r.limit, r.resets_at or 0, r.hits, r.sessions, r.first_hit) for r in outcomes.limit_resets(records_of(spark, tmp_path, rows)).collect()))
    assert got == [
        ("session", micros(2026, 8, 22, 6, 40), 3, 2, "2026-08-21T20:00:00.000Z"), ("session", micros(2026, 8, 23, 6, 40), 1, 1, "2026-08-22T06:40:00.000Z"),
        ("unstated", 0, 1, 1, "2026-08-21T20:00:00.000Z"), ("unstated", 0, 1, 1, "no time"), ("unstated", 0, 2, 1, "2026-08-21T20:00:00.000Z"),
        ("weekly", micros(2026, 8, 27, 17), 1, 1, "2026-08-21T20:00:00.000Z"), ("weekly", micros(2027, 1, 1, 23), 1, 1, "2026-12-30T20:00:00.000Z"),
    ]


# headroom --------------------------------------------------------------------------


def test_headroom(spark, tmp_path):
    """A unit of low complexity on a frontier model: its frontier calls at the small tier's dearest rates, the others as they are."""
    rows = [ask("S", at(0), "x"), answer("S", "a", at(1), "loop", usage=(1000, 100, 10, 1)), answer("S", "b", at(2), usage=(2000, 0, 0, 0)), answer("S", "c", at(3), usage=(10, 0, 0, 0), model="claude-haiku-3-x"), answer("T", "d", at(4), usage=(7, 0, 0, 0), model="claude-haiku-3-x")]
    made = derive(records_of(spark, tmp_path, rows))
    assert made.verdict.first().justification == "Overprovisioned"
    (row,) = outcomes.headroom(made.api_call, made.verdict, registry(spark)).collect()
    spent = 1000 * 1500 + 100 * 7500 + 10 * 1875 + 150 + 2000 * 1500 + 10 * 25
    anew = 3000 * 100 + 100 * 500 + 10 * 125 + 10 + 10 * 25
    assert (row.work_unit_id, row.expected_tier, row.value_e8, row.repriced_e8, row.reclaimable_e8) == ("S:arc:0", "small", spent, anew, spent - anew)
    assert row.share_ppm == (spent - anew) * 1_000_000 // (spent + 7 * 25) and row.upper_bound


@pytest.mark.parametrize("justification", ["Justified", "Acceptable"])
def test_no_headroom_without_a_verdict(spark, tmp_path, justification):
    made = derive(records_of(spark, tmp_path, [ask("S", at(0), "x"), answer("S", "a", at(1), "loop")]))
    assert outcomes.headroom(made.api_call, made.verdict.where(f"justification = '{justification}'"), registry(spark)).count() == 0
