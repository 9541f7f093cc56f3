"""What queries over events store before they show it: tables that are read again, with the columns that are read."""

import pytest

from tallyloom import queries

DATA = "/root/testdata/sf0.001"
HELD = {
    "v_unscored_arcs": 1,
    "complexity_bucket": 2,
    "v_work_unit_shape": 1,
    "v_activity_ledger": 4,
    "verdicts": 2,
    "v_work_unit_verbs": 0,
    "cohort_turns": 3,
    "v_verdict_readable": 4,
}


@pytest.mark.parametrize("name", HELD)
def test_held(spark, monkeypatch, name):
    """The number of tables of HELD, where there had been 2 to 4 with all columns; no counts of tokens, and tools without their ordinals."""
    held = []
    monkeypatch.setattr(queries, "stored", lambda frame, label: held.append((label, frame.columns)) or frame)
    shown = queries.QUERIES[name](spark, DATA)
    tables = [columns for label, columns in held if label == "ledger"]
    assert len(tables) == HELD[name]
    assert not any({"input_tokens", "api_error_status", "message_id", "turn_index", "ordinal"} & set(columns) for columns in tables)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    if name == "v_unscored_arcs":  # neither tools nor language say whether a prompt covers a unit
        assert "posexplode" not in plan and "_mark" in plan and "debug" not in plan
    if name == "v_work_unit_verbs":  # no prices
        assert "in_cents" not in plan
