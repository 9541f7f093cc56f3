"""Checks of a ledger against reference figures. A check that could not run has not passed."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import functions as F

from .ledger import Ledger
from .views import prompt_unit_value

ROUTINE = "release-prod"


@dataclass(frozen=True)
class Reference:
    release_target: float
    release_runs: int
    release_tolerance: float
    prompt_unit_band: tuple[int, int]
    duplicate_ratio_band: tuple[float, float]
    frontier_unique: int | None = None
    frontier_value: float | None = None
    subset_share: float | None = None
    remainder_share: float | None = None
    score_zero_share: float | None = None

    @classmethod
    def load(cls, path: str) -> Reference | None:
        """The [reference] section of a TOML file; None without one, an error if it is incomplete."""
        if not Path(path).is_file() or not (section := tomllib.loads(Path(path).read_text()).get("reference")):
            return None
        try:
            pair = lambda key, kind: tuple(kind(section[key][i]) for i in (0, 1))
            more = {k: None if section.get(k) is None else float(section[k]) for k in ("frontier_value", "subset_share", "remainder_share", "score_zero_share")}
            unique = section.get("frontier_unique")
            return cls(float(section["release_target"]), int(section["release_runs"]), float(section.get("release_tolerance", 0.05)), pair("prompt_unit_band", int), pair("duplicate_ratio_band", float), None if unique is None else int(unique), **more)
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise ValueError(f"the reference figures in {path} are incomplete: {e!r}") from e


@dataclass(frozen=True)
class Check:
    name: str
    status: str  # PASS, FAIL, SKIP or reported
    expected: str
    actual: str


def _asserted(name: str, ok: bool, expected: str, actual: str) -> Check:
    return Check(name, "PASS" if ok else "FAIL", expected, actual)


def _skipped(name: str) -> Check:
    return Check(name, "SKIP", "(unset)", "not run")


def first_runs(t: Ledger, routine: str, n: int):
    """The first runs of a routine by start, unit id on ties."""
    return t.work_unit.where((F.col("kind") == "arc") & (F.col("anchor_skill") == routine)).orderBy("started_at", "id").limit(n)


def overlapping_turns(t: Ledger):
    return t.api_call.where("work_unit_id is not null").groupBy("session", "turn_index").agg(F.count_distinct("work_unit_id").alias("n")).where("n > 1")


def run_checks(t: Ledger, assistant_records: int, reference: Reference | None = None, repo: str | None = None) -> tuple[list[Check], int]:
    """All checks, and how many failed or were skipped."""
    out = []
    name = f"{ROUTINE}, first runs"
    if reference:
        runs = first_runs(t, ROUTINE, reference.release_runs).agg(F.count("*"), F.coalesce(F.sum("value_e8"), F.lit(0))).first()
        total, slack = runs[1] / 1e8, reference.release_target * reference.release_tolerance
        out.append(_asserted(name, runs[0] == reference.release_runs and abs(total - reference.release_target) <= slack, f"{reference.release_target} +- {slack}", f"{total} ({runs[0]} runs)"))
    else:
        out.append(_skipped(name))
    overlaps, orphans = overlapping_turns(t).count(), t.api_call.where("work_unit_id is null").count()
    out += [_asserted("turns in several arcs", overlaps == 0, "0", str(overlaps)), _asserted("orphaned calls", orphans == 0, "0", str(orphans))]
    pattern = "%" + repo.lower().replace("\\", "\\\\") + "%" if repo else ""  # % and _ in it stand for any text, any character
    mine = F.lower("project_family").like(pattern) if repo else None
    if reference and repo:
        n, (low, high) = t.prompt_unit.where(mine).count(), reference.prompt_unit_band
        out.append(_asserted("prompt units", low <= n <= high, f"{low}-{high}", str(n)))
    else:
        out.append(_skipped("prompt units"))
    calls = t.api_call.agg(F.count("*"), F.count_if(F.col("model_tier") == "frontier"), F.coalesce(F.sum(F.when(F.col("model_tier") == "frontier", F.col("value_e8"))), F.lit(0))).first()
    ratio = (assistant_records - calls[0]) / assistant_records if assistant_records else 0.0
    if reference:
        low, high = reference.duplicate_ratio_band
        out.append(_asserted("duplicate ratio", low <= ratio <= high, f"{low}-{high}", f"{ratio:.3f}"))
    else:
        out.append(_skipped("duplicate ratio"))
    units = t.work_unit.agg(F.coalesce(F.sum("value_e8"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("kind") == "unattributable", F.col("value_e8"))), F.lit(0)), F.coalesce(F.sum(F.when(mine, F.col("value_e8"))), F.lit(0)) if repo else F.lit(None)).first()
    share = lambda part: "(unset)" if part is None else f"{100 * part / units[0] if units[0] else 0:.1f}%"
    zero = None
    if repo:
        scores = t.classification.where("unit_grain = 'prompt_unit'").select(F.col("unit_id").alias("prompt_unit_id"), "complexity_score")
        families = t.prompt_unit.where(mine).select(F.col("id").alias("prompt_unit_id"))
        z = prompt_unit_value(t).join(scores, "prompt_unit_id").join(families, "prompt_unit_id").agg(F.sum(F.when(F.col("complexity_score") == 0, F.col("notional_list_value_usd")).otherwise(0)), F.sum("notional_list_value_usd")).first()
        zero = f"{100 * z[0] / z[1] if z[1] else 0:.1f}%"
    mixed = t.verdict.agg(F.count_if(F.col("max_tier") != F.col("used_tier")), F.count("*")).first()
    want = lambda key: str(getattr(reference, key)) if reference and getattr(reference, key) is not None else "(unset)"
    out += [Check(n, "reported", e, a) for n, e, a in (
        ("score-0 share of value", want("score_zero_share"), zero or "not run"), ("frontier responses", want("frontier_unique"), str(calls[1])), ("frontier value", want("frontier_value"), f"{calls[2] / 1e8:.2f}"),
        ("subset share", want("subset_share"), share(units[2])), ("remainder share", want("remainder_share"), share(units[1])), ("units of mixed tiers", "-", f"{mixed[0]} of {mixed[1]}"),
    )]
    return out, sum(c.status in ("FAIL", "SKIP") for c in out)
