"""Scalar expressions: verbs, paths, hosts, branches, projects, language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BRANCH_KINDS, DEBUG_LANGUAGE, KNOWN_VERBS, SAFE_DIRS, SELF_CORRECTION


def opaque(text: Column) -> Column:
    """Eight hexadecimal digits of the SHA-256: tells values apart, names none."""
    return F.substring(F.sha2(text, 256), 1, 8)


def command_verb(command: Column) -> Column:
    """The base name of a command's first word if it is a known verb, else ``other``; empty without a word."""
    word = F.regexp_extract(F.coalesce(command, F.lit("")), r"(?U)^\s*(\S+)", 1)
    base = F.element_at(F.split(word, "/"), -1)
    return F.when(word == "", "").when(base.isin(*KNOWN_VERBS), base).otherwise("other")


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def path_class(path: Column) -> Column:
    """parent/stem.suffix with the stem hashed, and the parent too unless it names a role."""
    ends = lambda parts: F.struct(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("name"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("parent"))

    def leaf(name: Column) -> Column:
        suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
        return _let(suffix, lambda s: _let(F.substring(name, F.lit(1), F.length(name) - F.length(s)), lambda stem: F.concat(F.when(stem != "", opaque(stem)).otherwise(""), s)))

    def head(parent: Column) -> Column:
        kept = F.when(F.lower(parent).isin(*SAFE_DIRS), parent).otherwise(opaque(parent))
        return F.when(parent != "", F.concat(kept, F.lit("/"))).otherwise("")

    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(_let(_let(_parts(path), ends), lambda e: F.concat(head(e["parent"]), leaf(e["name"]))))


def web_host(url: Column) -> Column:
    """Between ``//`` and the next slash, 64 characters at most; empty without ``//``."""
    return F.substring(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?//([^/]*)", 1), 1, 64)


def target(tool: Column, given: Column) -> Column:
    """What of a tool's input may be stored. ``given`` is a map of the input's keys."""
    first, second, third = ("file_path", "path", "notebook_path")
    path = path_class(F.when(F.map_contains_key(given, first), given[first]).when(F.map_contains_key(given, second), given[second]).otherwise(given[third]))
    has_path = F.map_contains_key(given, first) | F.map_contains_key(given, second) | F.map_contains_key(given, third)
    known = F.when(tool == "Bash", command_verb(given["command"])).when(has_path, path).when(tool.isin("WebFetch", "WebSearch"), web_host(given["url"]))
    return F.coalesce(known, F.lit(""))


def branch_kind(branch: Column) -> Column:
    """The conventional head of a branch name, else ``other``; null for none."""
    head = F.lower(F.split(F.trim(branch), "/")[0])
    return F.when(F.coalesce(branch, F.lit("")) == "", F.lit(None).cast("string")).when(head.isin(*BRANCH_KINDS), head).otherwise("other")


def repo_of(cwd: Column) -> Column:
    """The last directory's name; null for none."""
    return F.when(F.coalesce(cwd, F.lit("")) != "", F.coalesce(F.try_element_at(_parts(cwd), F.lit(-1)), F.lit("")))


def project_family(cwd: Column) -> Column:
    """The project that a worktree belongs to, by the leftmost marker (``X-worktrees`` or
    ``A/b/worktrees``), else the last directory's name."""
    parts = _parts(F.coalesce(cwd, F.lit("")))
    bound = F.transform(F.array(parts), lambda p: F.struct(p.alias("p")))
    found = F.transform(bound, lambda s: F.try_element_at(F.filter(F.transform(s["p"], lambda x, i: F.when((x != "-worktrees") & F.endswith(x, F.lit("-worktrees")), F.left(x, F.length(x) - 10)).when((x == "worktrees") & (i >= 2), F.get(s["p"], i - 2)).when((x == "worktrees") & (i == 1), F.get(s["p"], F.lit(0)))), lambda x: x.isNotNull()), F.lit(1)))[0]
    return F.when(F.coalesce(cwd, F.lit("")) != "", F.coalesce(found, repo_of(cwd)))


def record_text(is_text: Column, text: Column, blocks: Column) -> Column:
    """A record's prose: its string content, or its text blocks joined by spaces."""
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    return F.when(is_text, F.coalesce(text, F.lit(""))).otherwise(F.coalesce(joined, F.lit("")))


def speaks(text: Column, pattern: str) -> Column:
    """Whether the vocabulary occurs, in any case, at Unicode word boundaries."""
    return text.rlike("(?iU)" + pattern)


def debug_language(text: Column) -> Column:
    return speaks(text, DEBUG_LANGUAGE)


def self_correction(text: Column) -> Column:
    return speaks(text, SELF_CORRECTION)


def complexity(score: Column) -> Column:
    return F.when(score == 0, "Low").when(score <= 2, "Medium").when(score.isNotNull(), "High")


def json_list(values: Column) -> Column:
    """A JSON array of plain words, with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))


def usd(e8: Column) -> Column:
    """Dollars of an amount in units of 1e-8."""
    return e8.cast("double") / F.lit(1e8)


def rounded(e8: Column, places: int) -> Column:
    """Dollars rounded half up in whole numbers."""
    unit = 10 ** (8 - places)
    return (e8 + F.lit(unit // 2) - F.pmod(e8 + F.lit(unit // 2), F.lit(unit))).cast("double") / F.lit(1e8)
