"""One narrow pass over file contents: files in, one small row per file out.

``file_digest`` evaluates every selected line and file rule of a file inside a
single projection. Nothing is shuffled, ``content`` is dropped at the end, and
the result is what all later joins and aggregations work on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.regex import has, has_cs, java_pattern, strip, words_pattern
from auditloom.operators import fixed_values as V
from auditloom.operators.roles import file_flags, with_names
from auditloom.operators.rules import RULES, Line, Rule, holds_any, line_words, ordinals

HIT = "struct<line:int,text:string,ords:array<int>>"


def split_lines(content: Column) -> Column:
    return F.split(content, r"\r?\n")


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "repo_id", "path", F.posexplode(split_lines(F.col("content"))).alias("pos", "text")
    ).select("repo_id", "path", (F.col("pos") + 1).alias("line"), "text")


def with_barrier(files: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Evaluate ``columns`` exactly once per row.

    A plain projection would be merged into the per-line expressions above it
    and evaluated again for every line; a generator with one element is a fence
    the optimizer does not merge across.
    """
    if not columns:
        return files
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return files.select("*", F.inline(F.array(packed)))


def _hit(line: Column, text: Column, ordinal: int) -> Column:
    return F.struct(
        line.cast("int").alias("line"),
        text.alias("text"),
        F.array(F.lit(ordinal)).alias("ords"),
    )


class _FileLevel:
    """Stand-in for :class:`Line` in file-scope rules: only flags exist."""

    def __init__(self, flags_used: set[str]):
        self.flags_used = flags_used

    def flag(self, name: str) -> Column:
        self.flags_used.add(name)
        return F.col(name)


def _noted(words: Sequence[str] | None, everywhere: Column) -> Column:
    """The lines, numbered, that hold one of ``words`` or a word of whole-file searches; one search a line for all of them."""
    numbered = F.transform(
        F.col("lines"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), F.get(F.col("low_lines"), i).alias("low"))
    )
    if words is None:
        return numbered
    pattern = words_pattern([*words, *V.FILE_WORDS])
    return F.filter(numbered, lambda s: everywhere | s["low"].rlike(pattern))


def _candidates(words: Sequence[str] | None, everywhere: Column) -> Column:
    noted = F.col("noted")
    # without words only files that are read in full have lines to test
    kept = noted if words is None or words else F.when(everywhere, noted).otherwise(F.slice(noted, 1, 0))

    def describe(s: Column) -> Column:
        text = s["text"]
        trimmed = strip(text)
        joined = text.contains("+") | text.contains("`") | text.contains("%") | text.contains(".format(")
        return F.struct(
            s["line"].alias("line"),
            text.alias("text"),
            trimmed.alias("trimmed"),
            (trimmed.startswith("//") | trimmed.startswith("#")).alias("is_comment"),
            s["low"].alias("low"),
            (holds_any(s["low"], ("req", "params")) & has(text, V.USER_INPUT)).alias("user_input"),
            joined.alias("joined"),
        )

    return F.transform(kept, describe)


#: Rules whose words one search of a line tests together, ahead of the tests for each rule.
GROUP = 8


def _groups(ordinals: Sequence[int], table: Sequence[Rule]) -> list[list[int]]:
    """``ordinals`` in order, cut into runs of up to ``GROUP`` rules that all name words, or all name none."""
    out: list[list[int]] = []
    for i in ordinals:
        if not out or len(out[-1]) == GROUP or bool(table[i].words) != bool(table[out[-1][-1]].words):
            out.append([])
        out[-1].append(i)
    return out


def _special_hits(selected: set[int]) -> list[tuple[Column, int]]:
    """File-scope rules that look at particular lines or at their absence."""
    out: list[tuple[Column, int]] = []
    lines = F.col("lines")

    def any_line(pattern: str) -> Column:
        return F.exists(lines, lambda x: has_cs(strip(x), pattern))

    for i in set(ordinals("API-001")) & selected:
        code = F.regexp_replace(F.col("content"), java_pattern(V.COMMENTS), "")
        applies = (
            F.col("is_code")
            & F.col("api_path")
            & (F.col("id_path") | has_cs(code, V.ID_PARAMETER))
            & has(code, V.RESOURCE_ACCESS)
            & ~has(code, V.RESOURCE_GUARD)
        )
        where = F.coalesce(
            F.get(
                F.filter(
                    F.transform(lines, lambda x, n: F.struct((n + 1).alias("line"), x.alias("text"))),
                    lambda s: has_cs(s["text"], V.PARAMETER_LINE),
                ),
                F.lit(0),
            )["line"],
            F.lit(1),
        )
        first = F.get(lines, where - 1)
        text = F.when(strip(first) == "", F.col("path")).otherwise(first)
        out.append((F.when(applies, _hit(where, text, i)), i))
    dep_absent = [i for i in ordinals("DEP-001") if RULES[i].scope == "special" and i in selected]
    for i in dep_absent:
        absent = F.col("is_dockerfile") & ~any_line(V.DOCKER_USER)
        out.append((F.when(absent, _hit(F.lit(1), F.lit("No USER directive."), i)), i))
    for i in set(ordinals("DEP-004")) & selected:
        absent = F.col("is_dockerfile") & ~any_line(V.DOCKER_HEALTH)
        out.append((F.when(absent, _hit(F.lit(1), F.lit("No HEALTHCHECK directive."), i)), i))
    return out


def rule_hits(
    files: DataFrame,
    selected: Iterable[int] | None = None,
    prefilter: bool = True,
    user_rules: Iterable[Rule] = (),
    keep: Iterable[str] = (),
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``hits``: array of (line, text, ords) for the selected line and file rules.

    ``prefilter`` lets word tests run ahead of the patterns; results are the same
    without it. A user rule that names no words has every line tested.

    Further columns of the result are ``repo_id``, ``path``, ``keep`` and ``extra``,
    expressions over (path, base, ext, content, low) that share the same read; ``low`` is the
    content in lower case, of which the lines without any of ``FILE_WORDS`` may be left out.
    """
    table = list(RULES) + list(user_rules)
    chosen = set(range(len(table))) if selected is None else set(selected)
    chosen |= set(range(len(RULES), len(table)))
    used: set[str] = {"is_dockerfile", "is_compose", "is_ci"}
    cand = F.col("candidates")

    def compile_line(row: Column, ordinal: int) -> Column:
        rule = table[ordinal]
        condition = rule.when(Line(row, used))
        return holds_any(row["low"], rule.words) & condition if prefilter and rule.words else condition

    line_ords = [i for i in sorted(chosen) if table[i].scope == "line"]
    first_ords = [i for i in sorted(chosen) if table[i].scope == "first"]
    file_ords = [i for i in sorted(chosen) if table[i].scope == "file"]
    special = _special_hits(chosen)
    if any(RULES[i].rule_id == "API-001" for _, i in special):
        used |= {"is_code", "api_path", "id_path"}

    def fired(row: Column) -> Column:
        none = F.array().cast("array<int>")
        groups = []
        for ords in _groups(line_ords, table):
            found = F.array_compact(F.array(*[F.when(compile_line(row, i), F.lit(i)) for i in ords]))
            words = [w for i in ords for w in table[i].words]
            groups.append(F.when(row["low"].rlike(words_pattern(words)), found).otherwise(none) if prefilter and words else found)
        return F.concat(*groups)

    parts: list[Column] = []
    if line_ords:
        marked = F.transform(
            cand, lambda r: F.struct(r["line"].alias("line"), r["text"].alias("text"), fired(r).alias("ords"))
        )
        parts.append(F.filter(marked, lambda h: F.size(h["ords"]) > 0))
    def first_hit(ordinal: int) -> Column:
        matching = F.filter(cand, lambda r: compile_line(r, ordinal))
        return F.get(F.transform(matching, lambda r: _hit(r["line"], r["text"], ordinal)), F.lit(0))

    single = [first_hit(i) for i in first_ords]
    level = _FileLevel(used)
    single += [F.when(table[i].when(level), _hit(F.lit(1), F.col("path"), i)) for i in file_ords]
    single += [c for c, _ in special]
    if single:
        parts.append(F.array_compact(F.array(*single)))
    hits = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(f"array<{HIT}>")

    keep = list(keep)
    low = F.col("low")
    flags = file_flags(low if prefilter else None)
    needed = {n: flags[n]() for n in flags if n in used}
    infra = F.col("is_dockerfile") | F.col("is_compose") | F.col("is_ci")
    infra_path = flags["is_dockerfile"]() | flags["is_compose"]() | flags["is_ci"]()
    words = line_words(table[i] for i in sorted(chosen)) if prefilter else None
    fenced = with_barrier(with_names(files), {"lines": split_lines(F.col("content"))})
    fenced = with_barrier(fenced, {"low_lines": F.transform("lines", F.lower)})
    fenced = with_barrier(fenced, {"noted": _noted(words, infra_path)})
    fenced = with_barrier(with_barrier(fenced, {"low": F.array_join(F.transform("noted", lambda s: s["low"]), "\n")}), needed)
    return fenced.withColumn("candidates", _candidates(words, infra)).select(
        "repo_id",
        "path",
        *keep,
        hits.cast(f"array<{HIT}>").alias("hits"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def explode_hits(digest: DataFrame) -> DataFrame:
    """(repo_id, path, line, text, ord): one row per rule firing."""
    return (
        digest.select("repo_id", "path", F.explode_outer("hits").alias("h"))
        .select("repo_id", "path", "h.line", "h.text", F.explode_outer("h.ords").alias("ord"))
        .filter(F.col("ord").isNotNull())
    )
