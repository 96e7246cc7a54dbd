"""Scalar text functions: fingerprints, secret masking, small cleaners."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.regex import java_pattern, squeeze, strip, words_pattern

# --- fixed values: masking formats -------------------------------------------------
KNOWN_PREFIXES = (
    "audit_test_",
    "sk_live_",
    "sk_test_",
    "pk_live_",
    "pk_test_",
    "sk-ant-",
    "sk-",
    "ghp_",
    "gho_",
    "ghu_",
    "ghs_",
    "ghr_",
    "xoxb-",
    "xoxp-",
    "xoxa-",
    "xoxr-",
    "AIza",
    "AKIA",
    "SG.",
)
URL_LOGIN = r"""([a-zA-Z][a-zA-Z0-9+.-]*:\/\/)([^:\s'"`]+):([^@\s'"`]+)(@[^\s'"`]+)"""
SECRET_ASSIGNMENT = (
    r"""((?:key|secret|token|password|passwd|api[_-]?key|auth[_-]?token)\s*[:=]\s*["'])([^"'\s]{6,})(["'])"""
)
ANSI_CODE = r"\x1B\[[0-9;]*[a-zA-Z]"
# -----------------------------------------------------------------------------------


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def fingerprint(rule_id: Column, path: Column, category: Column, snippet: Column) -> Column:
    """First 16 hex digits of SHA-256 over rule, path, category and squeezed snippet."""
    raw = F.concat_ws(
        ":",
        rule_id,
        normalize_path(F.coalesce(path, F.lit(""))),
        F.coalesce(category, F.lit("")),
        squeeze(F.coalesce(snippet, F.lit(""))),
    )
    return F.substring(F.sha2(raw, 256), 1, 16)


def sql_text(value: str | None) -> str:
    """A SQL string literal; ``$`` is escaped, as ``${..}`` would be taken for a variable."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def constant_array(values: Iterable[str | None]) -> Column:
    """One parsed literal array; long constant lists built call by call are slow to plan."""
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def constant_map(pairs: Mapping[str, object]) -> Column:
    items = ", ".join(f"{sql_text(k)}, {sql_text(v) if isinstance(v, str) else v}" for k, v in pairs.items())
    return F.expr(f"map({items})")


def mask_secret_text(value: str) -> str:
    """SQL text that keeps a short recognisable head of one secret and stars the rest.

    ``value`` is a column name or SQL text of an already trimmed string.
    """
    v = value
    scheme = f"regexp_extract({v}, '^([a-zA-Z][a-zA-Z0-9+.-]*://)', 1)"
    body = f"substring({v}, length({scheme}) + 1)"
    host = f"substring_index({body}, '@', -1)"
    login = f"left({body}, length({body}) - length({host}) - 1)"
    colon = f"instr({login}, ':')"
    is_url = f"length({scheme}) > 0 AND contains({body}, '@') AND {colon} > 1"
    prefixes = " ".join(
        f"WHEN startswith({v}, {sql_text(p)}) THEN concat({sql_text(p)}, repeat('*', greatest(6, length({v}) - {len(p)})))"
        for p in KNOWN_PREFIXES
    )
    keep = f"least(4, cast(floor(length({v}) / 3) as int))"
    return (
        f"CASE WHEN {v} IS NULL OR length({v}) <= 6 THEN '******'"
        f" WHEN {is_url} THEN concat({scheme}, left({login}, {colon} - 1), ':********@', {host})"
        f" {prefixes}"
        f" ELSE concat(left({v}, {keep}), repeat('*', greatest(6, length({v}) - {keep}))) END"
    )


def with_masked_secret(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: the text of ``source`` taken as one secret and masked."""
    return df.withColumn("__v", strip(F.col(source))).withColumn(target, F.expr(mask_secret_text("__v"))).drop("__v")


def _known_formats_text(text: str) -> str:
    """URL passwords, then every known-prefix token of six characters or more; texts with no head of either are not searched."""
    out = f"regexp_replace({text}, {sql_text(java_pattern(URL_LOGIN))}, '$1$2:********$4')"
    for prefix in KNOWN_PREFIXES:
        head = prefix.replace(".", r"\.")
        # one star per token character; \G carries on from the previous replacement
        rx = rf"(\G(?!^)|{head}(?=[A-Za-z0-9_\-]{{6}}))[A-Za-z0-9_\-]"
        out = f"regexp_replace({out}, {sql_text(rx)}, '$1*')"
    heads = sql_text(words_pattern(["://", *KNOWN_PREFIXES]))
    return f"CASE WHEN {text} RLIKE {heads} THEN {out} ELSE {text} END"


def _assignments_text(text: str) -> str:
    """Star quoted values assigned to secret-like names, keeping the text around them."""
    rx = sql_text(java_pattern(SECRET_ASSIGNMENT, True))
    parts = ", ".join(f"regexp_extract_all({text}, {rx}, {n})" for n in (1, 2, 3))
    masked = f"transform(arrays_zip({parts}), p -> concat(p.`0`, {mask_secret_text('p.`1`')}, p.`2`))"
    rebuilt = f"transform(split({text}, {rx}), (gap, i) -> concat(gap, coalesce(get({masked}, i), '')))"
    signs = " AND ".join(f"({' OR '.join(f'contains({text}, {sql_text(s)})' for s in either)})" for either in (":=", "'\""))
    return f"CASE WHEN {signs} AND {text} RLIKE {rx} THEN array_join({rebuilt}, '') ELSE {text} END"


def with_masked_snippet(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: the text of ``source`` with every recognisable secret masked."""
    step = f"__{target}_known"
    return (
        df.withColumn(step, F.expr(_known_formats_text(f"coalesce(`{source}`, '')")))
        .withColumn(target, F.expr(_assignments_text(f"`{step}`")))
        .drop(step)
    )


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, java_pattern(ANSI_CODE), "")


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")
