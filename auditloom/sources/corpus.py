"""Turns the ``documents`` text table into a files table of many repositories.

Forty consecutive documents form one repository. The whole text of a document is
kept in its file; a constant snippet chosen by position is added, because the
text itself holds no code. Everything is one narrow projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import constant_array
from auditloom.session import spread
from auditloom.sources import plants as P

SLOTS = 40


def _pick(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(constant_array(options), (F.pmod(index, F.lit(len(options))) + 1).cast("int"))


def _commented(text: Column, mark: str) -> Column:
    return F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))


def _place() -> Column:
    """repo_id and path of the document ``doc_id``."""
    doc = F.col("doc_id")
    block = F.floor(doc / SLOTS)
    slot = F.pmod(doc, F.lit(SLOTS))
    n = doc.cast("string")

    def by(*paths: str) -> Column:
        """The path of this slot: one of ``paths`` by block; %N is the document number."""
        return F.replace(_pick(paths, block), F.lit("%N"), n)

    code_path = F.concat(
        _pick(P.CODE_DIRS, slot + block), F.lit("unit_"), n, _pick(P.CODE_EXTS, doc)
    )
    special_paths = {
        0: ("package.json", "package.json", "package.json", "src/misc/unit_%N.js"),
        1: ("package-lock.json", "yarn.lock", "src/notes/unit_%N.ts"),
        2: ("requirements.txt", "pyproject.toml"),
        3: (".env.example", ".env.example", "config/settings.py"),
        4: (".env", ".env.production", ".env.local"),
        5: ("Dockerfile",),
        6: ("docker-compose.yml",),
        7: (".github/workflows/ci.yml", ".gitlab-ci.yml"),
        8: (".gitignore",),
        9: (".auditignore",),
        10: (".auditrc", "audit.config.json", ".auditrc.json", "src/lib/unit_%N.js"),
        11: ("app/(shop)/items/[id]/route.ts", "app/api/orders/route.js"),
        12: ("pages/api/users/unit_%N.ts", "pages/api/index.js"),
        13: ("next.config.js",),
        14: ("config/prod.json", "config/app.json"),
        15: ("node_modules/pkg/unit_%N.js",),
        16: ("dist/unit_%N.js", "server/old/unit_%N.js"),
        17: ("tests/app.test.js", "src/util/unit_%N.js", "src/util/unit_%N.js"),
        18: ("db/schema_%N.sql",),
        19: ("prisma/unit_%N.js", "migrations/unit_%N.js"),
    }
    path = F.when(F.lit(False), F.lit(""))
    for number, options in special_paths.items():
        path = path.when(slot == number, by(*options))
    path = path.otherwise(code_path)
    return F.struct(F.concat(F.lit("repo-"), block.cast("string")).alias("repo_id"), path.alias("path"))


def corpus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path) of :func:`corpus_files`, from the ids alone; no text is read or shuffled."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return ids.select(F.inline(F.array(_place())))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, length, content) derived from ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    doc, text = F.col("doc_id"), F.col("text")
    block = F.floor(doc / SLOTS)
    slot = F.pmod(doc, F.lit(SLOTS))

    js = F.concat(text, F.lit("\n"), _pick(P.JS_PLANTS, slot + block * 7), F.lit("\n"))
    py = F.concat(_commented(text, "# "), F.lit("\n"), _pick(P.PY_PLANTS, doc + block), F.lit("\n"))
    prose = F.regexp_replace(text, "[^A-Za-z ]", " ")

    def conf(options: tuple[str, ...]) -> Column:
        return F.concat(_pick(options, block), F.lit("\n"), _commented(text, "# "))

    package = F.concat(
        F.lit('{"name":"pkg-'),
        block.cast("string"),
        F.lit('","description":"'),
        prose,
        F.lit('",'),
        _pick(P.PACKAGE_PLANTS, block),
        F.lit("}"),
    )
    base = F.substring_index("path", "/", -1)
    content = (
        F.when(base == "package.json", package)
        .when(base == "package-lock.json", _pick(P.LOCK_PLANTS, F.floor(block / 3)))
        .when(base == "requirements.txt", conf(P.REQUIREMENT_PLANTS))
        .when(base == "pyproject.toml", F.concat(F.lit("fastapi\n"), _commented(text, "# ")))
        .when(base == "yarn.lock", _commented(text, "# "))
        .when(base == ".env.example", conf(P.ENV_EXAMPLE_PLANTS))
        .when(base.startswith(".env"), conf(P.ENV_PLANTS))
        .when(base == "Dockerfile", conf(P.DOCKER_PLANTS))
        .when(base == "docker-compose.yml", conf(P.COMPOSE_PLANTS))
        .when(F.col("path").contains("ci.yml"), conf(P.CI_PLANTS))
        .when(base == ".gitignore", conf(P.GITIGNORE_PLANTS))
        .when(base == ".auditignore", conf(P.IGNORE_LIST_PLANTS))
        .when(F.col("path").isin(".auditrc", "audit.config.json", ".auditrc.json"), _pick(P.POLICY_PLANTS, block))
        .when(F.col("path").startswith("app/(") | F.col("path").startswith("app/api/"), F.concat(text, F.lit("\n"), _pick(P.NEXT_APP_PLANTS, block)))
        .when(F.col("path").startswith("pages/api/"), F.concat(text, F.lit("\n"), _pick(P.NEXT_PAGES_PLANTS, block)))
        .when(base == "next.config.js", F.concat(F.lit(P.NEXT_CONFIG_PLANT + "\n"), text))
        .when(F.col("path").startswith("config/") & base.endswith(".json"), F.concat(F.lit(P.PROD_JSON_PLANT + "\n"), text))
        .when(base.endswith(".sql"), F.concat(F.lit(P.SQL_FILE_PLANT + "\n"), _commented(text, "-- ")))
        .when(base.endswith(".py"), py)
        .otherwise(js)
    )
    # one-element generators keep filters on path and length from copying these
    # long expressions into themselves
    named = docs.select("text", "doc_id", F.inline(F.array(_place())))
    filled = named.select("repo_id", "path", F.inline(F.array(F.struct(content.alias("content")))))
    return filled.select("repo_id", "path", F.octet_length("content").cast("long").alias("length"), "content")
