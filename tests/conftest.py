from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditloom.session import get_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[8]", "auditloom-tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files table from {(repo, path): text}."""

    def build(texts: dict[tuple[str, str], str]):
        rows = [(r, p, len(t.encode()), t) for (r, p), t in texts.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, length long, content string")

    return build
