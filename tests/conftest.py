from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def chats_of(spark):
    """Build a ``chats`` table from ``{dataset: [[(role, content), ...], ...]}``."""

    def build(datasets):
        rows = [
            (name, i, [{"role": r, "content": c} for r, c in conversation])
            for name, conversations in datasets.items()
            for i, conversation in enumerate(conversations)
        ]
        return spark.createDataFrame(
            rows,
            "dataset_id string, conv_id bigint, messages array<struct<role: string, content: string>>",
        )

    return build
