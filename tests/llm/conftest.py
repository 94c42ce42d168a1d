import random

import pytest


@pytest.fixture
def docs(spark):
    """Make documents (doc_id, text) with clashing extra columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, n_lines string, toxicity bigint")

    return make


@pytest.fixture
def rng():
    return random.Random(5)
