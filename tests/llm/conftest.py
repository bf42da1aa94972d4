import datetime

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of (doc_id, text) rows, with columns whose names operators use themselves."""

    def make(rows):
        schema = "doc_id long, text string, lang string, mark string, score string, n_chars long, created date"
        today = datetime.date(2024, 1, 1)
        return spark.createDataFrame([(i, t, None, "m", None, len(t or ""), today) for i, t in rows], schema)

    return make
