import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names the operators might use themselves."""

    def make(rows):
        full = [(i, t, "en", 7, 8, 9.5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, k1 long, _k1 int, score double")

    return make
