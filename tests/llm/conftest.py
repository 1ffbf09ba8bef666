import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def stage(spark):
    from revspark.llm.common import Stage
    return Stage(spark, "tests")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, source]) with an extra column whose name clashes with inner ones."""
    def make(rows):
        rows = [(*r, "en", 0, "x")[:6] if len(r) == 2 else (*r, "x") for r in rows]
        full = [(r[0], r[1], "src" if len(r) < 5 else r[2], "en", 0, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, node string")
    return make
