import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


from listing_lake.session import local_session  # noqa: E402

# Test modules build expressions while they are imported, which needs a session.
SESSION = local_session(cores=4, partitions=4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate an expression over literal rows, in order."""
    def run(rows, schema, expr):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]

    return run
