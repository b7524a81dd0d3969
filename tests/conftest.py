import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shiftledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_folder):
    session = local_session(
        "tests", cores="*", shuffle_partitions=4, memory="4g", **{"spark.checkpoint.dir": shared_folder}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a DataFrame as sorted tuples, in the given column order."""

    def collect(df, *cols):
        found = (df.select(*cols) if cols else df).collect()
        return sorted((tuple(r) for r in found), key=lambda r: [(v is not None, v) for v in r])

    return collect
