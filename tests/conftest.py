import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from strandlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("strandlab-tests", cpus="8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def series_rows(spark, matrix, labels, dataset="d", **extra):
    """Series table from a list of rows; ids are row numbers."""
    rows = [(dataset, i, int(l), [float(v) for v in x]) for i, (x, l) in enumerate(zip(matrix, labels))]
    return spark.createDataFrame(rows, "dataset_name string, series_id bigint, label bigint, series array<double>")
