import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from auditlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="4", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds a corpus from {path: content} or {(project, path): content}."""

    def build(files):
        rows = [(k[0], k[1], v) if isinstance(k, tuple) else ("p", k, v) for k, v in files.items()]
        return spark.createDataFrame(rows, "project string, path string, content string")

    return build
