import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomgraph.session import local_session

    session = local_session(4, 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def repo(tmp_path):
    """Write {path: text} as files; the folder."""

    def write(files):
        for path, text in files.items():
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(text)
        return str(tmp_path)

    return write


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
