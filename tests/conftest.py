from __future__ import annotations

import pytest

from flowsieve.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "flowsieve-tests")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as dictionaries, in a stable order."""
    def read(df, *order):
        found = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(found, key=lambda r: [str(r[c]) for c in order]) if order else found
    return read
