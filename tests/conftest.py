import pytest

from scenequality.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, name="scenequality-tests", shuffle=4)
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
