import pytest

from cohortlane.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.driver.memory": "8g"})


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


def rows(df, *order):
    """All rows as tuples in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
