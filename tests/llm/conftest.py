import pytest

from corpus_data import make_rows, write


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def sf(spark, rows, tmp_path_factory):
    return write(spark, rows, tmp_path_factory.mktemp("sf"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, [], tmp_path_factory.mktemp("none"), parts=1)
