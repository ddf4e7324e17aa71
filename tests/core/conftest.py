import pytest


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(cpus=4, shuffle_partitions=4, memory="4g", name="tidemark-tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
