import pytest


@pytest.fixture(autouse=True)
def _shipped(spark):
    from ravenhunt.session import ensure_on_workers

    ensure_on_workers(spark)
