import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from helispan.session import local_session, ship

    session = local_session(cores=os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4, memory="4g")
    ship(session)
    yield session
    session.stop()
