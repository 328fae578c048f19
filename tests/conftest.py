import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from piisieve.session import get_session
    s = get_session("local[4]", app="piisieve-tests", shuffle_partitions=4,
                    conf={"spark.piisieve.scan.minTasks": "4"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
