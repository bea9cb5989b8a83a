import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from girder.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


VIOLATION = "STRUCT<bounding_box: ARRAY<ARRAY<DOUBLE>>, reason: STRING>"
SAMPLE = (
    "image_id STRING, image_caption STRING, illumination STRING, camera_distance STRING, view STRING, quality_of_info STRING, "
    + ", ".join(f"rule_{i}_violation {VIOLATION}" for i in range(1, 5))
    + ", excavator ARRAY<ARRAY<DOUBLE>>, rebar ARRAY<ARRAY<DOUBLE>>, worker_with_white_hard_hat ARRAY<ARRAY<DOUBLE>>, resolution BIGINT"
)


@pytest.fixture(scope="session")
def sample_schema():
    return SAMPLE


def sample(image_id="0000001", caption="a site", rules=None, excavator=None, rebar=None, hat=None, resolution=100, illumination="night"):
    """A row of SAMPLE; rules is {number: (boxes, reason)}."""
    rules = rules or {}
    return (image_id, caption, illumination, "mid distance", "ground view", "rich", *[rules.get(i) for i in range(1, 5)], excavator or [], rebar or [], hat or [], resolution)


@pytest.fixture(scope="session")
def make_sample():
    return sample
