import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bandwright.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("bandwright-tests", os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star_folder():
    """Folder of the star-schema tables at a scale factor."""

    def folder(scale: str) -> str:
        path = TESTDATA / f"sf{scale}"
        if not path.is_dir():
            pytest.skip(f"no tables at {path}")
        return str(path)

    return folder
