import pytest

from fleetlens.session import ensure_checkpoint_dir, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    return session
