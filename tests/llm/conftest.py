import pytest

from tidemill.llm import frames


@pytest.fixture(autouse=True, scope="session")
def hurry():
    """Tests free nothing that would be worth a wait."""
    before, frames.PAUSE = frames.PAUSE, 0.0
    yield
    frames.PAUSE = before
