import pytest

from framewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    # many small plans: quick compilation matters more than fast code
    session = local_session(8, 2, **{
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
