import pytest


@pytest.fixture(autouse=True, scope="session")
def few_blocks():
    """Small inputs in few tasks: the number of blocks changes no result."""
    from feedloom.llm import blocks

    blocks.FEWEST = 3
    yield
