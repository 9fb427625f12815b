import pytest

from veilspark.llm import octets


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    """Texts are cut into parts of 4 KB instead of 1 MB, so that short fixtures cross them."""
    monkeypatch.setattr(octets, "SLICE", 4096)
