import pytest

pytest.importorskip("stemma.llm.queries")
