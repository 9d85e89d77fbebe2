import pytest

pytest.importorskip("assaykit.llm")
