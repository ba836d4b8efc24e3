import pytest

pytest.importorskip("kinograph.llm")
