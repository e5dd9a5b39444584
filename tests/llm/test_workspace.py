import random

from edges import edge_docs

from telemill.llm import workspace
from telemill.llm.spans import Spans


def test_spans_equal_plain_comparison():
    rng = random.Random(1)
    taken, s = [], Spans()
    for _ in range(500):
        a = rng.randrange(300)
        b = a + rng.randrange(1, 8)
        free = all(b <= x or a >= y for x, y in taken)
        assert s.take(a, b) is free
        if free:
            taken.append((a, b))


def test_tables_are_written_and_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_dir", lambda _: str(tmp_path))
    docs = edge_docs(spark)
    kept = workspace.materialise(docs, "docs")
    assert kept.schema == docs.schema and kept.count() == docs.count() and list((tmp_path / "telemill").iterdir())
    workspace.clear(spark)
    assert not (tmp_path / "telemill").exists()
