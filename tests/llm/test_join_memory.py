"""What a task of the join's counting step holds: a batch or a fragment once, and little more to sort it."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import jaccard as jc


class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)  # noqa: N815


@pytest.fixture(autouse=True)
def task(monkeypatch):
    monkeypatch.setattr(jc, "TaskContext", Task)


def texts(rows):
    return [pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])]


def by(tables, column):
    rows = [r for t in tables for r in t.to_pylist()]
    rows.sort(key=lambda r: r[column])
    return [pa.RecordBatch.from_pylist(rows, schema=tables[0].schema)]


def peak(make):
    tracemalloc.start()
    n = sum(b.num_rows for b in make())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, most


def test_a_full_batch_is_held_once(monkeypatch):
    rng = np.random.default_rng(1)
    held = [np.unique(rng.integers(0, 2**64, 5000, np.uint64)) for _ in range(400)]  # 16 MB
    monkeypatch.setattr(jc, "sets", lambda *_: iter(held))
    batch = texts(["a"])
    n, most = peak(lambda: jc._asks(3, 1, frozenset())(batch))
    assert n and most < 48e6


def test_a_full_fragment_is_held_once():
    rng = np.random.default_rng(2)
    what = rng.integers(0, 2**32, 2_000_000, np.uint64).astype("<u4")
    ask = (0, 0, np.zeros(len(what), "<u2").tobytes(), what.tobytes(), what[:1_000_000].tobytes(), None, None, None)
    batch = jc._table([ask])
    n, most = peak(lambda: jc._answers([batch]))
    assert n and most < 48e6


def test_counts_over_batches_and_fragments(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [" ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(120)] + ["w1 w2 w3", "w1 w2 w3", None, ""]
    monkeypatch.setattr(jc, "BATCH", 500)
    own = []
    for _, data, off in jc.T.text_blocks(texts(rows)):
        own += [u for u in jc.sets(data, off, 2) if len(u)]
    nodes = {jc._node(u, ()): set(u.tolist()) for u in own}
    among = Counter(g for u in nodes.values() for g in u)
    for fragments in (1, 5, 40):
        asked = list(jc._asks(fragments, 2, frozenset())(texts(rows)))
        assert len({r["batch"] for t in asked for r in t.to_pylist()}) > 1
        told = list(jc._answers(by(asked, "to")))
        for percent in (30, 60, 100):
            found = {x for t in jc._enough(percent)(by(told, "batch")) for x in t.column("node").to_pylist()}
            assert found >= {k for k, u in nodes.items() if 100 * sum(among[g] > 1 for g in u) >= percent * len(u)}
