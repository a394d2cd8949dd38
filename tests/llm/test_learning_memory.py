"""What the task that learns toxicity holds: the sample once, in two bytes a coordinate, and no copies of the learner's state."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lattica.llm import toxicity as tx
from lattica.llm._ftrl import FTRL


def test_coordinates_take_two_bytes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        at = np.unique(rng.integers(0, tx.DIMS, n))
        got = tx.unpacked(tx.packed(at))
        assert got.tolist() == at.tolist() and len(tx.packed(at)) == 64 + 2 * len(at)
    edges = np.array([0, 65535, 65536, tx.DIMS - 1])
    assert tx.unpacked(tx.packed(edges)).tolist() == edges.tolist()


def test_sample_is_small():
    text = " ".join(f"w{k}" for k in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 1, 0]), pa.array([text, "", None])], names=["doc_id", "label", "text"])
    out = [b for b in tx._vectors([batch])]
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    want = np.unique(tx.features(data, off)[1])
    vecs = [v for b in out for v in b.column("at").to_pylist()]
    assert tx.unpacked(vecs[0]).tolist() == want.tolist() and not len(tx.unpacked(vecs[1])) and not len(tx.unpacked(vecs[2]))
    assert sum(len(v) for v in vecs) < 2.5 * len(want)


def test_weights_without_copies_of_the_state():
    m = FTRL(1 << 20, alpha=1.0, l1=3.0, l2=0.0)
    rng = np.random.default_rng(2)
    at = rng.integers(0, 1 << 20, 5000)
    m.z[0, at], m.n[0, at] = rng.normal(0, 5, 5000), rng.random(5000)
    want = m._weights(m.z, m.n)
    tracemalloc.start()
    got = m.weights()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 16e6  # the weights themselves take 8.4 MB
