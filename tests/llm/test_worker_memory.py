"""What one task's Python worker takes, and gives back when a task ends."""

import random
import tracemalloc

import pyarrow as pa

from pantrylens.llm import shared, suffix_dedup


class Plain:
    """In place of a DataFrame: hands out the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_anchors_work_in_small_steps():
    rnd = random.Random(5)
    texts = [rnd.randbytes(50_000).hex() for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], names=["key", "text"])
    shared.powers(shared.SMALL_STEP_BYTES + 1)
    run = suffix_dedup.anchors(Plain(), 50, 8)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        assert rows and tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append("released")

    monkeypatch.setattr(shared.pa, "default_memory_pool", Pool)
    run = shared.giving_back(lambda batches: (calls.append(b) or b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and calls == [1, 2, "released"]
    assert list(run(iter([]))) == []
