"""What slices and hashes of texts hold in memory, and that neither depends on the size of a block."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from civitext.llm import text_arrays as ta


def test_a_slice_in_use_keeps_no_batch():
    before = pa.total_allocated_bytes()

    def batches():
        rows = {"doc_id": pa.array([*range(9), None], pa.int64()), "text": pa.array([*("x" * (1 << 20) for _ in range(8)), None, ""]), "row": pa.array([{"a": [k], "none": None} for k in range(10)])}
        yield pa.RecordBatch.from_pydict(rows)

    read, seen = ta.slices(batches(), "text", 3 << 20), []
    for part in read:
        assert part.schema.names == ["doc_id", "text", "row"]
        seen += [(r["doc_id"], len(r["text"] or ""), r["row"]) for r in part.to_pylist()]
    assert seen == [(k if k < 9 else None, (1 << 20) * (k < 8), {"a": [k], "none": None}) for k in range(10)]
    assert part.num_rows == 4 and pa.total_allocated_bytes() - before < 3 << 20


def test_hashes_take_little_memory_and_do_not_depend_on_blocks(monkeypatch):
    pick = random.Random(3)
    text = " ".join("ab\x00é"[: pick.randrange(1, 5)] * pick.randrange(1, 9) for _ in range(90_000)) + " " + "z" * 200_000 + " end"
    data, bounds = ta.utf8(pa.array([text, None, "end", "z" * 200_000]))
    starts, ends, _ = ta.words(data, bounds)
    assert len(data) > 1 << 20
    ta.hash_words(data, starts, ends)
    tracemalloc.start()
    try:
        ta.release()
        hashes = ta.hash_words(data, starts, ends)
        ta.hash_runs(hashes, np.array([0, len(hashes)]), 5)
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
        ta.release()
        del hashes
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
    whole = ta.hash_words(data, starts, ends)
    assert whole[-1] == whole[-4] and whole[-2] == whole[-3]
    for size in (1, 1000, 1 << 22):
        monkeypatch.setattr(ta, "HASHED", size)
        some = slice(-300, None)
        assert (ta.hash_words(data, starts[some], ends[some]) == whole[some]).all()
