import pyarrow as pa

from folioscope.llm import batches


def test_slices_keep_order_and_bounds(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 2000)
    texts = ["x" * n for n in (0, 10, 5000, 3, 900, 900, 900, 900, 1)] * 60
    given = [pa.RecordBatch.from_pydict({"t": texts}), pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]
    got = list(batches.slices(iter(given)))
    assert [t for part in got for t in part.column("t").to_pylist()] == texts
    assert all(part.num_rows == 1 or part.nbytes <= 2000 for part in got)
    assert max(part.num_rows for part in got) <= batches.SLICE_ROWS
