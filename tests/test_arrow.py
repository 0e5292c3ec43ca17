import numpy as np
import pyarrow as pa
import pytest

from tidemark.arrow import edges, runs


@pytest.mark.parametrize("most_rows", [1, 2, 3, 7, 64, 4096])
def test_groups_are_never_torn(most_rows):
    rng = np.random.default_rng(most_rows)
    for longest in (1, 3, 40):
        sizes = rng.integers(1, longest + 1, 60)
        a = np.repeat(np.arange(60) // 4, sizes)
        b = np.repeat(np.arange(60) % 4, sizes)
        whole = pa.table({"a": a, "b": b, "n": np.arange(len(a))})
        batches = whole.to_batches(max_chunksize=int(rng.integers(1, 50)))
        got = list(runs(iter(batches), ["a", "b"], most_rows=most_rows))
        assert pa.concat_tables(got).equals(whole.combine_chunks()) or pa.concat_tables(got).to_pydict() == whole.to_pydict()
        keys = [(x, y) for t in got for x, y in {*zip(t.column("a").to_pylist(), t.column("b").to_pylist())}]
        assert len(keys) == len(set(keys)) == 60  # each group in one table
        for t in got:
            at = edges(t, ["a", "b"])
            assert at[0] == 0 and at[-1] == t.num_rows and len(at) - 1 == len(set(zip(t.column("a").to_pylist(), t.column("b").to_pylist())))
