"""Counts of the shingles of crowded keys: complete, in a few rows a task."""

import numpy as np
import pyarrow as pa

from millrace.llm import near_dup as N


def test_counts_take_few_rows_and_are_complete(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-(1 << 63), 1 << 63, 400)).tolist() for _ in range(300)]
    sets += [sets[0]] * 40 + [[]]
    made = list(N._token_counts([pa.RecordBatch.from_pydict({"hashes": pa.array(sets, pa.list_(pa.int64()))})]))
    assert 0 < sum(batch.num_rows for batch in made) <= 64
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "class long, hashes array<long>").repartition(9)
    expected = np.bincount(np.concatenate([np.array(s, np.int64) for s in sets]).view(np.uint64) >> np.uint64(64 - N.TOKEN_BITS), minlength=1 << N.TOKEN_BITS)
    assert np.array_equal(N._bin_counts(rows), expected)
    assert not N._bin_counts(rows.where("false")).any()
