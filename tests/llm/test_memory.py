"""What a worker holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from weftgraph.llm import ngram_join
from weftgraph.llm import quality as Q


def test_counting_grams_takes_little_memory():
    """Pieces of a megabyte took a hundred megabytes in each worker."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 105, 2000))) for _ in range(1000)]
    table = pa.table({"text": texts})
    tracemalloc.start()
    gram, count = Q.unit_grams(table, np.ones(len(texts), bool), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count.sum() == 2_000_000 and (np.diff(gram) > 0).all()
    assert peak < 50 << 20


def traced(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_fragment_makes_no_object_for_each_record():
    """With more documents a fragment of the same text has more and shorter records."""
    n = 200_000
    column = lambda x, t: pa.array(np.full(n, x), t)
    tokens = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 8).astype(np.int32)), pa.py_buffer(np.arange(n, dtype=np.uint64))])
    table = pa.table({"frag": column(0, pa.int32()), "doc": pa.array(np.arange(n)), "tag": pa.array(np.arange(n)), "size": column(9, pa.int32()), "have": column(9, pa.int32()), "tokens": tokens, "comp": pa.nulls(n, pa.int64())})
    assert traced(lambda: ngram_join._Fragment(table)) < 150 * n


def test_a_batch_is_measured_in_pieces():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(150)) for i in range(8_000)])
    found = []
    assert traced(lambda: found.append(ngram_join.measured_sets(texts, 5))) < texts.nbytes
    shingles, sizes = ngram_join.shingle_sets(texts, 5)
    assert all((a == b).all() for a, b in zip(found[0], (sizes, *ngram_join._digests(shingles, sizes))))
