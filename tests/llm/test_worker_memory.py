"""What a Python worker holds beside its batch while it reads texts."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tracklore.llm import bpe, jaccard, language, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _kernel(name):
    if name == "packing":
        return packing._pieces(SimpleNamespace(value=(tuple(bpe.load_ranks(PATH)), tuple(bpe.load_added(PATH).items()))), 1024, 2)
    return jaccard._row_sets(5) if name == "sets" else language._likelihoods(SimpleNamespace(value=np.zeros((4, language.CELLS), np.float32)))


@pytest.mark.parametrize("name, most", [("packing", 60), ("sets", 20), ("language", 25)])
def test_worker_holds_little_beside_its_batch(name, most):
    rng = np.random.default_rng(7)
    lexicon = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 20_000)])
    texts = [" ".join(lexicon[rng.zipf(1.3, 300) % len(lexicon)]) for _ in range(8_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    run = _kernel(name)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(name, f"{batch.nbytes / 1e6:.0f} MB of text, peak {peak:.0f} MB")
    assert rows >= len(texts) and peak < most
