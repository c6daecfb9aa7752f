"""Memory of the pipeline's last stage."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.llm import pieces
from quarry.llm.kernels import CHUNK_BYTES
from quarry.llm.queries import PIECES, tokenizer_file


def test_smaller_runs_hold_less_and_give_the_same_ids():
    rng = random.Random(16)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)) for _ in range(80)]
    batch = pa.record_batch({"doc_id": pa.array(range(80), pa.int64()), "text": texts})
    sampler = pieces.Sampler(tokenizer_file(PIECES))
    peaks, ids = [], []
    for limit in (CHUNK_BYTES, pieces.STAGE_BYTES):
        tracemalloc.start()
        ids.append([])
        for _, some, *_ in pieces._worked(batch, sampler, limit):
            ids[-1].append(some.copy())
        peaks.append(tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in ids[-1]))
        tracemalloc.stop()
    assert np.array_equal(np.concatenate(ids[0]), np.concatenate(ids[1]))
    assert peaks[1] < 0.5 * peaks[0]
