"""A worker that encodes shares its executor's memory with the heap and with another worker."""

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lakeledger.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_worker_encodes_much_text_in_little_memory():
    """4 MB of rare words in one batch."""
    bpe._encoder.cache_clear()
    rng = np.random.default_rng(13)
    letters = rng.integers(97, 123, 4_000_000, dtype=np.uint8)
    letters[rng.random(len(letters)) < 0.16] = 32
    texts = [letters[k : k + 4_000].tobytes().decode() for k in range(0, len(letters), 4_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["c0", "body_"])
    encode = bpe._encoding(PATH, "body_", 1, True)
    assert next(encode(iter([batch.slice(0, 1)]))).num_rows == 1  # the vocabulary is loaded
    tracemalloc.start()
    try:
        counts, digests = {}, {}
        for rows in encode(iter([batch])):
            counts |= zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())
            digests |= zip(rows.column(0).to_pylist(), rows.column(4).to_pylist())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        bpe._encoder.cache_clear()
    tokenizer = Tokenizer.from_file(PATH)
    assert list(counts) == list(range(len(texts)))
    assert all(digests[k] == hashlib.sha256(text.encode()).hexdigest() for k, text in enumerate(texts))
    assert all(counts[k] == len(tokenizer.encode(texts[k], add_special_tokens=False).ids) for k in range(0, len(texts), 50))
    assert most < 250e6, most
