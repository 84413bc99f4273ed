"""Built-in models: memory and independence of the batch."""

import tracemalloc

import numpy as np

from ranklake.functions import models


def test_long_texts_are_embedded_a_few_at_a_time(monkeypatch):
    texts = ["", *(" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(40)), "a  a b"]
    embed = models.hashing_embedder(16)()
    alone = np.concatenate([embed([text]) for text in texts])
    monkeypatch.setattr(models, "CHARS_AT_ONCE", 100_000)
    tracemalloc.start()
    together = embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (together == alone).all() and embed([]).shape == (0, 16)
    assert peak < sum(map(len, texts)) * 4
