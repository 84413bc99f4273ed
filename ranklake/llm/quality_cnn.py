"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over every byte position of a text.  Chunks of ``CHUNK`` positions begin every
``STRIDE``, so neighbours share a quarter and together they cover the text.  Each filter's responses are
max-pooled per chunk, rectified, averaged over the chunks of the text, and combined by a logistic unit into
one probability.

A filter over one-hot bytes is a table lookup per position of the window, so a text costs ``WIDTH``
gathers.  The gradient of a max flows to one window per chunk and filter only.

Training sees a bounded sample: at most ``SAMPLE`` labelled rows of each class, by hash order of the
id.  Of each text an epoch takes at most ``CHUNKS`` chunks, drawn anew from ``DRAWN`` that are spread over the
whole text (all of a text of up to 24 KB); so the sample is at most ``2 * SAMPLE * DRAWN * CHUNK`` bytes.  Scores cover whole texts, in blocks, without
any shuffle.

Defined cases: a null or empty text is scored like a chunk of padding; without labelled rows every
score is 0.5; rows with the same id are scored each; a null id is scored too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.blocks import Block, blocks
from ranklake.llm.names import unused

WIDTH = 6
FILTERS = 24
CHUNK = 512
STRIDE = 384
SAMPLE = 1500
CHUNKS = 4
EPOCHS = 12
DRAWN = EPOCHS * CHUNKS
BATCH = 64
RATE = 0.02
SEED = 7
INFER_BYTES = 128 * 1024


@dataclass
class Model:
    """tables: (WIDTH, 256, FILTERS), one per window position; bias, weights: (FILTERS,)."""

    tables: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with WIDTH - 1 zeros after each; the chunks' first positions and ends, each text's first chunk, and
    the positions of the zeros between texts."""
    starts, ends, first, parts, at, gaps = [], [], [0], [], 0, []
    gap = np.zeros(WIDTH - 1, np.uint8)
    for t in texts:
        body = t if len(t) else np.zeros(1, np.uint8)
        # The last chunk begins before the overlap would reach the end.
        own = range(at, at + max(1, len(body) - (CHUNK - STRIDE)), STRIDE)
        starts += own
        ends += [min(s + CHUNK, at + len(body)) for s in own]
        first.append(len(starts))
        parts += [body, gap]
        at += len(body) + WIDTH - 1
        gaps.append(at - WIDTH + 1)
    between = (np.array(gaps[:-1], np.int64)[:, None] + np.arange(WIDTH - 1)).ravel()
    return np.concatenate(parts), np.array(starts), np.array(ends), np.array(first), between


def _pooled(responses: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each filter's maximum in each chunk; chunks overlap."""
    cuts = np.stack((starts, ends), axis=1).ravel()
    whole = responses if cuts[-1] < len(responses) else np.concatenate((responses, np.full((1, responses.shape[1]), -np.inf, responses.dtype)))
    return np.maximum.reduceat(whole, cuts, axis=0)[::2]


def _responses(tables: np.ndarray, data: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Of all filters at each position; a window that begins between texts belongs to none."""
    n = len(data) - WIDTH + 1
    out = tables[0][data[:n]]
    for k in range(1, WIDTH):
        out += tables[k][data[k : k + n]]
    out[between] = -np.inf
    return out


def score_texts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Probability of label 1 for texts of bytes."""
    data, starts, ends, first, between = _padded(texts)
    pooled = _pooled(_responses(model.tables, data, between), starts, ends)
    pooled = np.maximum(pooled + model.bias, 0)
    mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
    return 1 / (1 + np.exp(-np.clip(mean @ model.weights + model.intercept, -30, 30)))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fits by Adam; an epoch takes a few chunks of each text, drawn anew; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    p = {
        "tables": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "weights": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "intercept": np.zeros(1, np.float32),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    positive = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * max(1, len(labels) - positive)))
    rounds = max(epochs, -(-200 * BATCH // len(texts)))
    total = rounds * -(-len(texts) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            picked = order[lo : lo + BATCH]
            data, starts, ends, first, between = _padded([_drawn(texts[i], rng) for i in picked])
            r = _responses(p["tables"], data, between)
            peak = _pooled(r, starts, ends)
            # Where each chunk's maximum stands.
            where = np.stack([r[a:b].argmax(0) + a for a, b in zip(starts, ends)])
            hidden = np.maximum(peak + p["bias"], 0)
            counts = np.diff(first)
            mean = np.add.reduceat(hidden, first[:-1], axis=0) / counts[:, None]
            prob = 1 / (1 + np.exp(-np.clip(mean @ p["weights"] + p["intercept"], -30, 30)))
            d = (weight[picked] * (prob - labels[picked]) / len(picked)).astype(np.float32)
            back = np.repeat(d / counts, counts)[:, None] * p["weights"] * (hidden > 0)
            g = {"weights": mean.T @ d + 1e-4 * p["weights"], "intercept": d.sum(keepdims=True), "bias": back.sum(0)}
            g["tables"] = np.zeros_like(p["tables"])
            column = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(g["tables"][k], (data[where + k], column), back)
            step += 1
            rate = RATE * (1 - step / (total + 1)) + 1e-4
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Model(p["tables"], p["bias"], p["weights"], float(p["intercept"][0]))


def _drawn(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """CHUNKS chunks of a text, drawn without repetition, in order; a short text whole."""
    n = -(-len(text) // CHUNK)
    if n <= CHUNKS:
        return text
    return np.concatenate([text[i * CHUNK : (i + 1) * CHUNK] for i in np.sort(rng.choice(n, CHUNKS, replace=False))])


def spread_chunks(text: bytes) -> bytes:
    """At most DRAWN chunks of a text, evenly spread from its beginning to its end."""
    n = -(-len(text) // CHUNK)
    if n <= DRAWN:
        return text
    return b"".join(text[i * CHUNK : (i + 1) * CHUNK] for i in (k * (n - 1) // (DRAWN - 1) for k in range(DRAWN)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column("text")):
            texts = [spread_chunks(b.text(i)) for i in range(b.hi - b.lo)]
            rows = batch.slice(b.lo, b.hi - b.lo)
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("order"), pa.array(texts, pa.binary())], names=["label", "order", "text"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model of ``label`` (0 or 1) from rows of ``labels`` that are ``usable``; None without any."""
    order = F.xxhash64(F.lit(SEED), F.col(id))
    known = labels.filter(usable & F.col(label).isin(0, 1) & F.col(id).isNotNull())
    known = known.groupBy(id).agg(F.max(label).cast("int").alias("label")).withColumn("order", order)
    # At most SAMPLE ids a class, which bounds the broadcast and what reaches the driver.
    picked = known.filter("label = 0").orderBy("order", id).limit(SAMPLE).unionByName(
        known.filter("label = 1").orderBy("order", id).limit(SAMPLE)
    )
    rows = (
        docs.select(F.col(id), F.col(text).cast("binary").alias("text"))
        .join(F.broadcast(picked), id)
        .select("label", "order", "text")
        .mapInArrow(_sampled, "label int, order long, text binary")
        .orderBy("order", "text")
        .limit(2 * SAMPLE)
        .toArrow()
    )
    if not rows.num_rows:
        return None
    texts = [np.frombuffer(t or b"", np.uint8) for t in rows.column("text").to_pylist()]
    return train(texts, rows.column("label").to_numpy())


def _scorer(model: Model | None, held: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.drop_columns([held])
            for block in blocks(batch.column(held), INFER_BYTES):
                n = block.hi - block.lo
                scores = np.full(n, 0.5) if model is None else score_block(model, block)
                rows = own.slice(block.lo, n)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], names=[*own.schema.names, name])

    return run


def score_block(model: Model, block: Block) -> np.ndarray:
    return score_texts(model, [block.data[a:b] for a, b in zip(block.offsets[:-1], block.offsets[1:])])


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, row by row."""
    held = unused("_text", [*keep, name])
    source = docs.select(*keep, F.col(text).cast("binary").alias(held))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_scorer(model, held, name), f"{fields}, `{name}` double")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the documents that score below one half."""
    name = unused("score", docs.columns)
    return score(docs, model, keep=tuple(docs.columns), name=name).filter(F.col(name) >= 0.5).drop(name)
