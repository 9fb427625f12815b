"""Text quality by a byte-level convolutional network written in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.common import extended, fitted
from veilspark.llm.octets import Rolling, pieces, text_buffers

#: Training texts of each label at most, and the characters of an excerpt used for training.
SAMPLE, SAMPLE_CHARS = (1_200, 1_200), 12_000
#: Bytes of a chunk and of a filter; each chunk also sees the first bytes of the next, and filters stand at every byte.
CHUNK, WIDTH = 512, 8
FILTERS, CHANNELS = 16, 8
EPOCHS, BATCH, RATE = 12, 32, 0.005
#: Small samples are gone through more often, to take so many steps.
STEPS = 600
#: Score from which a document counts as good.
THRESHOLD = 0.7

_BLANK = np.zeros(256, bool)
_BLANK[[0, 0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def chunks(data: np.ndarray, held: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all chunks, which of them belong to a word equal to the one before, and each chunk's piece."""
    lengths = np.array([e - s for _, s, e in held])
    counts = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(first[-1]) * CHUNK + WIDTH, np.uint8)
    for (_, s, e), at in zip(held, first.tolist()):
        flat[at * CHUNK:at * CHUNK + e - s] = data[s:e]
    piece = np.repeat(np.arange(len(held)), counts)
    word = ~_BLANK[flat]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    again = np.zeros(len(flat) + 1, np.float32)
    if len(start) > 1:
        hashes = Rolling(flat)(start, end)
        owner = piece[np.minimum(start // CHUNK, len(piece) - 1)]
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
        again[start[same]] += 1
        again[end[same]] -= 1
        np.cumsum(again, out=again)
    rows = (len(piece), CHUNK + WIDTH)
    view = np.lib.stride_tricks.as_strided(flat, rows, (CHUNK, 1)).copy()
    echo = np.lib.stride_tricks.as_strided(again, rows, (CHUNK * 4, 4)).copy()
    last = np.append(piece[1:] != piece[:-1], True) if len(piece) else np.zeros(0, bool)
    view[last, CHUNK:] = 0  # what follows is another text
    echo[last, CHUNK:] = 0
    return view, echo, piece


def convolve(model: dict, view: np.ndarray, echo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Channels of the bytes, and for each chunk and filter the largest response and where its window starts."""
    x = np.take(model["embedding"], view, axis=0)
    x[:, :, -1] = echo
    n = len(view)
    best, where = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int64)
    for shift in range(WIDTH):
        windows = x[:, shift:shift + CHUNK].reshape(n, CHUNK // WIDTH, WIDTH * CHANNELS)
        out = windows @ model["filters"]
        at = out.argmax(axis=1) if model.get("training") else None
        top = out.max(axis=1)
        better = top > best
        best = np.where(better, top, best)
        if at is not None:
            where = np.where(better, at * WIDTH + shift, where)
    return x, best + model["bias"], where


def pooled(response: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and mean positive response of each piece over its chunks; pieces without chunks have zeros."""
    positive = np.maximum(response, 0)
    first = np.searchsorted(piece, np.arange(n))
    full = np.flatnonzero(np.bincount(piece, minlength=n))
    top, total = np.zeros((n, FILTERS)), np.zeros((n, FILTERS))
    if len(full):
        top[full] = np.maximum.reduceat(positive, first[full], axis=0)
        total[full] = np.add.reduceat(positive, first[full], axis=0)
    return top, total


def fit(sample: list[tuple[str, int]], prior: float | None = None) -> dict | None:
    """Train on (text, 0 or 1) by Adam on small batches; None if one of the labels is missing.

    ``prior``: share of label 1 among all labelled rows, for the offset.
    """
    if {y for _, y in sample} != {0, 1}:
        return None
    rng = np.random.default_rng(7)
    y = np.array([v for _, v in sample], float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    data, ends = text_buffers(pa.array([t for t, _ in sample], pa.large_string()))
    scale = 1 / np.sqrt(WIDTH * CHANNELS)
    model = {
        "embedding": rng.normal(0, 0.5, (256, CHANNELS)).astype(np.float32),
        "filters": rng.normal(0, scale, (WIDTH * CHANNELS, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "top": np.zeros(FILTERS), "mean": np.zeros(FILTERS), "offset": np.zeros(1),
    }
    model["embedding"][0] = 0
    names = list(model)
    slow = {k: (np.zeros(model[k].shape), np.zeros(model[k].shape)) for k in names}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(sample)))
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        for b in range(0, len(order), BATCH):
            rows = order[b:b + BATCH]
            view, echo, piece = chunks(data, [(i, int(ends[r]), int(ends[r + 1])) for i, r in enumerate(rows)])
            x, response, where = convolve(model | {"training": True}, view, echo)
            n = len(rows)
            top, total = pooled(response, piece, n)
            count = np.maximum(np.bincount(piece, minlength=n), 1)[:, None]
            mean = total / count
            p = 1 / (1 + np.exp(-np.clip(top @ model["top"] + mean @ model["mean"] + model["offset"][0], -30, 30)))
            miss = (p - y[rows]) * weight[rows] / n
            live = response > 0
            first_top = live & (response == top[piece])
            g = (first_top * (miss[:, None] * model["top"])[piece] + live * (miss[:, None] * model["mean"] / count)[piece])
            chunk, f = np.nonzero(g)
            value = g[chunk, f]
            cells = where[chunk, f][:, None] + np.arange(WIDTH)
            patch = x[chunk[:, None], cells].reshape(-1, WIDTH * CHANNELS)
            grad = {"top": top.T @ miss, "mean": mean.T @ miss, "offset": np.array([miss.sum()]),
                    "bias": np.bincount(f, weights=value, minlength=FILTERS)}
            grad["filters"] = np.stack([patch[f == k].T @ value[f == k] for k in range(FILTERS)], axis=1)
            back = (value[:, None] * model["filters"].T[f]).reshape(-1, CHANNELS)
            octet = view[chunk[:, None], cells].ravel()
            grad["embedding"] = np.stack([np.bincount(octet, weights=back[:, c], minlength=256) for c in range(CHANNELS)], axis=1)
            grad["embedding"][0] = 0
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k in names:
                d = grad[k] + 1e-4 * model[k]
                m, v = slow[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                model[k] = (model[k] - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(model[k].dtype)
            model["embedding"][0] = 0
    if prior is not None and 0 < prior < 1:
        model["offset"] = model["offset"] + np.log(prior / (1 - prior))
    return model


def score(docs: DataFrame, model: dict | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add the probability of label 1 for the whole text.

    One pass, no shuffle.  The largest and the mean response over all chunks are
    combined, so every byte counts; texts of any length need the memory of 1 MB.
    Null and empty texts get the score of no response; without a model (no
    labelled rows of both kinds) every score is 0.5.  An input column with the
    output's name is replaced.
    """
    schema = extended(docs.schema, T.StructField(out, T.DoubleType()))
    kept = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            logit = np.zeros(n)
            if model:
                data, ends = text_buffers(batch.column(batch.schema.get_field_index(text)))
                top, total, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
                for held in pieces(data, ends, _BLANK):
                    view, echo, piece = chunks(data, held)
                    if not len(piece):
                        continue
                    _, response, _ = convolve(model, view, echo)
                    a, b = pooled(response, piece, len(held))
                    rows = np.array([r for r, _, _ in held])
                    np.maximum.at(top, rows, a)
                    np.add.at(total, rows, b)
                    np.add.at(count, rows, np.bincount(piece, minlength=len(held)))
                logit = top @ model["top"] + (total / np.maximum(count, 1)[:, None]) @ model["mean"] + model["offset"][0]
            value = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(value)], names=schema.names)

    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled rows that are not held out (a bounded sample of them)."""
    share = labels.where("quality in (0, 1) and doc_id is not null").where(
        "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").selectExpr("avg(quality)").first()[0]
    return fitted(docs, labels, "quality", SAMPLE, SAMPLE_CHARS, lambda sample: fit(sample, share))
