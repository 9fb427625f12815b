"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import extended, fitted, unused
from veilspark.llm.octets import LOWER, WORD, Rolling, joined, mixed, pieces, text_buffers, word_spans

#: Clean and toxic training texts at most, and the longest text used for training.
SAMPLE, SAMPLE_CHARS = (3_000, 1_000), 20_000
#: A chain has at most so many words in a row.
CHAIN = 32
#: Beginnings of words (bytes) that serve as features besides the whole word.
PREFIXES = (3, 4, 5, 6)
BITS = 18
#: Score from which a document is rejected, and marginal from which a word is marked.
THRESHOLD, MARK = 0.3, 0.5

_BREAKS = ~WORD[LOWER]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _words(data: np.ndarray, held: list[tuple[int, int, int]]):
    """Hashes (word, then prefixes; zero where the word is shorter), piece, place in the piece, start and end."""
    octets, at = joined(data, held)
    octets = LOWER[octets]
    start, end = word_spans(octets)
    roll = Rolling(octets)
    hashes = np.zeros((1 + len(PREFIXES), len(start)), np.uint64)
    hashes[0] = roll(start, end)
    for i, k in enumerate(PREFIXES, 1):
        long = np.flatnonzero(end - start >= k)
        hashes[i, long] = mixed(roll(start[long], start[long] + k) + np.uint64(i))
    first = np.searchsorted(start, at)
    piece = np.repeat(np.arange(len(held)), np.diff(first))
    return hashes, piece, np.arange(len(start)) - first[piece], start - at[piece], end - at[piece]


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Weight index of each feature; the last one stands for no feature and stays zero."""
    slots = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
    slots[hashes == 0] = 1 << BITS
    return slots


def _chains(piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Step and column of each word when pieces are cut into chains; number of columns."""
    new = place % CHAIN == 0
    return place % CHAIN, np.cumsum(new) - 1, int(new.sum())


def marginals(unary: np.ndarray, valid: np.ndarray, t: np.ndarray, start: float):
    """Forward and backward odds of label 1, exactly, for all chains (columns) at once.

    ``t`` holds the exponentials of the transition scores, ``unary`` the odds of
    each word.  Gives forward odds, backward odds.
    """
    ahead, back = np.empty_like(unary), np.ones_like(unary)
    ahead[0] = unary[0] * start
    for i in range(1, len(unary)):
        p = ahead[i - 1]
        ahead[i] = unary[i] * (p * t[1, 1] + t[0, 1]) / (p * t[1, 0] + t[0, 0])
    for i in range(len(unary) - 2, -1, -1):
        q = unary[i + 1] * back[i + 1]
        back[i] = np.where(valid[i + 1], (q * t[1, 1] + t[1, 0]) / (q * t[0, 1] + t[0, 0]), 1.0)
    return ahead, back


def _odds(score: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(score, -25, 25))


def _token_labels(types: np.ndarray, keys: np.ndarray, toxic: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which word types mark toxic text.

    ``types``: type of each word, ``keys``: feature hashes of each type,
    ``toxic``: whether its document is, ``before``: type of the word before.  A
    feature counts if it occurs in toxic documents after so many different words
    that chance is ruled out, and practically never in clean ones.  Counting
    different contexts keeps passages that were only copied from counting.
    """
    marked = np.zeros(keys.shape[1], bool)
    share = min(0.9, max(1e-3, toxic.mean()))
    size = keys.shape[1] + 1
    seen = np.unique(types[toxic].astype(np.int64) * size + before[toxic] + 1)
    contexts = seen // size, seen % size
    clean = np.bincount(types[~toxic], minlength=keys.shape[1])
    for row in keys:
        names, of = np.unique(row, return_inverse=True)
        pairs = np.unique(of[contexts[0]].astype(np.int64) * size + contexts[1])
        support = np.bincount(pairs // size, minlength=len(names))
        outside = np.bincount(of, weights=clean, minlength=len(names))
        good = (support * -np.log(share) >= np.log(len(names) + 1) + 3) & (outside <= 0.02 * support) & (names != 0)
        marked |= good[of]
    return marked


def fit(sample: list[tuple[str, int]], rounds: int = 60) -> dict | None:
    """Train on (text, 0 or 1); None if one of the labels is missing."""
    if {y for _, y in sample} != {0, 1}:
        return None
    data, ends = text_buffers(pa.array([t for t, _ in sample], pa.string()))
    label = np.array([y for _, y in sample], bool)
    parts, row_of = [], []
    for held in pieces(data, ends, _BREAKS):
        hashes, piece, place, _, _ = _words(data, held)
        parts.append((hashes, piece + len(row_of), place))
        row_of += [r for r, _, _ in held]
    hashes, piece, place = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
    del parts
    if not len(place):
        return None
    row_of = np.array(row_of)
    toxic = label[row_of[piece]]
    _, first, types = np.unique(hashes[0], return_index=True, return_inverse=True)
    keys = hashes[:, first]
    del hashes
    before = np.concatenate([[-1], types[:-1]])
    before[place == 0] = -1
    gold = (_token_labels(types, keys, toxic, before)[types] & toxic).astype(np.float64)

    step, column, n = _chains(piece, place)
    valid = np.zeros((CHAIN, n), bool)
    valid[step, column] = True
    y = np.zeros((CHAIN, n))
    y[step, column] = gold
    both = valid[1:] & valid[:-1]
    seen = np.array([[((1 - y[:-1]) * (1 - y[1:]))[both].sum(), ((1 - y[:-1]) * y[1:])[both].sum()],
                     [(y[:-1] * (1 - y[1:]))[both].sum(), (y[:-1] * y[1:])[both].sum()]])
    slots = _slots(keys)
    size = (1 << BITS) + 1
    # parameters: feature weights, bias, start, transitions; Adam on the mean log-likelihood of a chain
    theta = np.zeros(size + 2 + 4)
    theta[size] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    unary = np.ones((CHAIN, n))
    for k in range(1, rounds + 1):
        by_type = theta[slots].sum(axis=0) + theta[size]
        unary[step, column] = _odds(by_type)[types]
        t, start = np.exp(theta[size + 2:].reshape(2, 2)), np.exp(theta[size + 1])
        ahead, back = marginals(unary, valid, t, start)
        odds = ahead * back
        p = odds / (1 + odds)
        miss = y - p
        grad = np.zeros_like(theta)
        per_type = np.bincount(types, weights=miss[step, column], minlength=keys.shape[1])
        for row in slots:
            grad[:size] += np.bincount(row, weights=per_type, minlength=size)
        grad[size - 1] = 0
        grad[size] = per_type.sum()
        grad[size + 1] = miss[0].sum()
        r, q = ahead[:-1], unary[1:] * back[1:]
        each = both / (t[0, 0] + t[0, 1] * q + t[1, 0] * r + t[1, 1] * r * q)
        expected = [t[0, 0] * each.sum(), t[0, 1] * (q * each).sum(), t[1, 0] * (r * each).sum(), t[1, 1] * (r * q * each).sum()]
        grad[size + 2:] = seen.ravel() - expected
        grad = grad / max(1.0, gold.sum()) - 1e-4 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.98 * v + 0.02 * grad * grad
        theta += 0.3 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.98 ** k)) + 1e-8)
        theta[size - 1] = 0
    model = {"weights": theta[:size].astype(np.float32), "bias": float(theta[size]),
             "start": float(np.exp(theta[size + 1])), "transitions": np.exp(theta[size + 2:].reshape(2, 2))}
    top = np.full(len(sample), -25.0)
    for held in pieces(data, ends, _BREAKS):
        for row, logit, _, _ in _tagged(model, data, held):
            top[row] = max(top[row], logit)
    model["slope"], model["offset"] = _logistic(top, label)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic fit by Newton steps; each class weighs as it occurs."""
    a = np.stack([x / 10, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
        h = (a * (p * (1 - p))) @ a.T + np.diag([0.5, 0.01])
        w += np.linalg.solve(h, a @ (y - p) - np.array([0.5, 0.01]) * w)
    return float(w[0] / 10), float(w[1])


def _tagged(model: dict, data: np.ndarray, held: list[tuple[int, int, int]]) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """(row, highest log-odds, starts and ends of marked words) for each piece with words."""
    hashes, piece, place, start, end = _words(data, held)
    if not len(place):
        return
    score = np.full(len(place), model["bias"], np.float32)
    for row in _slots(hashes):
        score += model["weights"][row]
    step, column, n = _chains(piece, place)
    unary, valid = np.ones((CHAIN, n)), np.zeros((CHAIN, n), bool)
    unary[step, column] = _odds(score)
    valid[step, column] = True
    ahead, back = marginals(unary, valid, model["transitions"], model["start"])
    logit = np.log(np.clip((ahead * back)[step, column], 1e-11, 1e11))
    first = np.searchsorted(piece, np.arange(len(held) + 1))
    full = np.flatnonzero(np.diff(first))
    highest = np.maximum.reduceat(logit, first[:-1][full])
    marked = np.flatnonzero(logit >= np.log(MARK / (1 - MARK)))
    cut = np.searchsorted(marked, first)
    for i, top in zip(full.tolist(), highest.tolist()):
        row, a, _ = held[i]
        at = marked[cut[i]:cut[i + 1]]
        yield row, top, start[at] + a, end[at] + a


def score(
    docs: DataFrame, model: dict | None, text: str = "text",
    out: str = "toxic_score", spans: str = "toxic_spans",
) -> DataFrame:
    """Add a score from 0 to 1 and the marked words as byte ranges of the UTF-8 text.

    One pass over whole texts, no shuffle.  Null and empty texts and texts
    without words score as if their likeliest word were clean; without a model
    (no labelled rows of both kinds) every score is zero.  Input columns with the
    output's names are replaced.
    """
    schema = extended(docs.schema, T.StructField(out, T.DoubleType()), T.StructField(spans, SPANS))
    kept = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(batch.schema.get_field_index(text)))
            top, marks = np.full(batch.num_rows, -25.0), [[] for _ in range(batch.num_rows)]
            for held in pieces(data, ends, _BREAKS) if model else ():
                for row, logit, start, end in _tagged(model, data, held):
                    top[row] = max(top[row], logit)
                    base = int(ends[row])
                    marks[row] += [{"start": a - base, "end": b - base} for a, b in zip(start.tolist(), end.tolist())]
            value = 1 / (1 + np.exp(-(model["slope"] * top + model["offset"]))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(value), pa.array(marks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=schema.names)

    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled rows that are not held out (a bounded sample of them)."""
    return fitted(docs, labels, "toxic", SAMPLE, SAMPLE_CHARS, fit)


def accepted(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The documents below the threshold, columns as they were."""
    value, spans = unused(docs, "__toxic"), unused(docs, "__spans")
    return score(docs, model, text, value, spans).where(F.col(value) < THRESHOLD).drop(value, spans)
