"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows (one-hot
bytes, so a filter is a table of byte weights), their maxima over the window are
the features of a softmax.  A document's score is the mean log-probability of
all windows of its whole text, weighted by their bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, id_remainder, text_blocks

WINDOW = 192
WIDTHS, FILTERS = (2, 3, 4), 12
#: Labelled documents per language that are drawn for training (in expectation), and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 600, 4
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def window_matrix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of all texts, the text of each window, and its bytes."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[doc] + k * WINDOW
    used = np.minimum(offsets[doc + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), doc, used


class ByteCnn:
    """Multi-width byte filters, max pooling, softmax; trained with Adagrad."""

    def __init__(self, n_classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_classes)).astype(np.float32)
        self.out_bias = np.zeros(n_classes, np.float32)

    def responses(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        size = x.shape[1] - len(table) + 1
        total = table[0][x[:, :size]]
        for j in range(1, len(table)):
            total += table[j][x[:, j : j + size]]
        return total

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, where = [], []
        for table in self.filters:
            r = self.responses(x, table)
            at = r.argmax(axis=1)
            where.append(at)
            tops.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
        return np.concatenate(tops, axis=1) + self.bias, where

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        top = np.concatenate([self.responses(x, t).max(axis=1) for t in self.filters], axis=1) + self.bias
        z = np.maximum(top, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.1, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.out, self.out_bias]
        squares = [np.full_like(p, 1e-2) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                xb = x[rows]
                top, where = self.pooled(xb)
                hidden = np.maximum(top, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (top > 0)
                grads = []
                for i, table in enumerate(self.filters):
                    g, d = np.zeros_like(table), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(len(table)):
                        seen = np.take_along_axis(xb, where[i] + j, 1)
                        np.add.at(g[j], (seen, np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                for param, square, g in zip(params, squares, grads):
                    square += g * g
                    param -= rate * g / np.sqrt(square)


def _sampler(batches):
    for batch in batches:
        for sub, a, b, data, offsets in text_blocks([batch]):
            x, doc, used = window_matrix(data, offsets)
            keep = []
            for d in range(b - a):
                mine = np.flatnonzero(doc == d)
                if len(mine):
                    keep.extend(mine[np.unique(np.linspace(0, len(mine) - 1, SAMPLE_WINDOWS).astype(int))])
            keep = np.array(keep, np.int64)
            yield pa.RecordBatch.from_arrays(
                [sub.column(0).slice(a, b - a).take(pa.array(doc[keep])), sub.column(1).slice(a, b - a).take(pa.array(doc[keep])), pa.array([x[k].tobytes() for k in keep], pa.binary()), pa.array(used[keep].astype(np.int32))],
                ["id", "lang", "window", "used"],
            )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[ByteCnn, list[str]]:
    """A network and its languages, from a hash-chosen sample of the labelled rows given.

    The driver receives at most about ``SAMPLE_DOCS * SAMPLE_WINDOWS`` windows of
    ``WINDOW`` bytes for each language, drawn over whole texts.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    docs = docs.where("lang is not null and text is not null and text <> ''")
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return ByteCnn(1), [UNDETERMINED]
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, SAMPLE_DOCS / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")]
    rows = docs.where(drawn).mapInArrow(_sampler, "id long, lang string, window binary, used int").toPandas()
    rows = rows.sort_values(["lang", "id", "window"], kind="stable")
    names = sorted(counts)
    x = np.frombuffer(b"".join(bytes(w) for w in rows["window"]), np.uint8).reshape(-1, WINDOW).copy()
    y = rows["lang"].map({n: k for k, n in enumerate(names)}).to_numpy()
    # a third of the windows is shortened, so short texts are known too
    rng = np.random.default_rng(1)
    for k in np.flatnonzero(rng.random(len(x)) < 1 / 3):
        x[k, rng.integers(8, WINDOW) :] = 0
    net = ByteCnn(len(names))
    if len(x):
        net.fit(x, y)
    return net, names


def _predictor(net: ByteCnn, names: list[str]):
    def run(batches):
        for batch, a, b, data, offsets in text_blocks(batches, size=BLOCK_BYTES // 4):
            total, weight = np.zeros((b - a, len(names))), np.zeros(b - a)
            x, doc, used = window_matrix(data, offsets)
            for k in range(0, len(x), 256):
                part = slice(k, k + 256)
                np.add.at(total, doc[part], net.log_probabilities(x[part]) * used[part, None])
                np.add.at(weight, doc[part], used[part])
            mean = total / np.maximum(weight, 1)[:, None]
            prob = np.exp(mean - mean.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            best = prob.argmax(axis=1)
            raw = data.tobytes()
            letters = [_LETTER.search(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")) is not None for k in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([names[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]),
                    pa.array(np.where(letters, prob[np.arange(b - a), best], 0.0)),
                ],
                ["id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, net: ByteCnn, names: list[str], id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` per row.

    A null text or one without a letter is ``und`` with score 0; texts shorter
    than a window are padded; all windows of a long text count; repeated rows get
    equal results; a null id passes through.
    """
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictor(net, names), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on rows whose id remainder modulo 4 is not 2, predict every row."""
    held = id_remainder(id_col, 4) == 2
    net, names = train(docs.where(~F.coalesce(held, F.lit(True))), id_col, text_col, lang_col)
    return identify(docs, net, names, id_col, text_col, held)
