"""Toxicity by compression distance with two zstandard dictionaries.

Two dictionaries are trained by zstandard: one on pieces of ordinary documents,
one on what sets toxic documents apart.  Toxic documents are mostly ordinary
text, and a trainer fed with all of it keeps common syllables; so its samples
are the words of toxic documents that hold a byte string (``GRAM`` bytes, or the
whole word) many times more frequent in toxic documents than in ordinary ones.
The toxic side compresses with both dictionaries, the ordinary side with the
first alone, so common text costs the same on either.

A document is cut into windows of several words, at three widths.  Every window
is compressed under both sides; the distance is the ordinary length less the
toxic one.  Thresholds on the distances are calibrated by a logistic model over
how many windows exceed each of them, each document
measured with dictionaries trained without it.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, id_remainder

#: Labelled documents of each class that training draws, in expectation.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 4500
#: Words of a window.
WIDTHS = (3, 6, 12)
#: Distances, in bytes, that the calibration counts windows beyond.
THRESHOLDS = (2, 3, 4, 5, 6)
#: Sizes of the dictionaries, and the trainer's segment and match lengths.
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 8 << 10
ORDINARY_SEGMENT, TOXIC_SEGMENT = dict(k=64, d=8), dict(k=24, d=6)
PIECE = 200
#: A string sets toxic text apart that is in this share of the toxic sample (three documents at least), and so many times more frequent there.
GRAM, LEAST_SHARE, LEAST_RATIO = 8, 0.01, 25
#: Parts of the sample; the calibration of a part uses dictionaries of the others.
FOLDS = 3
LEVEL = 12
#: Leads every window and ends both dictionaries, so that a block is always compressed and lengths move byte by byte.
LEAD = b"0123456789#ABCDEFGHIJ+_-"
#: Bytes that a window must share with the toxic dictionary to be compressed at all.
SHARED = 5


def words_of(text: str | None) -> list[bytes]:
    """White-space words, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _codes(raw: np.ndarray) -> np.ndarray:
    """A 20-bit hash of the ``SHARED`` bytes from each place on."""
    n = max(0, len(raw) - SHARED + 1)
    code = np.zeros(n, np.uint64)
    for j in range(SHARED):
        code = (code << np.uint64(8)) | raw[j : j + n]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class CompressionDistance:
    """Window distances under the two sides' dictionaries.

    A window that shares no ``SHARED`` bytes with the toxic dictionary cannot be
    shortened by it; its distance is 0 and it is not compressed.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.toxic, self.contents = toxic, (ordinary + LEAD, ordinary + toxic + LEAD)
        self._ready = None

    def __getstate__(self):
        return {"toxic": self.toxic, "contents": self.contents, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            made = []
            for content in self.contents:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            shared = np.zeros(1 << 20, bool)
            shared[_codes(np.frombuffer(self.toxic, np.uint8))] = True
            self._ready = (*made, shared)
        return self._ready

    def distances(self, words: list[bytes]) -> list[np.ndarray]:
        """By width, the distance of each window of so many words."""
        ordinary, toxic, shared = self._compressors()
        text = b" " + b" ".join(words) + b" "
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])  # the spaces around words
        hits = np.concatenate([[0], np.cumsum(shared[_codes(np.frombuffer(text, np.uint8))])])
        out = []
        for width in WIDTHS:
            start = edge[:-1][::width]
            end = np.append(start[1:], edge[-1]) + 1
            last = np.clip(end - SHARED + 1, start, len(hits) - 1)
            d = np.zeros(len(start), np.int64)
            for k in np.flatnonzero(hits[last] > hits[np.minimum(start, len(hits) - 1)]).tolist():
                window = LEAD + text[start[k] : end[k]]
                d[k] = len(ordinary(window)) - len(toxic(window))
            out.append(d)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """By width: windows beyond each threshold (log and share), greatest and mean distance, log of the number of windows."""
        words, out = words_of(text), []
        for d in self.distances(words) if words else [np.zeros(1, np.int64)] * len(WIDTHS):
            beyond = np.array([(d >= t).sum() for t in THRESHOLDS])
            out += [*np.log1p(beyond), *(10 * beyond / len(d)), max(d.max(), 0), d.mean(), np.log(len(d))]
        return np.array(out)


N_FEATURES = len(WIDTHS) * (2 * len(THRESHOLDS) + 3)


class ToxicityModel:
    """The dictionaries and a logistic calibration of the features."""

    def __init__(self, distance: CompressionDistance, mean, scale, weights, bias: float):
        self.distance, self.mean, self.scale, self.weights, self.bias = distance, mean, scale, weights, bias

    def score(self, text: str | None) -> float:
        z = float(((self.distance.features(text) - self.mean) / self.scale) @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def _document_counts(texts: list[list[bytes]], among: Counter | None = None) -> Counter:
    """Number of texts with each string; ``among``: of these strings only."""
    out: Counter = Counter()
    for words in texts:
        grams = set().union(*map(_grams, set(words))) if words else set()
        out.update(grams if among is None else grams.intersection(among))
    return out


def _trained(size: int, samples: list[bytes], segment: dict) -> bytes:
    """Content of a trained dictionary; with too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, **segment).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _distance(ordinary: list[list[bytes]], toxic: list[list[bytes]], plain: Counter, bad: Counter) -> CompressionDistance:
    """Both dictionaries, from texts and the number of texts with each string."""
    least = max(3, LEAST_SHARE * len(toxic))
    found = {g for g, c in bad.items() if c >= least and c * len(ordinary) >= LEAST_RATIO * (plain[g] + 1) * len(toxic)}
    kept = ([w for w in words if not found.isdisjoint(_grams(w))] for words in toxic)
    texts = [b" ".join(words) for words in ordinary]
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    apart = [b" " + b" ".join(k) + b" " for k in kept if k]
    return CompressionDistance(_trained(ORDINARY_BYTES, pieces, ORDINARY_SEGMENT), _trained(TOXIC_BYTES, apart, TOXIC_SEGMENT))


def fit(rows: list[tuple[int, str, int]]) -> ToxicityModel:
    """Dictionaries from all rows (id, text, toxic); the calibration sees each text under dictionaries trained without it.

    Texts are dealt to ``FOLDS`` parts by their hash, so copies share a part and
    train once.  In the calibration a class weighs as the square root of its
    rows, between equal classes and the sample's shares.
    """
    texts = sorted({(r[1] or "", int(r[2])) for r in rows})
    fold = [zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for t, _ in texts]
    part = {(k, f): [words_of(t) for (t, y), g in zip(texts, fold) if (y, g) == (k, f)] for k in (0, 1) for f in range(FOLDS)}
    bad = [_document_counts(part[1, f]) for f in range(FOLDS)]
    often = Counter({g: c for g, c in sum(bad, Counter()).items() if c >= 3})
    bad = [Counter({g: c for g, c in x.items() if g in often}) for x in bad]
    plain = [_document_counts(part[0, f], often) for f in range(FOLDS)]

    def trained_on(folds: list[int]) -> CompressionDistance:
        joined = ([w for f in folds for w in part[k, f]] for k in (0, 1))
        return _distance(*joined, sum((plain[f] for f in folds), Counter()), sum((bad[f] for f in folds), Counter()))

    x, y = np.zeros((len(texts), N_FEATURES)), np.array([t[1] for t in texts], float)
    for f in range(FOLDS) if len(texts) else ():
        distance = trained_on([g for g in range(FOLDS) if g != f])
        for k in (k for k, g in enumerate(fold) if g == f):
            x[k] = distance.features(texts[k][0])
    per = {k: 30 / max(1.0, (y == k).sum()) ** 0.5 for k in (0, 1)}
    w = np.where(y == 1, per[1], per[0])
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    beta, rate = np.zeros(N_FEATURES + 1), (w @ y) / max(w.sum(), 1e-9)
    beta[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    full = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    ridge = np.diag([1.0] * N_FEATURES + [1e-3])
    for _ in range(25 if 0 < rate < 1 else 0):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (w * (p - y)) + ridge @ beta
        hessian = (full * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return ToxicityModel(trained_on(list(range(FOLDS))), mean, scale, beta[:-1], float(beta[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a hash-chosen sample of the rows given; its size is bounded, not its texts' length."""
    spark_labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    spark_labels = spark_labels.where("id is not null and toxic in (0, 1)")
    counts = dict(spark_labels.groupBy("toxic").count().collect())
    share = {k: min(1.0, n / max(counts.get(k, 0), 1)) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))}
    u = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = spark_labels.where(u < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if fits_broadcast(drawn, 2 * (SAMPLE_TOXIC + SAMPLE_ORDINARY)):
        drawn = F.broadcast(drawn)
    rows = [tuple(r) for r in texts.join(drawn, "id").select("id", "text", "toxic").toLocalIterator()]
    return fit(rows)


def _scorer(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            scores = np.array([model.score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"]
            )

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """``id_col, held_out, score, predicted`` per row, over all windows of the text.

    Null and empty texts have no window and get the calibration's score for
    that; a text without spaces is one window; equal texts get equal scores,
    so repeated rows and ties do; a null id passes through; other columns are
    ignored, whatever their names.
    """
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(model), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from labels whose id remainder modulo 5 is not 0, score every document."""
    held = id_remainder(id_col, 5) == 0
    model = train(docs, labels.where(~F.coalesce(held, F.lit(True))), id_col, text_col, label_col)
    return score_toxicity(docs, model, id_col, text_col, held)
