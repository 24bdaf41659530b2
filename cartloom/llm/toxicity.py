"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Each
window of a few words is compressed with both; what it saves with the toxic one is its
distance. A window that holds what only toxic texts hold is shorter with their
dictionary. Most of a toxic text is ordinary, so each dictionary is trained on what is
particular to its class: runs of characters that come in a far larger share of its texts
than of the other's. Common text then compresses alike with both, and the lengths differ
by the particular runs and little else.

A text's measurements are its greatest distances and how many windows pass certain
distances. A logistic curve over these, fitted on texts that the dictionaries have not
seen, turns them into a score between 0 and 1.

Training uses at most about ``SAMPLE_DOCS`` labelled texts of each class, chosen by hash.
A text counts in the fit as many times as it stands for, so scores follow the shares of
all labels, not those of the sample.
Scoring reads whole texts.

Definitions: a missing or empty text has no window; its measurements are zero and its
score is what the curve gives for that. Repeated rows agree. Missing labels are not
learned from; if a class has too few texts to train on, the score of every text is the
share of toxic labels. An empty table gives an empty result. Only ``doc_id``, ``text``
and, in training, the label are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import parts, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_DOCS = 3000
DICTIONARY_BYTES = 16384
#: Stands before every window and at the end of both dictionaries: a block that does not
#: shrink is stored as it is, and a short window would hide its one match.
CARRIER = bytes(range(128, 192))
#: A run of so many bytes is particular to a class if so many of its texts hold it, at so
#: many times the other's rate.
GRAM, MIN_TEXTS, MIN_RATIO = 5, 5, 30.0
WINDOW_WORDS = 5
LEVEL = 3
STEPS = (2, 3, 5, 7)
N_FEATURES = 4 + len(STEPS)


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def normal(text: bytes) -> bytes:
    """A-Z in lower case, one space before each word."""
    return b" " + b" ".join(text.lower().split())


def windows_of(text: bytes) -> list[bytes]:
    """Runs of a few words, each starting where the one before ends."""
    words = text.lower().split()
    return [CARRIER + b" " + b" ".join(words[k : k + WINDOW_WORDS]) for k in range(0, len(words), WINDOW_WORDS)]


def compressor(dictionary: bytes):  # noqa: ANN201
    """Prepared once per worker process and dictionary."""
    import zstandard

    made = worker_state().__dict__.setdefault("compressors", {})
    if dictionary not in made:
        if len(made) > 8:
            made.clear()
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        made[dictionary] = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
    return made[dictionary]


def distances(windows: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """What each window saves with the toxic dictionary, in bytes."""
    t, o = compressor(toxic).compress, compressor(ordinary).compress
    return np.array([len(o(w)) - len(t(w)) for w in windows], np.float64)


def features(d: np.ndarray) -> list[float]:
    if not len(d):
        return [0.0] * N_FEATURES
    top = np.sort(d)[::-1][:3]
    top = np.concatenate([top, np.full(3 - len(top), min(top[-1], 0.0))])
    rates = [float(np.log1p((d >= step).sum())) for step in STEPS]
    return [*top.tolist(), float(np.log1p(len(d))), *rates]


def _chance(n: int) -> float:
    """The share of a class of ``n`` labels that is sampled."""
    return min(1.0, SAMPLE_DOCS / n)


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[bytes, int, int]], dict[int, int]]:
    """``(text, label, half)`` of at most about ``SAMPLE_DOCS`` texts of each class; equal texts count once.

    Also the number of labels of each class.

    The sample is drawn from the labels, so only the chosen texts are fetched.
    """
    import xxhash

    rows = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("label").cast("int").alias("label"))
    rows = rows.filter("l_id is not null and label in (0, 1)").distinct()
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.lit(0.0)
    for value, n in counts.items():
        chance = F.when(F.col("label") == value, F.lit(_chance(n))).otherwise(chance)
    place = F.shiftrightunsigned(F.xxhash64("l_id"), 11).cast("double") / float(1 << 53)
    # some 2 * SAMPLE_DOCS ids, whatever the tables hold
    chosen = F.broadcast(rows.filter(place < chance))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.filter("text is not null").join(chosen, F.col("doc_id") == F.col("l_id")).select("text", "label").collect()
    once = {(xxhash.xxh64_intdigest(t), t, r.label) for r in found for t in [r.text.encode("utf-8", "replace")]}
    return [(t, label, place >> 1 & 1) for place, t, label in sorted(once)], counts


def _trained(samples: list[bytes], size: int) -> bytes:
    import zstandard

    if not samples:
        return b"\0" * 8
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        # too little to train on: the samples themselves are the dictionary
        return b" ".join(samples)[-size:]


def _grams(text: bytes) -> np.ndarray:
    """The runs of ``GRAM`` bytes at each place of a text, as numbers; 0 for runs over the start of a word."""
    data = np.frombuffer(normal(text), np.uint8).astype(np.uint64)
    n = max(len(data) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | data[k : k + n]
    for k in range(1, GRAM):
        out[data[k : k + n] == 32] = 0
    return out


def _particular(texts: list[bytes], others: list[bytes]) -> list[bytes]:
    """The runs of each text made of grams that come in far more of ``texts`` than of ``others``."""
    held = [_grams(t) for t in texts]
    here, n_here = np.unique(np.concatenate([np.unique(g) for g in held]), return_counts=True)
    there, n_there = np.unique(np.concatenate([np.unique(_grams(t)) for t in others]), return_counts=True)
    place = np.minimum(np.searchsorted(there, here), len(there) - 1)
    also = np.where(there[place] == here, n_there[place], 0)
    ratio = (len(texts) + 1) / (len(others) + 1)
    chosen = here[(here > 0) & (n_here >= MIN_TEXTS) & (n_here + 0.5 >= MIN_RATIO * ratio * (also + 0.5))]
    out = []
    for text, grams in zip(texts, held, strict=True):
        data = normal(text)
        keep = np.zeros(len(data) + 1, bool)
        for k in np.flatnonzero(np.isin(grams, chosen)).tolist():
            keep[k : k + GRAM] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8)))))
        out.append(b"".join(data[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return [x for x in out if x]


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: means, scales, weights (the last is the constant).

    ``times``: how many rows each row stands for; only the proportions count.
    """
    times = times / times.mean()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (times * (p - y)) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from ``labels`` (``doc_id``, ``label`` 0 or 1) and the texts they name in ``docs``."""
    rows, counts = _sampled(docs, labels)
    toxic_share = counts.get(1, 0) / max(sum(counts.values()), 1)
    second = [(t, l) for t, l, h in rows if h == 1]
    texts = {value: [t for t, l, h in rows if (l, h) == (value, 0)] for value in (0, 1)}  # noqa: E741
    if min(map(len, texts.values())) < MIN_TEXTS or len({l for _, l in second}) < 2:  # noqa: E741
        zero = np.zeros(N_FEATURES)
        return ToxicityModel(b"", b"", zero, zero + 1, np.zeros(N_FEATURES + 1), toxic_share)
    toxic = _trained(_particular(texts[1], texts[0]), DICTIONARY_BYTES) + CARRIER
    ordinary = _trained(_particular(texts[0], texts[1]), DICTIONARY_BYTES) + CARRIER
    x = np.array([features(distances(windows_of(t), toxic, ordinary)) for t, _ in second])
    y = np.array([l for _, l in second], float)  # noqa: E741
    times = np.array([1 / _chance(counts[l]) for _, l in second])  # noqa: E741
    return ToxicityModel(toxic, ordinary, *fit(x, y, times), toxic_share)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score`` and ``worst`` (the greatest distance) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for batch in batches:
            for part in parts(batch, "text", 4 << 20):
                texts = [b if b is not None else b"" for b in part.column("text").cast(pa.binary()).to_pylist()]
                if m.toxic:
                    x = np.array([features(distances(windows_of(t), m.toxic, m.ordinary)) for t in texts])
                    z = np.column_stack([(x - m.mean) / m.scale, np.ones(len(x))]) @ m.weights
                    score, worst = 1 / (1 + np.exp(-np.clip(z, -30, 30))), x[:, 0]
                else:
                    score, worst = np.full(len(texts), m.prior), np.zeros(len(texts))
                yield pa.record_batch([part.column("doc_id"), pa.array(score), pa.array(worst)], ["doc_id", "score", "worst"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, score double, worst double")
