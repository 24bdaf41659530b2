"""Language of spans by script ranges and a Viterbi pass over words.

Training counts hashed character trigrams per language over all labelled texts. A word's
score for a language is the log probability of its trigrams. The script of a word
narrows its candidates to the languages that use the script. Viterbi then labels the
words of a text so that the sum of scores, less a penalty for each switch, is greatest:
a foreign word inside a sentence does not switch, a foreign sentence does.

Words are runs of letters. A pass handles many texts in lockstep with numpy; its memory
is that of a few megabytes of text, or of one text if that is longer.

Definitions: the language of a text is the one with most letters, ties by name; its
score is that share of the letters. Missing texts and texts without a letter are ``und``
with score 0 and no spans, and so are all texts if nothing was learned. Rows are judged
one by one, so repeated rows agree. Missing labels are not learned from. An empty table
gives an empty result. Only ``doc_id``, ``text`` and ``lang`` are read (``lang`` in
training only), so further columns of any name do no harm. The model holds
``BUCKETS`` numbers per language.
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

from cartloom.llm.common import parts, texts_of, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
#: A language uses a script if so large a part of its training words does.
SCRIPT_SHARE = 0.001
#: First code points of the ranges and their scripts; fixed values of the Unicode blocks.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
SPANS = "array<struct<start:int,end:int,lang:string>>"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log probabilities, one row per language
    scores: np.ndarray
    #: scripts (rows) that languages (columns) use
    uses: np.ndarray


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the first 65,536 code points: lower-case form, and whether it is a letter."""
    state = worker_state()
    if not hasattr(state, "letters"):
        low = np.arange(1 << 16, dtype=np.uint32)
        letter = np.zeros(1 << 16, bool)
        for c in range(1 << 16):
            letter[c] = chr(c).isalpha()
            lower = chr(c).lower()
            if len(lower) == 1:
                low[c] = ord(lower)
        state.letters = low, letter
    return state.letters


@dataclass
class Words:
    """The words of several texts: places, trigram buckets and owners."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    scripts: np.ndarray
    buckets: np.ndarray
    bucket_starts: np.ndarray


def words_in(texts: list[str]) -> Words:
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low, is_letter = _tables()
    small = points < 1 << 16
    clipped = np.where(small, points, 0)
    lower = np.where(small, low[clipped], points)
    letter = is_letter[clipped] & small
    large = np.flatnonzero(~small)
    if len(large):
        letter[large] = [chr(c).isalpha() for c in points[large].tolist()]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], letter.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    lower = np.where(letter, lower, 0).astype(np.uint32)
    before = np.concatenate(([0], lower[:-1])).astype(np.uint32)
    two_before = np.where(before > 0, np.concatenate(([0, 0], lower[:-2])), 0).astype(np.uint32)
    # each letter with the two before it, and the end of each word
    at = np.flatnonzero((lower > 0) | (before > 0))
    key = lower[at] * np.uint32(0x9E3779B1) + before[at] * np.uint32(0x85EBCA77) + two_before[at] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x27D4EB2F)
    buckets = (key >> np.uint32(17)).astype(np.int32)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    begins = np.array([c for c, _ in SCRIPT_RANGES])
    names = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])
    scripts = names[np.searchsorted(begins, points[starts], "right") - 1] if len(starts) else np.empty(0, int)
    return Words(starts, ends, owner, scripts, buckets, np.searchsorted(at, starts))


def train(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows with a ``lang`` and a ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in parts(batch, "text", 2 << 20):
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in dict.fromkeys(langs):
                    texts = texts_of(part.filter(pa.array(langs == lang)))
                    words = words_in(texts)
                    total = grams.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    total[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(words.scripts, minlength=len(SCRIPTS))
        for lang, total in grams.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most BUCKETS rows per language
    found = counted.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    place = {lang: k for k, lang in enumerate(langs)}
    total = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    total[[place[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    smooth = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    shares = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(langs, smooth.astype(np.float32), (shares >= SCRIPT_SHARE).T)


def word_scores(words: Words, model: LanguageModel) -> np.ndarray:
    """One row per word, one column per language; languages without the script are ruled out."""
    columns = [np.add.reduceat(row[words.buckets], words.bucket_starts) for row in model.scores]
    scores = np.stack(columns, axis=1)
    uses = model.uses[words.scripts]
    # a script that no language uses tells nothing
    none = ~uses.any(axis=1)
    scores[~uses] = -1e6
    scores[none] = 0.0
    return scores


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; texts start at ``first`` and have ``counts`` words."""
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    n_texts = len(counts)
    live = np.searchsorted(-counts, -np.arange(1, int(counts[0]) + 1), "right") if n_texts else np.empty(0, int)
    n_langs = scores.shape[1]
    value = np.zeros((n_texts, n_langs))
    came = np.empty(scores.shape, np.int16)
    own = np.arange(n_langs, dtype=np.int16)
    for t, n in enumerate(live.tolist()):
        at = first[:n] + t
        v = value[:n]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(n), best] - penalty
            switch = v < top[:, None]
            came[at] = np.where(switch, best[:, None], own)
            v = np.where(switch, top[:, None], v)
        value[:n] = v + scores[at]
    label = np.empty(len(scores), np.int16)
    state = value.argmax(axis=1) if n_texts else np.empty(0, int)
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        at = first[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return label


def _labelled(part: pa.RecordBatch, model: LanguageModel, penalty: float) -> pa.RecordBatch:
    texts = texts_of(part)
    n = len(texts)
    langs, share = ["und"] * n, np.zeros(n)
    spans: list[list] = [[] for _ in texts]
    # trigrams of a few megabytes at a time; the words of all texts go through Viterbi together
    pieces, scored, at, before = [], [], 0, 0
    while at < n:
        size, to = 0, at
        while to < n and (to == at or size + len(texts[to]) <= 2 << 20):
            size += len(texts[to])
            to += 1
        words = words_in(texts[at:to])
        if len(words.starts) and model.languages:
            begin = np.cumsum([0] + [len(t) + 1 for t in texts[at:to]])[:-1]
            scored.append(word_scores(words, model))
            pieces.append((words.owner + at, words.starts - begin[words.owner], words.ends - begin[words.owner]))
        at = to
    if pieces:
        owner, starts, ends = (np.concatenate(x) for x in zip(*pieces, strict=True))
        have, first, counts = np.unique(owner, return_index=True, return_counts=True)
        label = viterbi(np.concatenate(scored), first, counts, penalty)
        letters = np.zeros((n, len(model.languages)), np.int64)
        np.add.at(letters, (owner, label), ends - starts)
        top = letters.argmax(axis=1)
        for k in have.tolist():
            langs[k] = model.languages[top[k]]
        share[have] = letters[have, top[have]] / letters[have].sum(axis=1)
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (label[1:] != label[:-1]))))
        close = np.concatenate((new[1:], [len(owner)])) - 1
        for a, b in zip(new.tolist(), close.tolist(), strict=True):
            spans[owner[a]].append({"start": int(starts[a]), "end": int(ends[b]), "lang": model.languages[label[a]]})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    return pa.record_batch(
        [part.column("doc_id"), pa.array(langs), pa.array(share), pa.array(spans, kind)],
        ["doc_id", "lang_pred", "score", "spans"],
    )


def label_languages(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and the labelled spans (code points) of each text."""
    # by value: workers need not have the class
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(shared.value)
        for batch in batches:
            for part in parts(batch, "text", 12 << 20):
                yield _labelled(part, known, penalty)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {SPANS}")
