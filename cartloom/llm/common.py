"""What the operators of this folder share: words, batches, tokenizers on workers, small helpers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.plans.pinning import pin_table as pin_table


# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space between words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    pieces = F.split(text, SPACE)
    blank_ends = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(
        text.rlike(r"[\x20\x09-\x0D]\z"), 1
    ).otherwise(0)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(pieces) - blank_ends).otherwise(0).cast("long")


def doc_hash(name: str = "doc_id") -> Column:
    """crc32 of the id as text; the rule of held-out rows is its remainder by 4."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def held_out(name: str = "doc_id") -> Column:
    return doc_hash(name) % 4 == 2


def worker_state() -> types.ModuleType:
    """A place in the worker process that outlives a task; functions shipped by value have none."""
    return sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state"))


def parts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0)
    before = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(column).fill_null("").to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random numbers, the same on every machine."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def binary_rows(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """``raw`` cut into binary values of so many items each, without copying."""
    ends = np.concatenate(([0], np.cumsum(lengths) * raw.itemsize))
    kind, offsets = (pa.large_binary(), np.int64) if ends[-1] >= 1 << 31 else (pa.binary(), np.int32)
    buffers = [None, pa.py_buffer(ends.astype(offsets)), pa.py_buffer(np.ascontiguousarray(raw))]
    return pa.Array.from_buffers(kind, len(lengths), buffers).cast(pa.binary())


LETTER, DIGIT, SIGN, QUOTE, BLANK, LINE = 1, 2, 3, 4, 5, 6


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = SIGN
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    kinds[48:58] = DIGIT
    kinds[ord("'")] = QUOTE
    kinds[ord(" ")] = BLANK
    kinds[ord("\n")] = LINE
    return kinds


def _cut_rules() -> np.ndarray:
    """Whether a text may be cut between two bytes, by ``8 * kind + kind`` of the two."""
    rules = np.zeros(64, bool)
    for a in (LETTER, DIGIT, SIGN, QUOTE):
        for b in (LETTER, DIGIT, SIGN, QUOTE, BLANK, LINE):
            # signs join, and a contraction begins with its quote
            rules[8 * a + b] = a != b and a != QUOTE and not (a == SIGN and b == QUOTE) or b in (BLANK, LINE)
    return rules


KINDS, CUTS = _byte_kinds(), _cut_rules()


def word_starts(data: np.ndarray, fixed: list[bytes]) -> np.ndarray:
    """Marks of the bytes of UTF-8 ``data`` before which a text may be cut without changing its tokens.

    Tokens of the tokenizers used here are made inside runs of letters, of digits or of
    signs, with one space before a run at most. So a cut is safe where two such runs meet,
    where a run ends at white space, before a space that a run follows, and after a single
    line end between runs. Bytes of other scripts, and ``fixed`` strings, are never cut.
    """
    n = len(data)
    kind = KINDS[data]
    # letters of two bytes that begin with 0xC3, but for the two signs among them
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    mark = np.zeros(n, bool)
    mark[1:] = CUTS[kind[:-1] * np.uint8(8) + kind[1:]]
    run = (kind >= LETTER) & (kind <= QUOTE)
    # the last of several blanks belongs to the run behind it
    mark[:-1] |= (kind[:-1] == BLANK) & run[1:]
    line = np.flatnonzero(kind[1:-1] == LINE) + 1
    mark[line[run[line - 1] & run[line + 1]] + 1] = True
    if fixed:
        raw = data.tobytes()
        for text in fixed:
            at = raw.find(text)
            while at >= 0:
                mark[at + 1 : at + len(text)] = False
                at = raw.find(text, at + 1)
    return mark


#: So many words go to a tokenizer in one call; what it gives back is far larger than their ids.
WORDS_PER_CALL = 20_000


class TextEncoder:
    """Whole texts to token ids with a public tokenizer, each distinct word of a batch encoded once.

    Texts are cut at places where no token reaches over (``word_starts``), the words are
    dictionary-encoded by Arrow, new ones go to the tokenizer in one call, and the ids of all
    are gathered with numpy. Up to ``keep`` words are remembered between batches, as one Arrow array
    rather than as Python strings, which took several hundred MB a worker; a word of over
    ``LONGEST`` characters never is, so memory is bounded whatever the texts hold.
    """

    LONGEST = 64

    def __init__(self, path: str, end_id: int | None, keep: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.fixed = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        # word number 0 is the end of a text
        self.ids = np.array([] if end_id is None else [end_id], self.dtype)
        self.lengths = np.array([len(self.ids)], np.int64)
        # word number k + 1 is the k-th remembered word
        self.known = pa.array([], pa.large_string())

    @staticmethod
    def on_worker(path: str, end_id: int | None) -> TextEncoder:
        state = worker_state()
        made = state.__dict__.setdefault("encoders", {})
        if (path, end_id) not in made:
            made[path, end_id] = TextEncoder(path, end_id)
        return made[path, end_id]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after another, and how many each has."""
        ids, counts = [], []
        for at in range(0, len(words), WORDS_PER_CALL):
            some = words.slice(at, WORDS_PER_CALL).to_pylist()
            done = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(done.ids, self.dtype))
            counts.append(np.bincount(np.array(done.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word, and the ids and lengths that numbers refer to."""
        found = pa.compute.index_in(words, value_set=self.known)
        number = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        new = np.flatnonzero(number == 0)
        if not len(new):
            return number, self.ids, self.lengths
        length = pa.compute.utf8_length(words.take(pa.array(new))).to_numpy(zero_copy_only=False)
        shortest = np.argsort(length, kind="stable")
        new = new[shortest]
        fresh = words.take(pa.array(new))
        ids, counts = self._encode_words(fresh)
        number[new] = len(self.lengths) + np.arange(len(new))
        all_ids, all_lengths = np.concatenate((self.ids, ids)), np.concatenate((self.lengths, counts))
        short = min(int((length <= self.LONGEST).sum()), self.keep - len(self.known))
        if short > 0:
            self.known = pa.concat_arrays([self.known, fresh.slice(0, short)])
            self.ids, self.lengths = np.concatenate((self.ids, ids[: int(counts[:short].sum())])), all_lengths[: len(self.lengths) + short]
        return number, all_ids, all_lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id after each, and how many each text has. A missing text is empty."""
        n = len(texts)
        if not n:
            return np.array([], self.dtype), np.array([], np.int64)
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw or b"", np.uint8)[offsets[0] : offsets[-1]]
        begins = offsets - offsets[0]
        size = len(data)
        mark = word_starts(data, self.fixed) if size > 1 else np.ones(size, bool)
        mark[begins[:-1][begins[:-1] < size]] = True
        at = np.append(np.flatnonzero(mark), size)
        words = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        number, ids, lengths = self._numbers(coded.dictionary)
        # the end of each text is word 0 behind its last word
        ends = np.searchsorted(at[:-1], begins[1:])
        order = np.insert(number[coded.indices.to_numpy()], ends, 0)
        count = lengths[order]
        from_id = (np.cumsum(lengths) - lengths)[order]
        before = np.cumsum(count) - count
        out = ids[np.repeat(from_id - before, count) + np.arange(int(count.sum()))]
        last = ends + np.arange(n)
        through = before[last] + count[last]
        return out, np.diff(through, prepend=0)
