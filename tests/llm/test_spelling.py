"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartloom.llm import queries, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(rows):
    n = counts(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("node_words", [4096, 2])
def test_dense_words(spark, monkeypatch, node_words):
    """Words of few letters, so that most have near words, in all places of a word; also with every node spread."""
    monkeypatch.setattr(spelling, "NODE_WORDS", node_words)
    rng = random.Random(7)
    rows = []
    for d in range(300):
        some = ["".join(rng.choices("abÀ", k=rng.randrange(4, 9))) for _ in range(25)]
        rows.append((d, "".join(w + rng.choice([" ", "\n", "1", "-"]) * rng.randrange(1, 3) for w in some)))
    want = brute(rows)
    assert sum(1 for x in want if x[1]) > 50 and any(x[2] != (x[1] or x[0]) for x in want)
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_odd_rows(spark):
    long_word = "".join(random.Random(3).choices("abcdefg", k=4000))
    rows = [
        (1, None), (2, ""), (None, "receive recieve receive"), (None, "receive recieve receive"), (None, "recieve"),
        (3, "Receive RECEIVE receives receives receives receive receve receve receve " * 3), (3, "ÉTUDE étude étude étude étude 漢字étude"),
        (4, "abcd abcd abcd abcd"), (5, "abcde abcde abcdé"), (6, "colour color colour color colour color colour colour"),
        *((10 + i, f"{long_word} {long_word}x {long_word[:2000]}q{long_word[2000:]}") for i in range(3)),
        (20, "filler " * 200_000),
    ]
    clash = [(d, t, 1, "x", 2) for d, t in rows]
    docs = spark.createDataFrame(clash, "doc_id long, text string, n int, word string, node int").repartition(4)
    found = got(spelling.spelling_variants(docs))
    assert found == brute(rows)
    by_word = {x[0]: x for x in found}
    assert by_word[long_word][4] == 2 and by_word["filler"][3] >= 190_000
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains(spark):
    """Forms of forms: each word doubles the count of the one before."""
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    rows = [(d, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))) for d in range(2)]
    found = got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows)
    # six forms on, or five where the last word lost letters
    assert next(x[2] for x in found if x[0] == "aaaaa") in chain[-2:]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()
    assert got(queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs])
