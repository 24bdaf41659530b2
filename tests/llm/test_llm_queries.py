"""Registered queries of the folder against their SQL, and the pipeline."""

import random
import re
from collections import Counter

import duckdb
import oracle_check
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cartloom.llm import mixing, queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = oracle_check.connect(SF)
    assert oracle_check.differences(queries.QUERIES[name](spark, SF), con, sql.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op2_language_spans", "op5_source_mix", "op7_secret_spans", "op8_toxicity_scores", "op9_near_duplicates"])
def test_one_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(200))


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.minhash.pin_table(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after, name
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == before
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def small_corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, base = [], [text(rng.randrange(40, 160)) for _ in range(14)]
    for k, t in enumerate(base):
        words = t.split()
        rows += [(10 * k, t), (10 * k + 1, t.replace(" ", "\n", 3)), (10 * k + 2, t.upper())]
        # near copies of several degrees, in chains
        for j in range(3, 3 + k % 4):
            words[rng.randrange(len(words))] = "changed"
            rows.append((10 * k + j, " ".join(words)))
    rows += [
        (500, None), (501, ""), (502, "too short"), (503, "spam " * 60), (504, "### $$$ %%% " * 20), (505, "12 34 56 " * 10),
        (None, text(50)), (None, text(60)), (506, base[0]), (506, base[0]), (507, "\n".join(["one line of words that comes again"] * 8)),
    ]
    sources = ["web", "books", None, "code"]
    return [(d, t, "en", sources[k % 4], None if t is None else len(t)) for k, (d, t) in enumerate(rows)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_pipeline_equals_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    corpus = small_corpus()
    spark.createDataFrame(corpus, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name in ("rules", "exact", "near", "mix"):
        docs = queries.minhash.pin_table(stage[name](spark, docs, str(tmp_path)))
        seen[name] = Counter(tuple(r) for r in docs.collect())
    # rules: the ledger by SQL; rows that share an id are told apart by giving each its own
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, r[1]) for k, r in enumerate(corpus)])
    kept = {d for d, k in con.execute(f"SELECT doc_id, kept FROM ({sql.LEDGER})").fetchall() if k}
    left = [r for k, r in enumerate(corpus) if k in kept]
    assert Counter(left) == seen["rules"] and 5 < len(corpus) - len(left) < 20
    # exact copies: the least id of each text, missing ids last, one row of it
    groups = {}
    for r in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), []).append(r)
    first = {t: min(g, key=lambda r: (r[0] is None, r[0] or 0)) for t, g in groups.items()}
    left = [r for r in left if first[re.sub(r"[\x20\x09-\x0D]+", " ", r[1])][:2] == r[:2]]
    ids = {r[:2] for r in left}
    assert {k[:2] for k in seen["exact"]} == ids and sum(seen["exact"].values()) == len(ids)
    # near copies: all pairs, least reachable id
    rows = list(seen["exact"])
    sets = [shingle_set(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = Counter(r for k, r in enumerate(rows) if r[0] is None or least[find(k)] == r[0])
    assert want == seen["near"] and len(want) < len(rows)
    # mix: the words of each source are its target, of documents it has, none over three times
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in seen["near"]:
        sizes[r[3]] += n_words(r[1])
    for r, n in seen["mix"].items():
        taken[r[3]] += n * n_words(r[1])
        assert any(o[0] == r[0] and o[3] == r[3] and " ".join(r[1].split()) in " ".join(o[1].split()) for o in seen["near"])
    for source, _, target in mixing.targets(list(sizes.items())):
        assert abs(taken[source] - target) <= 1
    # packing: each token of each mixed row in one place
    plain = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    tokens = Counter()
    for r, n in seen["mix"].items():
        tokens[r[0]] += n * (len(plain.encode(r[1], add_special_tokens=False).ids) + 1)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed, places = Counter(), Counter()
    for r in pieces:
        packed[r.doc_id] += r.length
        places.update((r.sequence_id, r.offset + i) for i in range(r.length))
    assert packed == tokens and set(places.values()) == {1}
    assert sorted(s * 4096 + o for s, o in places) == list(range(sum(tokens.values())))


def test_pipeline_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = queries.minhash.pin_table(stage(spark, docs, SF))
    assert docs.count() == 0
