import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, r, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_edges(spark, edge_docs, empty_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    items = [(1, "The quick FOX mit"), (2, None), (3, ""), (None, "words ñandú 日本語のテキスト"), (4, "absent"), (5, "lazy lazy"), (5, "dog"), (6, "123 it's")]
    asked = spark.createDataFrame([(*x, "a", 3) for x in items], "item_id long, text string, doc_id string, score int")
    odd = edge_docs.withColumns({c: F.lit("x") for c in ("shard", "term", "df", "item_id", "rank", "postings")})
    assert got(lexical.search(odd, asked)) == plain(docs, items)
    assert lexical.search(empty_docs, asked).count() == 0 and lexical.search(odd, asked.limit(0)).count() == 0


@pytest.mark.parametrize("docs, window, block", [(7, 4, 3), (1000, 16, 200_000)])
def test_shards_windows_and_blocks(spark, monkeypatch, docs, window, block):
    """Small vocabularies give many ties; a third of the rows are one text; ids repeat."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", docs)
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    rng = random.Random(docs)
    words = [f"w{i}" for i in range(30)]
    rows = [(rng.randrange(400), "same text w1 w2" if rng.random() < 0.35 else " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(500)]
    items = [(i, " ".join(rng.sample(words, 4))) for i in range(12)]
    found = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"), k=20)
    assert got(found) == plain(rows, items, 20)


def test_index_of_all_terms(spark, edge_docs):
    rows = lexical.index(edge_docs).collect()
    held = [(r["doc_id"], Counter(terms(r["text"]))) for r in edge_docs.collect() if terms(r["text"])]
    of = {r["shard"]: r["ids"] for r in rows if r["term"] is None}
    back = Counter()
    for r in rows:
        if r["term"] is not None:
            docs, tf = lexical.unpack_postings(r["postings"])
            assert len(docs) == r["df"] and (np.diff(docs) > 0).all()
            back.update((of[r["shard"]][d], r["term"], int(n)) for d, n in zip(docs, tf, strict=True))
    assert back == Counter((i, w, n) for i, c in held for w, n in c.items())
    assert sum(r["terms"] for r in rows if r["term"] is None) == sum(c.total() for _, c in held)


def test_terms_alike_in_spark_and_python(spark):
    texts = ["a1B2 c-d_e", "É é", "x\x7fy\x00z", "`[@]{}~/:;", "ÀB c", "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexical.terms_of(F.col("t")).alias("w"))
    for r in df.collect():
        assert r["w"] == terms(r["t"]) == [w.decode() for w in r["t"].encode().translate(lexical._LOWER).split()]


def test_postings_round_trip():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 1000):
        docs = np.cumsum(rng.integers(1, 1 << 20, size))
        tf = rng.integers(1, 1 << 40, size)
        raw = lexical.pack_postings(docs, tf)
        back = lexical.unpack_postings(raw)
        assert back[0].tolist() == docs.tolist() and back[1].tolist() == tf.tolist()
    assert len(lexical.pack_postings(np.arange(1000), np.ones(1000, int))) == 2000


def test_best_documents_equals_sorting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        docs = int(rng.integers(1, 300))
        cursors = []
        for _ in range(int(rng.integers(0, 6))):
            at = np.flatnonzero(rng.random(docs) < 0.3)
            cursors.append((at, rng.integers(0, 4, len(at))))
        score = np.zeros(docs, np.int64)
        for at, gain in cursors:
            score[at] += gain
        want = sorted(((-int(s), d) for d, s in enumerate(score) if s > 0))[:7]
        assert lexical.best_documents(cursors, docs, 7) == [(-s, d) for s, d in want]


def test_query_equals_plain(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(queries.op13_lexical(spark, sf_dir)) == plain(docs, items)
