import hashlib
import random
import string
import sys
import zlib
from collections import Counter

import corpus_pipeline as C
import public_tokenizers as P
import pytest
import tiktoken
from papyra.llm import bpe, mixing
from pyspark.sql import functions as F
from test_mixing import plain_rates
from test_near_duplicates import plain


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Documents before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "language", "near_duplicates", "mixing", "tokens"]
    for d in stages[1:5]:
        assert d.columns == stages[0].columns


def test_each_stage_keeps_rows_of_the_one_before(stages):
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in stages]
    for a, b in zip(ids, ids[1:], strict=False):
        assert b <= a
    assert len(ids[-1]) == len(ids[-2]) > 0


def test_good_documents_stay(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = {r["doc_id"] for r in labels.collect()} & {r["doc_id"] for r in stages[0].collect()}
    kept = {r["doc_id"] for r in stages[2].collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    cls, _ = plain(rows)
    least = {}
    for (k, _), c in zip(rows, cls, strict=True):
        least[c] = min(least.get(c, k), k)
    assert {r["doc_id"] for r in stages[3].collect()} == set(least.values())


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = sorted(map(tuple, C.run(spark, sf_dir).collect()))
    assert got == sorted(map(tuple, stages[5].collect()))


NEW = {"p_doc", "host_rate", "path_rate", "score", "keep", "lang_pred", "nearness", "topic", "tokens", "p", "sampled", "_host", "n", "s", "host_n"}


def test_stages_on_edge_rows(spark, sf_dir, edge_docs):
    """Nulls, empty and long texts, ties, repeated rows and columns named like those that stages append."""
    docs = edge_docs.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in sorted(NEW - set(edge_docs.columns))))
    before = Counter(map(str, docs.collect()))
    got = {}
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        got[name] = out.collect()
        assert not Counter(map(str, got[name])) - before, name
    assert len(got["near_duplicates"]) == len({r["text"] or "" for r in docs.collect()})
    assert not {r["doc_id"] for r in got["language"]} & {3, 4, 7, 9}
    tokens = C.tokenized(spark, docs, sf_dir).collect()
    assert len(tokens) == docs.count() and {r["n_tokens"] for r in tokens if r["doc_id"] in (3, 4)} == {0}


def test_stages_on_an_empty_table(spark, sf_dir, empty_docs):
    for _, stage in C.STAGES:
        assert stage(spark, empty_docs, sf_dir).count() == 0


def test_rows_of_one_id_and_text_leave_the_same_row(spark, sf_dir):
    rows = [(1, "same text of five words here", "en", f"src{i}", i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    least = df.orderBy(F.xxhash64(*df.columns)).first()
    assert C.one_of_each(spark, df.repartition(3), sf_dir).collect() == [least]


def test_mixing_stage_samples_at_plain_rates(spark, sf_dir, stages):
    """Expected tokens kept follow the raked targets: the stage keeps what draws below a plain rate."""
    docs = stages[3]
    m = mixing.mix(docs).toPandas()
    cell, _ = plain_rates(m, mixing.KEEP, mixing.TEMPER)
    rate = m.merge(cell, on=list(mixing.DIMENSIONS)).set_index("doc_id").expected
    draw = {k: int(hashlib.md5(f"{k}:0".encode()).hexdigest()[:13], 16) / (1 << 52) for k in rate.index}
    clear = {k for k in rate.index if abs(draw[k] - rate[k]) > 1e-5}
    assert {k for k in clear if draw[k] < rate[k]} == clear & {r["doc_id"] for r in stages[4].collect()}


def test_token_stage_equals_tiktoken(stages):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_entry_lists_the_pipeline():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))


def test_language_stage_rejects_unknown_languages_and_gibberish(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(7)
    noise = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(n)) for n in (30, 300)]
    odd = [
        *noise,
        "asdf jkl qwerty zxcv hjkl asdf qwer zxcvbnm " * 20,
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    ]
    # Held-out ids, so that no text is part of what is learned.
    free = [i for i in range(10_000_000, 10_000_100) if zlib.crc32(str(i).encode()) % 4 == 2][: len(odd)]
    more = spark.createDataFrame([(i, t, "en", "odd", len(t)) for i, t in zip(free, odd, strict=True)], docs.schema)
    kept = {r["doc_id"] for r in C.known_language(spark, docs.union(more), sf_dir).select("doc_id").collect()}
    assert not kept & set(free)
    with_letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert len(with_letters & kept) >= 0.97 * len(with_letters)
