import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from papyra.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = bpe.read_ranks(PATH)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(RAW), special_tokens={})


def encoded(texts):
    return [r for _, _, rows in bpe.encode_texts(pa.array(texts, pa.string()), RAW) for r in rows]


def test_random_texts_equal_tiktoken():
    random.seed(5)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "1", "!", "é", "\u3000", "Z", "'ll", "日", "\u0300", "٣", "\x1c", "word"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(5000)]
    texts += ["a" * 3000, "ab" * 500, "!" * 999, " " * 777, "", "'s", "x's's 'll"]
    assert encoded(texts) == [ENC.encode_ordinary(t) for t in texts]


def test_every_code_point_splits_alike():
    texts = ["a" + chr(i) + "b1" + chr(i) + "! " + chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert encoded(texts) == [ENC.encode_ordinary(t) for t in texts]


def test_scan_is_associative():
    compose, gens, _ = bpe._monoid()
    for a in range(0, len(compose), 17):
        for b in gens:
            for c in gens:
                assert compose[compose[a, b], c] == compose[a, compose[b, c]]


def test_edge_rows_round_trip(edge_docs):
    got = bpe.decode(bpe.encode(edge_docs, PATH), PATH).collect()
    assert len(got) == edge_docs.count()
    together = bpe.encode(edge_docs, PATH, bytes_col="decoded").drop("byte_offsets").collect()
    assert sorted(map(str, together)) == sorted(str(r) for r in bpe.decode(bpe.encode(edge_docs, PATH), PATH).drop("byte_offsets").collect())
    for r in got:
        assert r["ids"] == ENC.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["digest"] == "z"


def test_offsets_decode_a_span(spark):
    df = spark.createDataFrame([("hello wonderful world, hello",)], "text string")
    row = bpe.encode(df, PATH).select("ids", "byte_offsets", bpe.decode_span("ids", "byte_offsets", F.lit(6), F.lit(9)).alias("part")).first()
    assert row["byte_offsets"][0] == 0 and len(row["ids"]) == len(row["byte_offsets"])
    assert "won" in ENC.decode(row["part"])


def test_unknown_id_fails(spark):
    df = spark.createDataFrame([([60000],)], "ids array<int>")
    with pytest.raises(Exception, match="index out of range"):
        bpe.decode(df, PATH).collect()


def test_empty_table_and_null_ids(empty_docs, spark):
    assert bpe.decode(bpe.encode(empty_docs, PATH), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first()["decoded"] is None


def test_query_equals_tiktoken(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, sf_dir).collect():
        ids = ENC.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
