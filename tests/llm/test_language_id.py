import numpy as np
from pyspark.sql import functions as F

from papyra.llm import language_id as L
from papyra.llm import queries


def test_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.op7_language_id(spark, sf_dir).join(truth, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_predictions_equal_plain(spark, sf_dir):
    """Grams counted in a dictionary, and every machine's vote taken one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs.where(~L.is_held_out()).selectExpr("doc_id as key", "text", "lang"))
    mask = (1 << 64) - 1

    def features(text):
        cleaned = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "\0" for c in text)
        seq = [ord(c) if c != "\0" else 32 for i, c in enumerate(cleaned) if c != "\0" or (i and cleaned[i - 1] != "\0")]
        x = np.zeros(L.DIMS)
        for k in range(3):
            for i in range(len(seq) - k):
                code = 0
                for c in seq[i : i + k + 1]:
                    code = (code * 0x1F0001 + c + 1) & mask
                x[(((code + k) * 0x9E3779B97F4A7C15) & mask) >> 52] += 1
        return np.sqrt(x / max(x.sum(), 1)).astype(np.float32)

    def vote(kind, names, x):
        wins, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a in names:
            for b in names:
                if (kind, a, b) in model["machines"]:
                    w = model["machines"][kind, a, b]
                    p = 1 / (1 + np.exp(-3.0 * float(x @ w[:-1] + w[-1])))
                    for name, q in ((a, p), (b, 1 - p)):
                        wins[name] += q
                        least[name] = min(least[name], q)
        best = max(sorted(names), key=wins.get)
        return best, least[best]

    families = {}
    for lang in model["langs"]:
        families.setdefault(L.family_of(lang), []).append(lang)
    got = {r["doc_id"]: r for r in L.predict(docs.select("doc_id", "text"), model).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        x = features(r["text"])
        family, sure = vote("family", sorted(families), x)
        lang, clear = vote("language", sorted(families[family]), x)
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert abs(got[r["doc_id"]]["score"] - sure * clear) < 1e-4


def test_edges(edge_docs, empty_docs):
    got = L.identify(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (3, 4, 7, 9):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[1]["lang_pred"] != "und"
    assert L.identify(empty_docs).count() == 0


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert L.identify(df).first()["lang_pred"] == "und"


def test_one_language_only(spark):
    df = spark.createDataFrame([(i, f"words number {i}", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.identify(df).collect()} == {"en"}


def test_prediction_reads_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs.selectExpr("doc_id as key", "text", "lang"))
    a = L.predict(docs.select("doc_id", "text"), model).toPandas().set_index("doc_id").lang_pred
    b = L.predict(docs.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source"), model).toPandas().set_index("doc_id").lang_pred
    assert (a.sort_index() == b.sort_index()).all()


def test_a_profile_is_not_moved_by_one_odd_row():
    rng = np.random.default_rng(3)
    x = np.zeros((201, L.DIMS))
    for i in range(200):
        x[i, :200] = rng.dirichlet(np.full(200, 5.0))
    x[200, 3000:3200] = 1 / 200
    w = L.train_profile(np.sqrt(x))
    fit = x @ w[:-1]
    assert (fit[:200] >= w[-1]).all() and fit[200] < w[-1]
    assert L.train_profile(np.sqrt(x[:1]))[-1] == -np.inf


def test_what_the_docstring_says_of_odd_tables(spark, edge_docs, empty_docs):
    rows = L.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 7, 9)} == {"und"}
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert len({(r["lang_pred"], round(r["score"], 6)) for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert L.identify(empty_docs).count() == 0
    unlabelled = L.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
