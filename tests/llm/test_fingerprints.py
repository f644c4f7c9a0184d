import hashlib

import numpy as np

from papyra.llm import fingerprints as P
from papyra.llm import queries


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_query_equals_plain(spark, sf_dir):
    docs = sorted(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    got = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (P.Sketches(*P._flat([x])) for x in (t, edited, after))
        r = got[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == a.text(0) and r["edited_fingerprint"] == b.text(0)
        for near, other in ((r["near_edited"], b), (r["near_next"], c)):
            x, y = set(a.key.tolist()), set(other.key.tolist())
            assert abs(near - len(x & y) / len(x | y)) < 1e-9


def test_difference_is_exact():
    texts = ["one two three four\nfive six", "one two three four\nfive seven", "", "same\nsame\nsame", "same\nsame"]
    s = P.Sketches(*P._flat(texts))
    sets = [set(s.key[s.at[i] : s.at[i + 1]].tolist()) for i in range(len(texts))]
    a, b = np.array([0, 0, 3, 2]), np.array([1, 2, 4, 2])
    pair, key, sign = P.difference(s, a, s, b)
    for p in range(4):
        found = {(k, g) for q, k, g in zip(pair.tolist(), key.tolist(), sign.tolist(), strict=True) if q == p}
        x, y = sets[a[p]], sets[b[p]]
        assert found == {(k, 1) for k in x - y} | {(k, -1) for k in y - x}


def test_stored_fingerprints_subtract_and_peel():
    texts = ["one two three four\nfive six\nseven", "one two three four\nfive sixty\nseven", "", "\n".join(map(str, range(400)))]
    s = P.Sketches(*P._flat(texts))
    sets = [set(s.key[s.at[i] : s.at[i + 1]].tolist()) for i in range(len(texts))]
    stored = [s.text(i) for i in range(len(texts))]
    assert [P.parse(t)[0] for t in stored] == [len(x) for x in sets]
    for a in range(3):
        for b in range(3):
            assert P.stored_difference(stored[a], stored[b]) == (sets[a] - sets[b], sets[b] - sets[a])
    assert P.stored_difference(stored[3], stored[3]) == (set(), set())
    assert P.stored_difference(stored[3], stored[2]) is None
    whole = P.subtract(P.parse(stored[0])[1], P.parse(stored[1])[1])
    again = P.subtract(tuple(x[:12] for x in s.base), tuple(x[12:24] for x in s.base))
    assert all((x == y).all() for x, y in zip(whole, again, strict=True))


def test_a_hot_id_is_dealt_over_ranges(spark):
    rows = [(None, f"text number {i}") for i in range(400)] + [(i, f"other text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tasks = []

    def near(parts):
        """Rows in the order of the rule: null ids first, then by id and hash of the text."""
        got = {r["fingerprint"]: r for r in P.compare_with_next(df, buckets=parts).collect()}
        assert len(got) == len(rows)
        return {k: (r["edited_sha256"], r["near_edited"], r["near_next"]) for k, r in got.items()}

    assert near(1) == near(16)
    placed = P.compare_with_next(df, buckets=64)
    tasks = [len(p) for p in placed.rdd.glom().collect()]
    assert max(tasks) < 350


def test_large_differences_are_retried():
    left, right = "\n".join(f"line {i} left" for i in range(3000)), "\n".join(f"line {i} right" for i in range(3000))
    s = P.Sketches(*P._flat([left, right]))
    pair, _, _ = P.difference(s, np.array([0]), s, np.array([1]))
    assert len(pair) == len(set(s.key.tolist())) - 2 * len(set(s.key[: s.at[1]].tolist()) & set(s.key[s.at[1] :].tolist())) or len(pair) > 3000
    assert P.likeness(s, np.array([0]), s, np.array([0]))[0] == 1.0


def test_edges(edge_docs, empty_docs, spark):
    got = P.compare_with_next(edge_docs, buckets=5).toPandas()
    assert len(got) == edge_docs.count()
    same = got[got.doc_id.isin([1, 2])]
    assert same.fingerprint.nunique() == 1
    assert got[got.doc_id.isin([3, 4])].fingerprint.nunique() == 1
    assert ((got.near_edited >= 0) & (got.near_edited <= 1)).all()
    assert P.compare_with_next(empty_docs).count() == 0
    lone = P.compare_with_next(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and lone["near_next"] == 1.0
    assert P.fingerprint(edge_docs).count() == edge_docs.count()


def test_version_difference(spark):
    rows = [(1, "a b c\nd e f", "a b c\nd e g"), (2, None, None), (3, "same", "same"), (4, "", "new text"), (5, "\n".join(map(str, range(500))), None)]
    got = {r["i"]: (set(r["removed"]), set(r["added"])) for r in P.version_difference(spark.createDataFrame(rows, "i int, old string, new string"), "old", "new").collect()}
    for i, old, new in rows:
        x, y = (set(P.Sketches(*P._flat([t or ""])).key.view(np.int64).tolist()) for t in (old, new))
        assert got[i] == (x - y, y - x)
