import random
import re

from papyra.llm import license_scan as S
from papyra.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, k) for k, p in S.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places}))


def test_query_equals_plain(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op5_license_scan(spark, sf_dir).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def split(template):
    return "".join(c.lower() if c.isalnum() else " " for c in template).split()


def bigrams(template):
    t = split(template)
    return {i: tuple(t[i : i + 2]) for i in range(len(t) - 1) if not S.COMMON.issuperset(t[i : i + 2])}


def best_chain(words, template):
    """(share of the template's telling bigrams, places) of the longest chain of places that run forward on near diagonals."""
    grams = bigrams(template)
    by = {}
    for i, g in grams.items():
        by.setdefault(g, []).append(i)
    hits = [(i, p) for i in range(len(words) - 1) for p in by.get(tuple(words[i : i + 2]), ())]
    best = []
    for k, (at, p) in enumerate(hits):
        steps = [best[j] for j in range(k) if hits[j][0] < at and hits[j][1] < p and abs(hits[j][0] - hits[j][1] - at + p) <= S.NEAR]
        n, places = max(steps, default=(0, ()))
        best.append((1 + n, (*places, p)))
    n, places = max(best, default=(0, ()))
    return n / len(grams), set(places)


def is_notice(words, template):
    """Whether all telling words of a notice stand in order with nothing but common words between."""
    telling = [w for w in split(template) if w not in S.COMMON]
    for start in range(len(words)):
        at, found = start, 0
        while at < len(words) and found < len(telling):
            if words[at] == telling[found]:
                found += 1
            elif found == 0 or words[at] not in S.COMMON:
                break
            at += 1
        if found == len(telling):
            return True
    return False


def own_labels(words):
    out = {}
    for label, text in S.TEMPLATES.items():
        share, places = best_chain(words, text)
        lacks = [{i for i, g in bigrams(text).items() if g not in bigrams(o).values()} for k, o in S.TEMPLATES.items() if k != label]
        told = all(len(places & x) >= S.COVERAGE * len(x) for x in lacks if x)
        if share >= S.COVERAGE and told and (len(split(text)) > S.SHORT or is_notice(words, text)):
            out[label] = share
    return out


def test_own_labels_equal_plain(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, "apache license " * 6), (-2, "x " + S.TEMPLATES["isc-text"] + " y"), (-3, S.TEMPLATES["zlib-text"].upper())]
    got = S.license_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    for r in got:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), texts[r["doc_id"]] or ""))
        base = set(filter(None, plain(texts[r["doc_id"]])[4].split(",")))
        own = own_labels(words)
        assert r["labels"] == ",".join(sorted(base | set(own)))
        assert abs(r["score"] - max([1.0] * bool(base) + list(own.values()), default=0.0)) < 1e-9
    assert {r["doc_id"]: r["labels"] for r in got if r["doc_id"] < 0} == {-1: "apache", -2: "isc-text", -3: "zlib-text"}


def labels_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in S.license_report(df).orderBy("doc_id").collect()]


def test_neighbouring_licenses_keep_their_own_label(spark):
    """A notice that differs in one telling word names another license."""
    want = {
        "Licensed under the BSD license, version 2.0": "",
        "this package is licensed under the zlib license version 2 0": "",
        "Licensed under the MIT license, version 2.0": "mit",
        "Licensed under the GNU General Public License, version 2": "gpl",
        "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl-3.0-notice",
        "Licensed under CC BY 4.0": "cc-by-4.0",
        "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa-4.0",
        "Licensed under CC BY-NC 3.0": "",
        "Licensed under the Eclipse Apache License, Version 2.0": "apache",
        "Licensed under Apache License, Version 2.0": "apache,apache-2.0-notice",
        "Licensed under the the Apache License and of Version 2.0": "apache,apache-2.0-notice",
        "Licensed under the Apache License, Version 2.1": "apache",
    }
    assert dict(zip(want, labels_of(spark, list(want)), strict=True)) == want


def test_every_template_is_itself_and_no_other(spark):
    names = sorted(S.TEMPLATES)
    texts = [f"before it {S.TEMPLATES[k]} after it" for k in names]
    for name, found in zip(names, labels_of(spark, texts), strict=True):
        assert [x for x in found.split(",") if x not in S.BASE] == [name]


def test_no_row_of_the_shuffle_holds_all_words(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_GRAMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, write = [], S.Scratch.write
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    monkeypatch.setattr(S.Scratch, "write", lambda self, df: (plans.append(df._jdf.queryExecution().explainString(formatted)), write(self, df))[1])
    try:
        S.scan(spark.createDataFrame([(1, "mit license and more")], "doc_id long, text string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plans[0])
    assert len(dealt) == 2 and any("_before" in columns for columns in dealt)
    assert not any(re.search(r"\bwords#", columns) for columns in dealt)


def test_long_templates_drift_and_partial(spark):
    whole = S.TEMPLATES["bsd-text"]
    words = whole.split()
    dropped = " ".join(words[:15] + words[16:])
    inserted = " ".join(words[:10] + ["very"] + words[10:])
    half = " ".join(words[:12])
    rows = [(1, "before " * 50 + whole), (2, dropped), (3, inserted), (4, half), (5, "the of and the conditions of this")]
    got = {r["doc_id"]: r for r in S.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 6)] == ["bsd-text", "bsd-text", "bsd-text", "", ""]
    assert got[1]["score"] == 1.0 and got[2]["score"] < 1.0 and got[5]["score"] == 0.0


def test_many_templates_are_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x " + S.TEMPLATES["isc-text"]), (2, "mit license")], "doc_id long, text string")
    want = sorted(map(tuple, S.license_report(df).collect()))
    monkeypatch.setattr(S, "BROADCAST_GRAMS", 1)
    assert sorted(map(tuple, S.license_report(df).collect())) == want


def test_edges(edge_docs, empty_docs):
    got = S.license_report(edge_docs).collect()
    assert len(got) == edge_docs.count()
    ten = next(r for r in got if r["doc_id"] == 10)
    assert (ten["n_base"], ten["first_word"], ten["last_word"], ten["base_labels"]) == (2, 3, 5, "mit")
    assert sum(r["doc_id"] == 2 for r in got) == 2
    assert S.license_report(empty_docs).count() == 0


def test_repeated_grams_are_not_a_license(spark):
    cc = S.TEMPLATES["cc-by-nc-4.0"]
    shuffled = "NC 4.0 BY-NC CC BY under CC licensed under"
    rows = [
        (1, "4.0 | 4.0 | 4.0 | 4.0"),
        (2, " ".join(["2.0"] * 12)),
        (3, "version 3 | " * 40),
        (4, shuffled),
        (5, "4.0 | 4.0 | 4.0 | " + cc + " | 4.0 | 4.0"),
        (6, cc + " and once more " + cc),
        (7, "the software " * 60),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in S.license_report(df).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 7)] == [("", 0.0)] * 5
    assert got[5] == got[6] == ("cc-by-nc-4.0", 1.0)
    _, spans = S.scan(df.where("doc_id in (5, 6)"))
    assert sorted((r["stop"] - r["start"], r["score"]) for r in spans.collect()) == [(7, 1.0)] * 3


def test_chains_equal_all_chains_tried():
    rng = random.Random(5)
    for _ in range(200):
        hits = sorted({(rng.randrange(14), rng.randrange(6)) for _ in range(rng.randrange(1, 16))})

        def longest(k):
            at, place = hits[k]
            steps = [j for j, (a, p) in enumerate(hits) if a < at and p < place and abs(at - place - a + p) <= S.NEAR]
            return 1 + max(map(longest, steps), default=0)

        got = S.chains(hits)
        assert got[0][2] == max(map(longest, range(len(hits))))
        words = [w for first, last, _ in got for w in range(first, last + 1)]
        assert len(words) == len(set(words))
