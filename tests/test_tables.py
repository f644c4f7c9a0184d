"""Table functions against the column functions of the same rules."""

import random

from pyspark.sql import functions as F

from papyra.functions import tables
from papyra.functions import text as T

LINES = [
    "a | b | c", "a|b", "|||", "a | b | c | d", " 'x y' | \"p\" | '' ", "''|p|o", "\"a'|b|'c'", "x" * 3000 + " | p | o", "é | ñ | 日本", "\t| p | o", "  ' s ' | p | o", "a |b| c ", "text only",
    "'a|b'|c", "q\"|\"p\"|o", "'|p|o", "　s　| p |o",
]


def test_lateral_equals_column_function(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choices(LINES, k=rng.randrange(6)))) for i in range(120)] + [(200, None), (201, ""), (202, "a|b|c\r\nd|e|f")]
    df = spark.createDataFrame(rows, "id int, response string")
    tables.register(spark)
    df.createOrReplaceTempView("responses")
    got = spark.sql("SELECT id, position, subject, predicate, object FROM responses, LATERAL parse_triples(response)")
    want = df.select("id", F.posexplode(T.parse_triples(F.col("response"))).alias("position", "t")).select("id", "position", *(F.get("t", k) for k in range(3)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_joins_and_counts(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a|b|c\nd|e|f"), (2, "none")], "id int, response string").createOrReplaceTempView("answers")
    got = spark.sql("SELECT id, count(subject) AS n FROM answers LEFT JOIN LATERAL parse_triples(response) ON true GROUP BY id ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, 0)]


def test_sentences_equal_column_function(spark):
    texts = ["One. Two!  Three?\nFour", None, "", " . . ", "No end", "A.B c.\u3000D! e"]
    tables.register(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    df.createOrReplaceTempView("bodies")
    got = spark.sql("SELECT id, position, sentence FROM bodies, LATERAL split_sentences(body)")
    want = df.select("id", F.posexplode(T.sentences(F.col("body"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_python_in_the_plan(spark):
    tables.register(spark)
    plan = spark.sql("SELECT * FROM VALUES ('a|b|c') AS r(x), LATERAL parse_triples(x)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Generate" in plan
