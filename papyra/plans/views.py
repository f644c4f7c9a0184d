"""Tables of the library's shape derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import policy as P
from ..functions import text as T
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import reason as R
from ..operators.scratch import Scratch

PREDICATE_WORDS = ["increases", "decreases", "related to", "inhibits", "mentions", "regulates", "associated with", "causes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words (runs of letters of any script) of each sentence, with block and source ids.

    The words are made inside the generator, so no filter above computes them again.
    """
    # The rest of a sentence is not read by the patterns once its third word has ended.
    head = lambda s: F.regexp_extract(F.lower(s), r"^\P{L}*+(\p{L}++\P{L}++\p{L}++\P{L}++\p{L}++)", 1)
    words = F.transform(T.sentences(F.col("text")), lambda s: F.split(F.regexp_replace(head(s), r"\P{L}+", " "), " "))
    w = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("pos", "w"))
    w = w.select("doc_id", (F.col("pos") + 1).alias("i"), "w")
    doc = F.col("doc_id") * 10000
    return w.where(F.size("w") >= 3).select(
        (doc + F.col("i")).alias("triple_id"),
        (F.col("doc_id") % 4).alias("job_id"),
        (doc + F.floor((F.col("i") - 1) / 4) + 1).alias("block_id"),
        F.col("doc_id").alias("ingestion_source_id"),
        F.get("w", 0).alias("subject"),
        F.get("w", 1).alias("predicate"),
        F.get("w", 2).alias("object"),
    )


def triples_with_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, PREDICATE_WORDS))
    return triples(spark, sf_dir).withColumn("predicate", F.get(words, F.ascii("predicate") % 8))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.structural_edges(triples(spark, sf_dir))


def projected_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with projected predicates whose ends are concepts."""
    return projected(triples(spark, sf_dir))


def projected(triples: DataFrame) -> DataFrame:
    return G.without_noise(triples.withColumn("predicate", T.project_predicate(F.col("predicate"))))


def projected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.structural_edges(projected_triples(spark, sf_dir))


def evidence_of(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, postings) of triples, both written."""
    return graph_of(written(triples, "triples"))


def graph_of(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, postings) of written triples, both written."""
    return written(G.structural_edges(kept), "edges"), written(E.postings(kept), "postings")


def written(df: DataFrame, name: str) -> DataFrame:
    """df once computed: plans that read a graph several times scan its small table instead of the texts."""
    return Scratch(df.sparkSession, name).write(df)


def projected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(G.pair_edges(projected_edges(spark, sf_dir)), "pairs")


def live_pairs(pairs: DataFrame) -> DataFrame:
    return written(G.suppress_hubs(pairs), "live")


def hypotheses(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """Filtered hypotheses, over the given written pairs if a plan needs them besides."""
    pairs = projected_pairs(spark, sf_dir) if pairs is None else pairs
    found = R.hypotheses_of(R.discovery_paths(live_pairs(pairs)))
    return R.filter_hypotheses(found, pairs)


def predicate_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses, before filters, over triples with real predicate phrases."""
    pairs = written(G.pair_edges(G.without_noise(G.structural_edges(triples_with_predicates(spark, sf_dir)))), "pairs")
    return R.hypotheses_of(R.discovery_paths(live_pairs(pairs)))


def flat(df: DataFrame, *arrays: str, sep: str = ",") -> DataFrame:
    """Arrays as joined text, so values compare alike everywhere."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), sep) for c in arrays})


# --- SQL of the same views -------------------------------------------------------

SQL_TRIPLES = r"""
v_sents AS (
  SELECT doc_id, unnest(ss) st, generate_subscripts(ss, 1) i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(
      regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') ss
    FROM documents)),
v_words AS (SELECT doc_id, i, string_split(trim(regexp_replace(lower(st), '[^\p{L}]+', ' ', 'g')), ' ') w FROM v_sents),
v_triples AS (
  SELECT doc_id * 10000 + i AS triple_id, doc_id % 4 AS job_id, doc_id * 10000 + (i - 1) // 4 + 1 AS block_id,
         doc_id AS ingestion_source_id, w[1] AS subject, w[2] AS predicate, w[3] AS object
  FROM v_words WHERE len(w) >= 3)
"""


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    """Without white space of any kind at both ends, as functions.text.strip."""
    return f"trim({x}, {sql_quote(T.BLANKS)})"


def sql_part(x: str) -> str:
    """A part of a piped line: trimmed, without one matching pair of quotes, trimmed."""
    s = sql_strip(x)
    pair = " OR ".join(f"(starts_with({s}, {q}) AND ends_with({s}, {q}))" for q in ("'\"'", "''''"))
    return sql_strip(f"CASE WHEN length({s}) >= 2 AND ({pair}) THEN substr({s}, 2, length({s}) - 2) ELSE {s} END")


def sql_noise(column: str) -> str:
    words = ", ".join(sql_quote(w) for w in P.NOISE_WORDS)
    tests = [f"{column} IS NULL", f"trim({column}) = ''", f"lower(trim({column})) IN ({words})"]
    # RE2 knows ASCII words only; the classes say the same of all scripts.
    patterns = [p.replace(r"[^\w\s]", r"[^\p{L}\p{N}_\s]") for p in P.NOISE_PATTERNS]
    tests += [f"regexp_matches(trim({column}), {sql_quote('(?i)' + p)})" for p in patterns]
    return "(" + " OR ".join(tests) + ")"


def sql_predicate(column: str) -> str:
    cases = " ".join(f"WHEN contains(lower({column}), {sql_quote(k)}) THEN {sql_quote(v)}" for k, v in T.predicate_keys())
    return f"CASE {cases} ELSE 'related_to' END"


SQL_TRIPLES_PRED = (
    SQL_TRIPLES
    + ", v_triples_pred AS (SELECT * REPLACE ((["
    + ", ".join(sql_quote(w) for w in PREDICATE_WORDS)
    + "])[ascii(predicate) % 8 + 1] AS predicate) FROM v_triples)\n"
)


def sql_edges(source: str, name: str, predicate: str = "predicate", noise: bool = True) -> str:
    keep = f"WHERE NOT {sql_noise('subject')} AND NOT {sql_noise('object')}" if noise else ""
    return f"""
{name} AS (
  SELECT subject, predicate, object, count(DISTINCT ingestion_source_id)::INTEGER AS support,
         list_sort(list_distinct(list(triple_id))) AS triple_ids, list_sort(list_distinct(list(block_id))) AS block_ids,
         list_sort(list_distinct(list(ingestion_source_id))) AS source_ids
  FROM (SELECT * REPLACE ({predicate} AS predicate) FROM {source}) {keep}
  GROUP BY subject, predicate, object)
"""


def sql_paths(edges: str, hub_degree: int = P.HUB_DEGREE) -> str:
    """v_pairs, v_live (hubs suppressed) and v_paths (hypotheses before filters) over a CTE of edges."""
    ids = ", ".join(f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in G.IDS)
    united = ", ".join(f"list_sort(list_distinct(list_concat(a.{c}, b.{c}))) AS {c}" for c in G.IDS)
    return f"""
v_pairs AS (
  SELECT subject, object, list_sort(list_distinct(list(predicate))) AS predicates, max(support) AS support, {ids}
  FROM {edges} GROUP BY subject, object),
v_degree AS (SELECT node, count(*) AS degree FROM (
  SELECT subject AS node FROM v_pairs UNION ALL SELECT object FROM v_pairs) GROUP BY node),
v_hubs AS (SELECT node FROM v_degree WHERE degree > {hub_degree}),
v_live AS (SELECT * FROM v_pairs WHERE subject NOT IN (SELECT node FROM v_hubs) AND object NOT IN (SELECT node FROM v_hubs)),
v_paths AS (
  SELECT a.subject AS source, a.object AS mid, b.object AS target, list_concat(a.predicates, b.predicates) AS predicates,
         least(a.support, b.support)::INTEGER AS confidence, a.predicates AS p1, b.predicates AS p2, {united}
  FROM v_live a JOIN v_live b ON a.object = b.subject
  WHERE a.subject <> b.object AND a.subject <> a.object AND b.subject <> b.object
    AND NOT EXISTS (SELECT 1 FROM v_live x WHERE x.subject = a.subject AND x.object = b.object)
    AND NOT EXISTS (SELECT 1 FROM v_live x WHERE x.subject = b.object AND x.object = a.subject)
    AND NOT EXISTS (SELECT 1 FROM v_live x WHERE x.subject = a.object AND x.object = a.subject)
    AND NOT EXISTS (SELECT 1 FROM v_live x WHERE x.subject = b.object AND x.object = b.subject))
"""


SQL_HYPOTHESES = (
    SQL_TRIPLES
    + ","
    + sql_edges("v_triples", "v_edges_p", sql_predicate("predicate"))
    + ","
    + sql_paths("v_edges_p")
    + """, v_hyp AS (
  SELECT *, source || ' > ' || mid || ' > ' || target AS path, confidence >= 2 AS passed_filter,
         CASE WHEN confidence < 2 THEN 'Confidence ' || confidence || ' < 2' END AS weak FROM v_paths)
"""
)
