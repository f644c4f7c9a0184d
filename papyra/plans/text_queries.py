"""Registered queries over texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import tables
from ..functions import text as T
from ..operators import ingest as I
from . import views as V
from .registry import Registry

REG = Registry()

_SENTS = r"""list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""


@REG.query(f"SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTS} AS s FROM documents)")
def sentence_split(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


SQL_BLOCKS = f"""s AS (SELECT doc_id, unnest(s) AS st, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {_SENTS} AS s FROM documents)),
r(doc_id, i, blk, n, tok, st) AS (
  SELECT doc_id, i, 0, 1, length(st) / 3.5, st FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN r.n >= 4 OR r.tok + length(s.st) / 3.5 > 250 THEN r.blk + 1 ELSE r.blk END,
         CASE WHEN r.n >= 4 OR r.tok + length(s.st) / 3.5 > 250 THEN 1 ELSE r.n + 1 END,
         CASE WHEN r.n >= 4 OR r.tok + length(s.st) / 3.5 > 250 THEN length(s.st) / 3.5 ELSE r.tok + length(s.st) / 3.5 END, s.st
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
v_blocks AS (SELECT doc_id AS source_id, blk AS block_order, string_agg(st, ' ' ORDER BY i) AS block_text FROM r GROUP BY doc_id, blk)"""


@REG.query(f"WITH RECURSIVE {SQL_BLOCKS} SELECT source_id, block_order::INTEGER AS block_order, block_text FROM v_blocks")
def block_slicer(spark, sf):
    return I.slice_sources(V.read(spark, sf, "documents"), "doc_id")


def _cut(sep: str) -> str:
    """The last place over 0 at which sep stands whole in the first characters of rest; null if none."""
    head = f"substr(rest, 1, {P.SPAN_CHARS})"
    return f"nullif(greatest(CASE WHEN contains({head}, {sep}) THEN {P.SPAN_CHARS} - strpos(reverse({head}), {sep}) - length({sep}) + 1 ELSE 0 END, 0), 0)"


@REG.query(
    f"""WITH RECURSIVE s(doc_id, pos, span, rest) AS (
  SELECT doc_id, -1, NULL::VARCHAR, text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, pos + 1, CASE WHEN cut IS NULL THEN rest ELSE {V.sql_strip('substr(rest, 1, cut)')} END, CASE WHEN cut IS NOT NULL THEN {V.sql_strip('substr(rest, cut + 1)')} END
  FROM (SELECT *, CASE WHEN length(rest) > {P.SPAN_CHARS} THEN coalesce({_cut("chr(10) || chr(10)")}, {_cut("chr(10)")}, {_cut("' '")}, {P.SPAN_CHARS}) END AS cut FROM s WHERE rest IS NOT NULL AND (pos < 0 OR rest <> '')))
SELECT doc_id, pos::INTEGER AS pos, span FROM s WHERE pos >= 0"""
)
def span_split(spark, sf):
    return I.split_spans(V.read(spark, sf, "documents"), "doc_id")


HEADINGS = ["Abstract", "INTRODUCTION.", "Methods", "Results", "result", "Discussion", "Conclusions", "See also"]


def _region_blocks(spark, sf) -> DataFrame:
    """Sentences as layout blocks; every seventh or so is a heading, a few name an excluded part."""
    s = V.read(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(T.sentences(F.col("text"))).alias("seq", "text"))
    names = F.array(*map(F.lit, HEADINGS))
    heading = F.get(names, ((F.col("source_id") + F.col("seq") * 3) % len(HEADINGS)).cast("int"))
    return s.withColumn(
        "text",
        F.when((F.col("source_id") * 7 + F.col("seq")) % 41 == 40, "References and notes").when((F.col("source_id") + F.col("seq")) % 7 == 0, heading).otherwise(F.col("text")),
    )


_MARK = " ".join(f"WHEN k = {V.sql_quote(a)} THEN {V.sql_quote(b)}" for a, b in P.REGION_MARKERS.items())
_EXCLUDED = " OR ".join(f"contains(lower(substr(text, 1, 80)), {V.sql_quote(w)})" for w in P.EXCLUDED_REGIONS)


@REG.query(
    f"""WITH s AS (SELECT doc_id AS source_id, unnest(s) AS st, generate_subscripts(s, 1) - 1 AS seq FROM (SELECT doc_id, {_SENTS} AS s FROM documents)),
b AS (SELECT source_id, seq, CASE WHEN (source_id * 7 + seq) % 41 = 40 THEN 'References and notes'
  WHEN (source_id + seq) % 7 = 0 THEN ([{', '.join(map(V.sql_quote, HEADINGS))}])[(source_id + seq * 3) % {len(HEADINGS)} + 1] ELSE st END AS text FROM s),
k AS (SELECT *, regexp_replace(trim(lower(text)), '\\.+$', '') AS k, max(({_EXCLUDED})::INTEGER) OVER (PARTITION BY source_id ORDER BY seq) AS cut FROM b),
m AS (SELECT *, CASE WHEN length(text) <= 80 THEN CASE {_MARK} END END AS mark FROM k WHERE cut = 0),
c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur,
  last_value(mark IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq) AS region FROM m),
h AS (SELECT *, mark IS NOT NULL AND mark IS DISTINCT FROM cur AS heading FROM c),
r AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY source_id ORDER BY seq) AS run FROM h)
SELECT source_id, run::BIGINT AS run, region, string_agg(text, ' ' ORDER BY seq) AS text FROM r
WHERE NOT heading AND run > 0 AND region IN ({', '.join(map(V.sql_quote, P.WHITELISTED_REGIONS))}) GROUP BY source_id, run, region"""
)
def region_assign(spark, sf):
    return I.assign_regions(_region_blocks(spark, sf))


@REG.query(
    """WITH p AS (SELECT conv_id AS source_id, turn AS page, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
r AS (SELECT *, 600 - coalesce(sum(length(text)) OVER (PARTITION BY source_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
SELECT source_id, string_agg(substr(text, 1, room::BIGINT), chr(10) || chr(10) ORDER BY page, substr(text, 1, room::BIGINT)) AS text FROM r WHERE room > 0 GROUP BY source_id"""
)
def page_fallback(spark, sf):
    pages = V.read(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("page"), "text")
    return I.page_fallback(pages, 600)


_RESPONSE_SQL = r"""'Here are triples:' || chr(10) || array_to_string(list_transform(range(1, len(w) // 3 + 1),
lambda k: CASE WHEN k % 5 = 0 THEN 'note' WHEN k % 7 = 0 THEN w[3*k-2] || ' | | ' || w[3*k] WHEN k % 4 = 0 THEN '"' || w[3*k-2] || '" | ' || w[3*k-1] || ' |  ''' || w[3*k] || ''' '
ELSE w[3*k-2] || ' | ' || w[3*k-1] || ' | ' || w[3*k] END), chr(10)) || chr(10) || 'Done.'"""


def _responses(spark, sf) -> DataFrame:
    """Documents' words as a model's answer: three to a line, some lines broken."""
    w = V.read(spark, sf, "documents").select("doc_id", F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), " ").alias("w"))
    lines = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor(F.size("w") / 3)), lambda k: k > 0),
        lambda k: F.when(k % 5 == 0, F.lit("note"))
        .when(k % 7 == 0, F.concat(F.get("w", (3 * k - 3).cast("int")), F.lit(" | | "), F.get("w", (3 * k - 1).cast("int"))))
        .when(k % 4 == 0, F.concat(F.lit('"'), F.get("w", (3 * k - 3).cast("int")), F.lit('" | '), F.get("w", (3 * k - 2).cast("int")), F.lit(" |  '"), F.get("w", (3 * k - 1).cast("int")), F.lit("' ")))
        .otherwise(F.concat_ws(" | ", F.get("w", (3 * k - 3).cast("int")), F.get("w", (3 * k - 2).cast("int")), F.get("w", (3 * k - 1).cast("int")))),
    )
    return w.select("doc_id", F.concat(F.lit("Here are triples:\n"), F.array_join(lines, "\n"), F.lit("\nDone.")).alias("response"))


@REG.query(
    rf"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')), ' ') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split({_RESPONSE_SQL}, chr(10))) AS line FROM w),
p AS (SELECT doc_id, list_transform(string_split(line, '|'), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^"(.*)"$', '\1'), '^''(.*)''$', '\1'))) AS p
  FROM l WHERE length(line) - length(replace(line, '|', '')) = 2)
SELECT doc_id, p[1] AS subject, p[2] AS predicate, p[3] AS object FROM p WHERE p[1] <> '' AND p[2] <> '' AND p[3] <> ''"""
)
def triple_line_parse(spark, sf):
    t = _responses(spark, sf).select("doc_id", F.explode(T.parse_triples(F.col("response"))).alias("t"))
    return t.select("doc_id", F.get("t", 0).alias("subject"), F.get("t", 1).alias("predicate"), F.get("t", 2).alias("object"))


@REG.query(
    rf"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')), ' ') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split({_RESPONSE_SQL}, chr(10))) AS line FROM w),
p AS (SELECT doc_id, list_transform(string_split(line, '|'), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^"(.*)"$', '\1'), '^''(.*)''$', '\1'))) AS p
  FROM l WHERE length(line) - length(replace(line, '|', '')) = 2)
SELECT doc_id, p[1] AS subject, p[2] AS predicate, p[3] AS object FROM p WHERE p[1] <> '' AND p[2] <> '' AND p[3] <> ''"""
)
def lateral_triples(spark, sf):
    """The same by a table function in SQL."""
    tables.register(spark)
    _responses(spark, sf).createOrReplaceTempView("papyra_responses")
    return spark.sql("SELECT doc_id, subject, predicate, object FROM papyra_responses, LATERAL parse_triples(response)")


@REG.query(
    f"""WITH RECURSIVE {V.SQL_TRIPLES}, {SQL_BLOCKS}, b AS (SELECT source_id * 10000 + block_order + 1 AS block_id FROM v_blocks),
t AS (SELECT block_id, count(*) AS n FROM v_triples GROUP BY block_id)
SELECT count(*) AS blocks_processed, sum(n)::BIGINT AS triples_created, count(*) FILTER (n IS NULL) AS failures FROM b LEFT JOIN t USING (block_id)"""
)
def extraction_summary(spark, sf):
    blocks = I.slice_sources(V.read(spark, sf, "documents"), "doc_id").select((F.col("source_id") * 10000 + F.col("block_order") + 1).alias("block_id"))
    return I.extraction_summary(blocks, V.triples(spark, sf))


@REG.query(
    """SELECT doc_id, CASE WHEN length(text) > 1000 THEN '[LARGE INPUT PREVIEW]' || chr(10) || 'Total characters: ' || length(text) || chr(10) || 'Snippet: ' || substr(text, 1, 300)
|| '...' || chr(10) || 'End of input: ...' || right(text, 100) || chr(10) || '[END PREVIEW]' ELSE text END AS preview FROM documents"""
)
def preview_wrap(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


_INTENT_TEXT = """CASE WHEN conv_id % 3 = 0 THEN 'noise' || chr(10) || 'research_seed | "' || role || '" | biomedical | ' || replace(text, ' ', ',')
WHEN conv_id % 3 = 1 THEN ' CONVERSATIONAL | ' || text ELSE 'nothing here' END"""


def _intent_text():
    return (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('noise\nresearch_seed | "'), F.col("role"), F.lit('" | biomedical | '), F.replace("text", F.lit(" "), F.lit(","))))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit(" CONVERSATIONAL | "), F.col("text")))
        .otherwise("nothing here")
    )


_ENTS = "list_filter(list_transform(string_split(coalesce(p[4], ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_INTENT = f"""WITH i AS (SELECT conv_id, turn, {_INTENT_TEXT} AS t FROM conversations),
l AS (SELECT conv_id, turn, t, list_filter(string_split(t, chr(10)), lambda x: contains(x, '|')) AS ls FROM i),
p AS (SELECT conv_id, turn, list_transform(string_split(coalesce(ls[-1], t), '|'), lambda x: {V.sql_part('x')}) AS p FROM l),
f AS (SELECT conv_id, turn, upper(p[1]) AS label, CASE WHEN upper(p[1]) = 'RESEARCH_SEED' THEN coalesce(p[2], '') END AS topic,
CASE WHEN upper(p[1]) = 'RESEARCH_SEED' THEN coalesce(p[3], '') END AS domain, CASE WHEN upper(p[1]) = 'RESEARCH_SEED' THEN {_ENTS} END AS e FROM p)"""


def _intents(spark, sf) -> DataFrame:
    return V.read(spark, sf, "conversations").select("conv_id", "turn", T.intent(_intent_text()).alias("i")).select("conv_id", "turn", "i.*")


@REG.query(f"{_INTENT} SELECT conv_id, turn, label, topic, domain, array_to_string(e, '|') AS entities FROM f")
def intent_parse(spark, sf):
    return V.flat(_intents(spark, sf), "entities", sep="|")


@REG.query(
    f"""{_INTENT} SELECT conv_id, turn, coalesce(e[1], topic) AS source, CASE WHEN len(e) >= 2 THEN e[-1] ELSE topic END AS target,
CASE WHEN len(e) > 2 THEN array_to_string(e[2:-2], '|') ELSE '' END AS focus FROM f WHERE label = 'RESEARCH_SEED'"""
)
def seed_endpoints(spark, sf):
    s = _intents(spark, sf).where("label = 'RESEARCH_SEED'").select("conv_id", "turn", T.seed_endpoints(F.col("entities"), F.col("topic")).alias("s"))
    return V.flat(s.select("conv_id", "turn", "s.*"), "focus", sep="|")


_PIECES = r"""parts AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ',') AS p FROM documents),
pieces AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS pos, trim(unnest(p)) AS piece FROM parts)"""


def _pieces(spark, sf) -> DataFrame:
    """All of each document, piece by piece between commas, on one line."""
    parts = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), ",")
    p = V.read(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("pos", "piece"))
    return p.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.trim("piece").alias("piece"))


@REG.query(
    rf"""WITH {_PIECES} SELECT doc_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(trim(lower('"' || piece || ' ;.')), '\s+', ' ', 'g'), '[.,;:]+$', '')),
'^["''“”‘’]+|["''“”‘’]+$', '', 'g') AS n FROM pieces"""
)
def normalize_component(spark, sf):
    return _pieces(spark, sf).select("doc_id", "pos", T.normalize_component(F.concat(F.lit('"'), "piece", F.lit(" ;."))).alias("n"))


_VERBS = list(P.PREDICATE_MAP)


@REG.query(
    f"""WITH {V.SQL_TRIPLES}, v AS (SELECT triple_id, predicate, ([{', '.join(map(V.sql_quote, _VERBS))}])[triple_id % {len(_VERBS)} + 1] AS verb FROM v_triples),
p AS (SELECT triple_id, CASE WHEN triple_id % 3 = 0 THEN predicate ELSE upper(verb) || 'd by ' || predicate END AS phrase FROM v)
SELECT triple_id, {V.sql_predicate('phrase')} AS relation FROM p"""
)
def predicate_map(spark, sf):
    verb = F.get(F.array(*map(F.lit, _VERBS)), (F.col("triple_id") % len(_VERBS)).cast("int"))
    phrase = F.when(F.col("triple_id") % 3 == 0, F.col("predicate")).otherwise(F.concat(F.upper(verb), F.lit("d by "), "predicate"))
    return V.triples(spark, sf).select("triple_id", T.project_predicate(phrase).alias("relation"))


# RE2 knows ASCII word boundaries only; these spell out those of all scripts.
_WORD = r"\p{L}\p{M}\p{N}_"
_FILLER = rf"'(?i)^(?:(?:ensuring that|ensuring|ensures that|that)($|[^{_WORD}])|to ([{_WORD}]))'"
_BODY = rf"regexp_replace(regexp_replace(regexp_replace({V.sql_strip('o')}, {_FILLER}, '\1\2'), '(?i)rather than.*$', ''), '\s+', ' ', 'g')"
_TAIL = rf"regexp_replace({V.sql_strip(_BODY)}, '[.,;:\)]+$', '')"
_ARTICLE = rf"'(?i)(^|[^{_WORD}])(?:the|a|an)($|[^{_WORD}])'"
# Twice, since articles that follow each other share a boundary.
_PLAIN_SUBJECT = V.sql_strip(rf"regexp_replace(regexp_replace(s, {_ARTICLE}, '\1\2', 'g'), {_ARTICLE}, '\1\2', 'g')")


@REG.query(
    rf"""WITH {_PIECES}, o AS (SELECT doc_id, pos, CASE doc_id % 4 WHEN 0 THEN 'ensuring that ' || piece WHEN 1 THEN piece || ' rather than that.' WHEN 2 THEN 'to ' || piece || ' ;)' ELSE piece END AS o FROM pieces)
SELECT doc_id, pos, lower({V.sql_strip(_TAIL)}) AS object FROM o"""
)
def object_clean(spark, sf):
    k = F.col("doc_id") % 4
    o = F.when(k == 0, F.concat(F.lit("ensuring that "), "piece")).when(k == 1, F.concat("piece", F.lit(" rather than that."))).when(k == 2, F.concat(F.lit("to "), "piece", F.lit(" ;)"))).otherwise(F.col("piece"))
    return _pieces(spark, sf).select("doc_id", "pos", T.project_object(o).alias("object"))


@REG.query(
    rf"""WITH {_PIECES}, s AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN piece || ' (' || upper(substr(regexp_replace(piece, '[^a-zA-Z]', '', 'g'), 1, 3)) || 's)' ELSE 'the ' || piece END AS s FROM pieces)
SELECT doc_id, pos, regexp_extract(s, '\(([A-Z0-9]{{2,}})s?\)', 1) AS acronym,
lower(coalesce(nullif(regexp_extract(s, '\(([A-Z0-9]{{2,}})s?\)', 1), ''), {_PLAIN_SUBJECT})) AS subject FROM s"""
)
def acronym_extract(spark, sf):
    short = F.upper(F.substring(F.regexp_replace("piece", "[^a-zA-Z]", ""), 1, 3))
    s = F.when(F.col("doc_id") % 3 == 0, F.concat("piece", F.lit(" ("), short, F.lit("s)"))).otherwise(F.concat(F.lit("the "), "piece"))
    return _pieces(spark, sf).select("doc_id", "pos", T.acronym(s).alias("acronym"), T.project_subject(s).alias("subject"))


_MIXED = """mixed AS (SELECT CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN (1900 + page_id % 300)::VARCHAR WHEN 2 THEN CASE WHEN page_id % 2 = 0 THEN '10.1/' ELSE 'doi:10.1/' END || page_id WHEN 3 THEN 'arXiv:' || page_id || '.5'
WHEN 4 THEN 'PMID:' || page_id WHEN 5 THEN 'ISSN 1234-' || (5000 + page_id % 1000) WHEN 6 THEN 'Gene-' || page_id WHEN 7 THEN 'DNA' ELSE page_id || '%' END AS node, page_id FROM pages)"""


def _mixed(spark, sf) -> DataFrame:
    k, i = F.col("page_id") % 9, F.col("page_id")
    options = ["url", (1900 + i % 300).cast("string"), F.concat(F.when(i % 2 == 0, "10.1/").otherwise("doi:10.1/"), i), F.concat(F.lit("arXiv:"), i, F.lit(".5")), F.concat(F.lit("PMID:"), i),
               F.concat(F.lit("ISSN 1234-"), 5000 + i % 1000), F.concat(F.lit("Gene-"), i), F.lit("DNA"), F.concat(i, F.lit("%"))]
    node = F.when(k == 0, F.col("url"))
    for j, o in enumerate(options[1:], 1):
        node = node.when(k == j, o)
    return V.read(spark, sf, "pages").select("page_id", node.alias("node"))


@REG.query(f"WITH {_MIXED} SELECT page_id, node, CASE WHEN {V.sql_noise('node')} THEN 'noise' ELSE 'concept' END AS kind FROM mixed")
def classify_nodes(spark, sf):
    return _mixed(spark, sf).withColumn("kind", T.classify_node(F.col("node")))


@REG.query(
    rf"""WITH {_MIXED} SELECT page_id, length(node) >= 2 AND NOT {V.sql_noise('node')} AND (regexp_matches(node, '^\p{{Lu}}+$') OR contains(node, ' ') OR regexp_matches(node, '^\p{{Lu}}')
OR contains(node, '-') OR regexp_matches(node, '\d')) AS impactful FROM mixed"""
)
def impactful_nodes(spark, sf):
    return _mixed(spark, sf).select("page_id", T.is_impactful(F.col("node")).alias("impactful"))


_M = {k: V.sql_quote("(?i)" + v) for k, v in P.METADATA_PATTERNS.items()}


@REG.query(
    f"""WITH {_MIXED} SELECT page_id, CASE WHEN regexp_matches(node, {_M['doi']}) THEN 'doi' WHEN regexp_matches(node, {_M['issn']}) THEN 'issn' WHEN regexp_matches(node, {_M['arxiv_id']}) THEN 'arxiv_id'
WHEN regexp_matches(node, {_M['pmid']}) THEN 'pmid' WHEN regexp_matches(node, {_M['url']}) THEN 'url' END AS attribute,
CASE WHEN regexp_matches(node, {_M['doi']}) THEN replace(node, 'doi:', '') WHEN regexp_matches(node, {_M['issn']}) THEN regexp_extract(node, {_M['issn']}, 1) || '-' || regexp_extract(node, {_M['issn']}, 2)
WHEN regexp_matches(node, {_M['arxiv_id']}) THEN regexp_extract(node, {_M['arxiv_id']}, 1) WHEN regexp_matches(node, {_M['pmid']}) THEN regexp_extract(node, {_M['pmid']}, 1)
WHEN regexp_matches(node, {_M['url']}) THEN node END AS value FROM mixed"""
)
def metadata_extract(spark, sf):
    n = F.col("node")
    return _mixed(spark, sf).select("page_id", T.metadata_attribute(n).alias("attribute"), T.metadata_value(n).alias("value"))


_FP = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
SQL_FINGERPRINT = f"sha256({_FP.format('substr(text, 1, 80)')} || ' | ' || {_FP.format('text')})"


@REG.query(f"SELECT doc_id, {SQL_FINGERPRINT} AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.fingerprint(F.substring("text", 1, 80), F.col("text")).alias("fingerprint"))


@REG.query(
    f"""WITH f AS (SELECT doc_id, {SQL_FINGERPRINT} AS fp FROM documents), p AS (SELECT a.doc_id, a.fp AS x, b.fp AS y FROM f a JOIN f b ON b.doc_id = a.doc_id + 1),
d AS (SELECT doc_id, (SELECT count(*) FROM range(1, 65) t(i) WHERE substr(x, i::BIGINT, 1) <> substr(y, i::BIGINT, 1)) AS distance FROM p)
SELECT doc_id, distance::INTEGER AS distance, round(1 - distance / 256.0, 6)::DOUBLE AS similarity FROM d"""
)
def fingerprint_similarity(spark, sf):
    f = fingerprint(spark, sf)
    p = f.join(f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("fingerprint").alias("y")), "doc_id")
    x, y = F.col("fingerprint"), F.col("y")
    return p.select("doc_id", T.hex_distance(x, y).alias("distance"), F.round(T.fingerprint_similarity(x, y), 6).alias("similarity"))


@REG.query(
    """WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Here is your text' || chr(10) || '  ' || text WHEN 1 THEN 'Refinement: ' || replace(text, chr(10), ' ') ELSE text END AS r, text FROM documents),
l AS (SELECT doc_id, text, list_filter(list_transform(string_split(r, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM r)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN array_to_string(l[2:], chr(10)) WHEN 1 THEN '' ELSE array_to_string(l, chr(10)) END AS clean,
length(text) > 200 AND NOT regexp_matches(l[-1], '[.?!"]$') AS again FROM l"""
)
def refine_cleanup(spark, sf):
    k, t = F.col("doc_id") % 3, F.col("text")
    r = F.when(k == 0, F.concat(F.lit("Here is your text\n  "), t)).when(k == 1, F.concat(F.lit("Refinement: "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(t)
    return V.read(spark, sf, "documents").select("doc_id", I.clean_refinement(r).alias("clean"), I.looks_truncated(t, r).alias("again"))


SQL_SOURCES = """v_sources AS (SELECT doc_id AS source_id, doc_id % 3 AS job_id, (['user_text', 'paper_abstract', 'pdf_text', 'api_text'])[doc_id % 4 + 1] AS source_type,
CASE doc_id % 3 WHEN 0 THEN 'paper:' || doc_id WHEN 1 THEN 'file:' || doc_id ELSE 'user_text_' || doc_id END AS source_ref, doc_id % 5 <> 0 AS processed FROM documents)"""


def sources(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    types = F.array(*map(F.lit, ("user_text", "paper_abstract", "pdf_text", "api_text")))
    ref = F.when(i % 3 == 0, F.concat(F.lit("paper:"), i)).when(i % 3 == 1, F.concat(F.lit("file:"), i)).otherwise(F.concat(F.lit("user_text_"), i))
    return V.read(spark, sf, "documents").select(
        i.alias("source_id"), (i % 3).alias("job_id"), F.get(types, (i % 4).cast("int")).alias("source_type"), ref.alias("source_ref"), (i % 5 != 0).alias("processed")
    )


@REG.query(f"WITH {SQL_SOURCES} SELECT job_id, count(*) AS total, count(*) FILTER (processed) AS processed, count(*) FILTER (NOT processed) AS pending FROM v_sources GROUP BY job_id")
def input_status(spark, sf):
    return I.input_status(sources(spark, sf))


@REG.query(f"WITH {SQL_SOURCES} SELECT job_id, source_id, row_number() OVER (PARTITION BY job_id ORDER BY source_id)::INTEGER AS turn FROM v_sources WHERE NOT processed")
def pending_sources(spark, sf):
    return I.pending_sources(sources(spark, sf)).select("job_id", "source_id", "turn")


@REG.query(
    f"""WITH {SQL_SOURCES} SELECT source_id, CASE WHEN source_type = 'pdf_text' THEN 'pdf' ELSE 'text' END AS adapter, source_type IN ('pdf_text', 'user_text') AS refine,
CASE WHEN source_ref LIKE 'paper:%' THEN substr(source_ref, 7)::BIGINT END AS paper_id FROM v_sources"""
)
def source_routing(spark, sf):
    s = sources(spark, sf)
    return s.select(
        "source_id", I.adapter_of(F.col("source_type"), F.col("source_ref")).alias("adapter"), I.needs_refinement(F.col("source_type")).alias("refine"), T.source_ref_id(F.col("source_ref")).alias("paper_id")
    )


@REG.query(
    f"""WITH RECURSIVE {V.SQL_TRIPLES}, {SQL_BLOCKS}, {SQL_SOURCES},
s AS (SELECT job_id, count(*) AS sources, count(*) FILTER (source_type = 'paper_abstract') AS abstracts, count(*) FILTER (source_type = 'pdf_text') AS pdfs FROM v_sources GROUP BY job_id),
b AS (SELECT job_id, count(*) AS blocks FROM v_blocks JOIN v_sources USING (source_id) GROUP BY job_id),
t AS (SELECT v_sources.job_id, count(*) AS triples FROM v_triples JOIN v_sources ON source_id = ingestion_source_id GROUP BY v_sources.job_id)
SELECT job_id, sources, abstracts, pdfs, blocks, triples, round(triples / blocks, 2)::DOUBLE AS triples_per_block FROM s JOIN b USING (job_id) JOIN t USING (job_id)""".replace("s AS (SELECT job_id, count", "sm AS (SELECT job_id, count").replace("FROM s JOIN b", "FROM sm JOIN b")
)
def pipeline_metrics(spark, sf):
    blocks = I.slice_sources(V.read(spark, sf, "documents"), "doc_id")
    return I.pipeline_metrics(sources(spark, sf), blocks, V.triples(spark, sf))
