"""Papers, searches and the evidence ledger: duplicates, guards, impact, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from . import evidence as E
from .reason import is_promising

RECORD = (
    "struct<title: string, abstract: string, authors: array<struct<name: string>>, year: int, venue: string, "
    "externalIds: map<string, string>, openAccessPdf: struct<url: string>>"
)


def paper_record(raw: Column, source: str = "search") -> Column:
    """A search service's JSON record as a paper: blank links are null, missing titles and names filled in."""
    r = F.from_json(raw, RECORD)
    url = r["openAccessPdf"]["url"]
    return F.struct(
        F.coalesce(r["title"], F.lit("Untitled")).alias("title"),
        r["abstract"].alias("abstract"),
        F.transform(F.coalesce(r["authors"], F.array()), lambda a: F.coalesce(a["name"], F.lit("Unknown"))).alias("authors"),
        r["year"].alias("year"),
        r["venue"].alias("venue"),
        F.element_at(r["externalIds"], "DOI").alias("doi"),
        F.coalesce(r["externalIds"], F.create_map().cast("map<string, string>")).alias("external_ids"),
        F.lit(source).alias("source"),
        F.when(F.trim(url) != "", url).alias("pdf_url"),
    )


def download_name(impact: Column, paper_id: Column, title: Column) -> Column:
    """<impact>_<paper>_<first 30 characters of the title, others than letters and digits as _>.pdf"""
    safe = F.regexp_replace(F.substring(title, 1, 30), r"[^\p{L}\p{N}]", "_")
    return F.concat_ws("_", impact.cast("int").cast("string"), paper_id.cast("string"), F.concat(safe, F.lit(".pdf")))


def by_doi(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, match): the least known paper of the same DOI, any case."""
    key = F.lower(F.trim("doi"))
    known = papers.where(F.trim("doi") != "").groupBy(key.alias("k")).agg(F.min("paper_id").alias("match"))
    return candidates.where(F.trim("doi") != "").withColumn("k", key).join(known, "k").select("paper_id", "match")


def by_external_id(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, match): the least known paper that shares any (type, value) id, any case; blank ids are none."""

    def ids(df: DataFrame) -> DataFrame:
        e = df.select("paper_id", F.explode("external_ids").alias("t", "v")).where("trim(v) <> ''")
        return e.select("paper_id", F.lower("t").alias("t"), F.lower(F.trim("v")).alias("v"))

    known = ids(papers).groupBy("t", "v").agg(F.min("paper_id").alias("match"))
    return ids(candidates).join(known, ["t", "v"]).groupBy("paper_id").agg(F.min("match").alias("match"))


#: Places of a fingerprint.
FINGERPRINT_CHARS = 64


def by_fingerprint(candidates: DataFrame, papers: DataFrame, similarity: float | None = None) -> DataFrame:
    """(paper_id, match): the least known paper whose fingerprint is alike enough.

    Unrelated digests differ in about fifteen of sixteen places, so a similarity of
    0.95 holds for equal ones only and without a threshold the join is an equality. With
    one it is exact for any: fingerprints that differ in at most d places agree in one
    of d + 1 stretches, on which they are joined before their distance is taken.
    """
    seen = papers.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("paper_id").alias("match"))
    most = 0 if similarity is None else int((1 - similarity) * 4 * FINGERPRINT_CHARS + 1e-9)
    if most == 0:
        return candidates.join(seen, "fingerprint").select("paper_id", "match")
    mine = candidates.where("fingerprint <> ''")
    if most >= FINGERPRINT_CHARS:
        # No two are further apart than that.
        return mine.crossJoin(F.broadcast(seen.agg(F.min("match").alias("match")))).where("match is not null").select("paper_id", "match")
    cuts = [k * FINGERPRINT_CHARS // (most + 1) for k in range(most + 2)]
    parts = F.array(*(F.substring("fingerprint", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)))

    def stretches(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*more, "fingerprint", F.posexplode(parts).alias("place", "part"))

    met = stretches(mine, "paper_id").join(stretches(seen, "match").withColumnRenamed("fingerprint", "_f"), ["place", "part"])
    near = met.where(T.fingerprint_similarity(F.col("fingerprint"), F.col("_f")) >= similarity)
    return near.groupBy("paper_id").agg(F.min("match").alias("match"))


def find_duplicates(candidates: DataFrame, papers: DataFrame, similarity: float | None = None) -> DataFrame:
    """Each candidate with match, match_type and confidence of the first test that finds a known paper."""
    d = by_doi(candidates, papers).withColumnRenamed("match", "_d")
    e = by_external_id(candidates, papers).withColumnRenamed("match", "_e")
    f = by_fingerprint(candidates, papers, similarity).withColumnRenamed("match", "_f")
    out = candidates.join(d, "paper_id", "left").join(e, "paper_id", "left").join(f, "paper_id", "left")
    kind = F.when(F.col("_d").isNotNull(), "doi").when(F.col("_e").isNotNull(), "external_id").when(F.col("_f").isNotNull(), "fingerprint")
    sure = F.when(kind == "doi", 1.0).when(kind == "external_id", 0.95).when(kind == "fingerprint", 0.9)
    return out.withColumns({"match": F.coalesce("_d", "_e", "_f"), "match_type": kind, "match_confidence": sure}).drop("_d", "_e", "_f")


def not_in_ledger(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Papers of a job that its ledger lacks."""
    return found.join(ledger, ["job_id", "paper_id"], "left_anti")


def new_sources(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """(job_id, source_ref, text) of abstracts that are no source of the job yet; null abstracts are skipped."""
    refs = papers.where("abstract is not null").select("job_id", F.concat(F.lit("paper:"), "paper_id").alias("source_ref"), F.col("abstract").alias("text"))
    return refs.join(sources, ["job_id", "source_ref"], "left_anti")


def search_texts(hypotheses: DataFrame, focus_areas: Sequence[str] = ()) -> DataFrame:
    """(job_id, signature, query_text) of the searches for hypotheses, narrowed by the job's focus areas."""
    focus = F.array(*map(F.lit, focus_areas)).cast("array<string>")
    s, t = F.col("source"), F.col("target")
    return hypotheses.select("job_id", T.hypothesis_signature(s, t).alias("signature"), T.query_text(s, t, focus).alias("query_text")).distinct()


def missing_queries(wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """Wanted searches (job_id, signature, query_text) whose signature the job has not used, once each."""
    return wanted.dropDuplicates(["job_id", "signature"]).join(queries, ["job_id", "signature"], "left_anti").withColumn("status", F.lit("new"))


def next_verification(questions: DataFrame, queries: DataFrame) -> DataFrame:
    """(job_id, level, entities, entities_hash): the first of [A, C], [A], [C] not searched or still new.

    questions: job_id, source, target; queries: job_id, entities_hash, status.
    """
    options = F.array(F.array("source", "target"), F.array("source"), F.array("target"))
    o = questions.select("job_id", F.posexplode(options).alias("level", "entities")).withColumn("entities_hash", T.entities_hash(F.col("entities")))
    done = queries.where("status <> 'new'").select("job_id", "entities_hash").distinct()
    return o.join(done, ["job_id", "entities_hash"], "left_anti").groupBy("job_id").agg(F.min(F.struct("level", "entities", "entities_hash")).alias("x")).select("job_id", "x.*")


def impact_scores(ledger: DataFrame, hypotheses: DataFrame, edges: DataFrame, blocks: DataFrame, triples: DataFrame, sources: DataFrame) -> DataFrame:
    """Each ledger paper with references, summed confidence, distinct impactful entities and their sum.

    Only passed and promising hypotheses count, and only through ``paper:`` sources. A
    paper counts once a hypothesis, however many of its triples support it. edges and
    blocks: those the hypotheses were found in; triples: all.
    """
    papers = sources.select("source_id", T.source_ref_id(F.col("source_ref")).alias("paper_id")).where("paper_id is not null")
    use = hypotheses.where(F.col("passed_filter") | is_promising(F.col("passed_filter"), F.col("filter_reason")))
    hops = E.hops_of(use.withColumn("p", F.array_join("path", " > ")), "p", "confidence")
    of_pair = E.sources_of_pairs(hops.select("subject", "object").distinct(), edges, blocks).join(papers, "source_id")
    credit = (
        hops.join(of_pair.select("subject", "object", "paper_id").distinct(), ["subject", "object"])
        .select("p", "confidence", "paper_id")
        .distinct()
        .groupBy("paper_id")
        .agg(F.count("*").alias("hypo_ref_count"), F.sum("confidence").cast("double").alias("cumulative_conf"))
    )
    density = (
        triples.select(F.col("ingestion_source_id").alias("source_id"), F.explode(F.array("subject", "object")).alias("node"))
        .where(T.is_impactful(F.col("node")))
        .join(papers, "source_id")
        .groupBy("paper_id")
        .agg(F.countDistinct("node").alias("entity_density"))
    )
    out = ledger.join(credit, "paper_id", "left").join(density, "paper_id", "left").fillna(0, ["hypo_ref_count", "cumulative_conf", "entity_density"])
    return out.withColumn("impact_score", F.col("hypo_ref_count") + F.col("cumulative_conf") + F.col("entity_density"))


def next_downloads(ledger: DataFrame, n: int = 1) -> DataFrame:
    return ledger.where(~F.col("evaluated")).orderBy(F.desc("impact_score"), "paper_id").limit(n)


def paper_metrics(ledger: DataFrame) -> DataFrame:
    """Per job: papers, contributing, not downloaded, and the range of impact of evaluated ones."""
    e = F.col("evaluated")
    low, high = F.min(F.when(e, F.col("impact_score"))), F.max(F.when(e, F.col("impact_score")))
    return ledger.groupBy("job_id").agg(
        F.count("*").alias("papers"), F.count_if(e).alias("contributing"), F.count_if(~e).alias("undownloaded"),
        F.format_string("%.2f-%.2f", low, high).alias("impact_range"),
    )


def evidence_text(hypotheses: DataFrame, edges: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct texts (block_id, block_text) of the blocks that hold evidence along the given hypotheses' paths."""
    ends = E.hops_of(hypotheses).select("subject", "object").distinct()
    hit = E.of_pairs(ends, edges, blocks).select("block_id").distinct()
    return texts.join(hit, "block_id", "left_semi").select("block_text").distinct()


def valid_domain(answer: Column, allowed: Sequence[str] = P.ALLOWED_DOMAINS) -> Column:
    """The allowed domain that a trimmed answer names, any case (the first, if two differ in case only); else null."""
    out = F.lit(None).cast("string")
    for d in reversed(allowed):
        out = F.when(F.lower(F.trim(answer)) == d.lower(), d).otherwise(out)
    return out


def resolve_domains(pairs: DataFrame, job_domain: str | None, known: DataFrame, answers: DataFrame, allowed: Sequence[str] = P.ALLOWED_DOMAINS) -> DataFrame:
    """Domain of each (source, target): the job's, else the active snapshot's, else the provider's valid answer."""
    k = known.groupBy("source", "target").agg(F.min("domain").alias("_k"))
    a = answers.select("source", "target", valid_domain(F.col("answer"), allowed).alias("_a"))
    out = pairs.distinct().join(k, ["source", "target"], "left").join(a, ["source", "target"], "left")
    return out.withColumn("domain", F.coalesce(F.lit(job_domain), "_k", "_a")).drop("_k", "_a")
