"""Quality classifier by hierarchical empirical Bayes.

A logistic model over whole-text statistics gives each document its own evidence.
Soft counts of that evidence are summed by path and by host; a path's rate shrinks
towards its host's, a host's towards the global rate, by prior strengths estimated
from how much groups differ. A document's posterior odds are its own odds times the
odds of its path relative to the global odds, with its own count taken out first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .codepoints import LETTER, NUMBER, SPACE, Chunk, chunks, class_table, lower_table, runs, span_hashes

#: Labelled rows used for training at most.
TRAIN_ROWS = 20_000
#: Documents whose posterior of being good is below this are rejected.
THRESHOLD = 0.3

_UPPER, _PUNCT, _SYMBOL = 1, 2, 3


@cache
def _kind_table() -> np.ndarray:
    def kind(i: int) -> int:
        c = unicodedata.category(chr(i))
        return _UPPER if c == "Lu" else _PUNCT if c[0] == "P" else _SYMBOL if c[0] == "S" else 0

    return np.fromiter(map(kind, range(0x110000)), np.uint8, 0x110000)


def text_features(c: Chunk) -> np.ndarray:
    """Statistics of each whole text of a chunk (rows x features)."""
    n = c.stop - c.start
    owner = c.owner()
    kind, more = class_table()[c.cp], _kind_table()[c.cp]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n).astype(float)

    def distinct(start: np.ndarray, stop: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans and distinct spans of each row."""
        row = owner[start] if len(start) else np.empty(0, np.int64)
        h = span_hashes(cp, start, stop) ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, at = np.unique(h, return_index=True)
        return np.bincount(row, minlength=n).astype(float), np.bincount(row[at], minlength=n).astype(float)

    low = lower_table()[c.cp]
    start, stop = runs((kind == LETTER) | (kind == NUMBER), c.off)
    words, kinds_of_words = distinct(start, stop, low)
    lines, kinds_of_lines = distinct(*runs(c.cp != 10, c.off), c.cp)
    w_letters = np.bincount(owner[start], weights=stop - start, minlength=n) if len(start) else np.zeros(n)
    chars = c.lengths.astype(float)
    letters = count(kind == LETTER)
    some, some_words = np.maximum(chars, 1), np.maximum(words, 1)
    columns = [
        np.log1p(words),
        count(more == _UPPER) / np.maximum(letters, 1),
        letters / some,
        count(kind == NUMBER) / some,
        count(kind == SPACE) / some,
        np.log1p(20 * count(more == _PUNCT) / some_words),
        np.log1p(20 * count(more == _SYMBOL) / some_words),
        np.log1p(20 * count(c.cp == ord("!")) / some_words),
        np.log1p(20 * count((c.cp == ord("|")) | (c.cp == ord("\t"))) / some_words),
        np.log1p(20 * count(c.cp == ord(".")) / some_words),
        kinds_of_words / some_words,
        kinds_of_lines / np.maximum(lines, 1),
        w_letters / some_words / 10,
    ]
    x = np.column_stack(columns)
    return np.hstack([x, x * x])


FEATURES = 26


def _with_features(df: DataFrame, text_col: str) -> DataFrame:
    names = df.columns
    i = names.index(text_col)
    others = [k for k in range(len(names)) if k != i]
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(i)):
                x = text_features(c)
                ends = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
                part = batch.slice(c.start, c.stop - c.start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in others), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                    names=[*(names[k] for k in others), "x"],
                )

    return df.mapInArrow(run, f"{fields}, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> dict:
    """Ridge logistic regression by Newton steps on standardised features."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    pull = ridge * len(z) * np.append(np.ones(x.shape[1]), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull * w
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull + 1e-9)
        move = np.linalg.solve(hess, grad)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return {"mean": mean, "std": std, "w": w}


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> dict | None:
    """The document model from at most about ``rows`` labelled documents of least hash of id.

    Without labels of both kinds there is no model: every document then counts as undecided.
    """
    marked = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y")).where(
        "k is not null and y in (0, 1)"
    )
    marked = marked.groupBy("k").agg(F.max("y").alias("y"))  # ids labelled twice count once, as good
    n = marked.count()
    parts = 1 << 40  # so that the share of ``rows`` in n labels is more than 0 for any n
    marked = marked.where(F.pmod(F.xxhash64(F.col("k"), F.lit("quality")), F.lit(parts)) < parts * rows // max(n, 1))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
    # The kept ids are few (``rows`` of 8 bytes), so they go to the texts rather than the texts to them.
    # Of the texts of one id, that of least hash counts.
    one = texts.join(F.broadcast(marked), "k").groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    got = _with_features(one.select("y", "t.text"), "text").toPandas()
    if got["y"].nunique() < 2:
        return None
    return fit_logistic(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def with_evidence(df: DataFrame, model: dict | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Append p_doc, the document model's probability of good text (0.5 without a model or words)."""
    names = df.columns
    i = names.index(text_col)
    out = [k for k in range(len(names)) if keep_text or k != i]
    fields = ", ".join(f"`{df.schema[k].name}` {df.schema[k].dataType.simpleString()}" for k in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(i)):
                x = text_features(c)
                p = np.full(len(x), 0.5)
                if model is not None:
                    z = ((x - model["mean"]) / model["std"]) @ model["w"][:-1] + model["w"][-1]
                    p = np.where(x[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -12, 12))), 0.5)
                part = batch.slice(c.start, c.stop - c.start)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in out), pa.array(p)], names=[*(names[k] for k in out), "p_doc"])

    return df.mapInArrow(run, f"{fields}, p_doc double")


def strength(groups: DataFrame, n: str, s: str, rate: float) -> float:
    """Prior strength (pseudo-documents) of a level, by moments: groups that differ little shrink much.

    groups has one row a group with its size and sum; three sums reach the driver.
    """
    mean = F.col(s) / F.col(n)
    row = groups.agg(
        F.count("*").alias("k"),
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * (mean - rate) * (mean - rate)).alias("q"),
        F.sum(F.col(n) * F.col(n)).alias("n2"),
    ).first()
    if not row["k"] or row["k"] < 2 or row["n"] <= 0:
        return 10.0
    noise = max(rate * (1 - rate), 1e-6)
    spread = (row["q"] - (row["k"] - 1) * noise) / max(row["n"] - row["n2"] / row["n"], 1e-9)
    return float(min(max(noise / max(spread, noise / 1000) - 1, 1.0), 1000.0))


def site_rates(evidence: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    """One row a path (host, path, n, s, host_n, host_s) and the global rate with both prior strengths.

    evidence has host, path and p_doc; hot hosts are summed where they lie before the shuffle.
    """
    paths = scratch.write(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")))
    hosts = scratch.write(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = min(max((total["s"] or 0.0) / max(total["n"] or 0, 1), 0.01), 0.99) if total["n"] else 0.5
    prior = {"rate": rate, "host": strength(hosts, "host_n", "host_s", rate), "path": strength(paths, "n", "s", rate)}
    return scratch.write(paths.join(hosts, "host")), prior


def posterior(prior: dict) -> dict[str, Column]:
    """host_rate, path_rate and score of a row with p_doc, n, s, host_n and host_s, its own count taken out."""
    own = F.col("p_doc")
    host = (F.col("host_s") - own + prior["host"] * prior["rate"]) / (F.col("host_n") - 1 + prior["host"])
    path = (F.col("s") - own + prior["path"] * host) / (F.col("n") - 1 + prior["path"])

    def logit(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    odds = logit(own) + logit(path) - logit(F.lit(prior["rate"]))
    return {"host_rate": host, "path_rate": path, "score": 1 / (1 + F.exp(-odds))}


def score_documents(
    df: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    keep_text: bool = True,
) -> DataFrame:
    """Append p_doc, host_rate, path_rate, score and keep (score >= threshold) to every row.

    Whole texts. Null text is empty; texts without words have p_doc 0.5. Null hosts
    form one host, null paths one path a host. Repeated rows each count and each come
    back. Columns of the appended names are replaced. An empty table gives no rows.
    Texts are looked at once: rows with their evidence are written, then summed by
    site and joined with the sums.
    """
    scratch = Scratch(df.sparkSession, "quality")
    model = fit(df, labels, id_col, text_col, label_col)
    df = df.drop("p_doc", "host_rate", "path_rate", "score", "keep")
    names = df.columns
    sited = df.withColumn("_host", F.coalesce(host.cast("string"), F.lit(""))).withColumn("_path", F.coalesce(path.cast("string"), F.lit("")))
    clash = {c: f"_doc_{c}" for c in ("n", "s", "host_n", "host_s") if c in names}
    evidence = scratch.write(with_evidence(sited.withColumnsRenamed(clash), model, text_col, keep_text))
    sites, prior = site_rates(evidence.select(F.col("_host").alias("host"), F.col("_path").alias("path"), "p_doc"), scratch)
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "host_n", "host_s")
    out = evidence.join(sites, ["_host", "_path"]).withColumns(posterior(prior)).withColumn("keep", F.col("score") >= threshold).drop(*sites.columns)
    kept = [c for c in names if keep_text or c != text_col]
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*kept, "p_doc", "host_rate", "path_rate", "score", "keep")
