"""Language identification by hierarchical discrimination.

A document's family is decided first, by linear support vector machines between
pairs of families; one-versus-one machines between the languages of that family then
name the language. Features are hashed character 1- to 3-grams of the whole text,
square-rooted frequencies, so every document is a unit vector. Each machine is
trained by its own Spark task on a bounded sample of labelled rows. The machines only
compare learned languages, so each language also has a profile of its sample: the mean
log-probability of a text's grams under it tells whether the text is near the language.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from .codepoints import LETTER, Chunk, chunks, class_table, lower_table

DIMS = 1 << 12
#: Training rows of a language at most.
SAMPLE_PER_LANGUAGE = 300
UNDETERMINED = "und"
#: A text is far from a language if it fits so many times as far below the median of
#: the training rows as their first percentile does.
FAR = 2.5
#: Rows' worth of every feature that a profile has beforehand.
PRIOR = 1e-3

#: Language families by ISO 639-1 code; a language that none lists is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa mr gu ne",
    "celtic": "ga gd cy br",
}


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def gram_matrix(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(features of each row, whether the row has a letter)."""
    n = c.stop - c.start
    letter = class_table()[c.cp] == LETTER
    owner = c.owner()
    has = np.bincount(owner[letter], minlength=n) > 0
    after = np.zeros(len(letter), bool)
    after[1:] = letter[:-1]
    keep = letter | after
    x = np.where(letter, lower_table()[c.cp], 32)[keep].astype(np.uint64)
    own = owner[keep]
    out = np.zeros(n * DIMS)
    code = np.zeros(len(x), np.uint64)
    for k in range(3):
        m = len(x) - k
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x1F0001) + x[k:] + np.uint64(1)
        same = own[:m] == own[k:]
        h = ((code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
        out += np.bincount(own[:m][same] * DIMS + h[same].astype(np.int64), minlength=n * DIMS)
    out = out.reshape(n, DIMS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32), has


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias of a linear SVM: squared hinge, balanced classes, accelerated gradient."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = v = np.zeros(x.shape[1])
    step = 1 / (4.0 + ridge)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * (x.T @ (weight * y * slack)) + ridge * v
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def train_profile(x: np.ndarray) -> np.ndarray:
    """Log-probability of each feature in a language, and the least mean of them near it.

    That bound comes from the training rows, each measured without itself. A single
    row has nothing to be measured by, so no text is far from it.
    """
    share = x.astype(np.float64) ** 2
    total, n = share.sum(axis=0), len(x)
    least = -np.inf
    if n > 1:
        others = np.log((np.maximum(total - share, 0) + PRIOR) / (n - 1 + PRIOR * DIMS))
        low, middle = np.quantile((share * others).sum(axis=1), (0.01, 0.5))
        least = middle - FAR * (middle - low)
    return np.append(np.log((total + PRIOR) / (n + PRIOR * DIMS)), least)


def _features(df: DataFrame) -> DataFrame:
    """(lang, features) of the sampled training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text"), rows=256):
                x, has = gram_matrix(c)
                lang = batch.column("lang").slice(c.start, c.stop - c.start).filter(pa.array(has))
                x = x[has]
                ends = pa.array(np.arange(0, len(x) * DIMS + 1, DIMS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [lang, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["lang", "x"]
                )

    return df.mapInArrow(run, "lang string, x array<float>")


def _machines(langs: list[str]) -> list[tuple[str, str, str]]:
    """(kind, one side, other side) of each machine: family pairs, then pairs within families."""
    by = {}
    for x in langs:
        by.setdefault(family_of(x), []).append(x)
    out = [("family", a, b) for a, b in itertools.combinations(sorted(by), 2)]
    for members in by.values():
        out += [("language", a, b) for a, b in itertools.combinations(sorted(members), 2)]
    return out


def fit(train: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Train all machines from rows (key, text, lang); rows without language are ignored.

    The sample of a language is its rows of least hash of key, at most
    ``sample_per_language``: a first cut by hash keeps about twice as many, so the
    window that bounds it exactly never sees a large language whole.
    """
    ship(train.sparkSession)
    known = train.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    machines = _machines(sorted(counts))
    model = {"langs": sorted(counts), "machines": {}, "profiles": {}}
    if not counts:
        return model
    parts = 1 << 20
    share = F.create_map(
        *itertools.chain.from_iterable(
            (F.lit(k), F.lit(min(parts, 1 + 2 * parts * sample_per_language // n))) for k, n in counts.items()
        )
    )
    order = F.xxhash64(F.col("key"), F.lit("language"))
    thin = known.withColumn("order", order).where(F.pmod("order", F.lit(parts)) < F.element_at(share, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(parts)), "order", F.length("text")))
    sample = _features(thin.withColumn("rank", rank).where(F.col("rank") <= sample_per_language).select("lang", "text"))

    def tasks(kind: str, label) -> DataFrame:
        rows = [(f"{k}\t{a}\t{b}", side, sign) for k, a, b in machines if k == kind for side, sign in ((a, 1), (b, -1))]
        if kind == "profile":
            rows = [(f"profile\t{lang}", lang, 1) for lang in sorted(counts)]
        if not rows:
            return None
        lookup = F.create_map(
            *itertools.chain.from_iterable(
                (
                    F.lit(side),
                    F.array(*(F.struct(F.lit(m).alias("machine"), F.lit(s).alias("y")) for m, d, s in rows if d == side)),
                )
                for side in sorted({d for _, d, _ in rows})
            )
        )
        return sample.select(F.explode(F.element_at(lookup, label)).alias("t"), "x").select("t.machine", "t.y", "x")

    families = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(family_of(x))) for x in counts))
    labels = {"family": F.element_at(families, F.col("lang")), "language": F.col("lang"), "profile": F.col("lang")}
    parts_of = [t for t in (tasks(kind, label) for kind, label in labels.items()) if t is not None]
    rows = parts_of[0]
    for more in parts_of[1:]:
        rows = rows.union(more)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, name = np.stack(pdf["x"].to_numpy()), pdf["machine"].iloc[0]
        w = train_profile(x) if name.startswith("profile\t") else train_svm(x, pdf["y"].to_numpy().astype(float))
        return pd.DataFrame({"machine": [name], "w": [w]})

    for r in rows.groupBy("machine").applyInPandas(one, "machine string, w array<double>").collect():
        kind, *names = r["machine"].split("\t")
        if kind == "profile":
            model["profiles"][names[0]] = np.array(r["w"], np.float32)
        else:
            model["machines"][(kind, *names)] = np.array(r["w"], np.float32)
    return model


def classify(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """The language of each feature row, and its score between 0 and 1."""
    langs = model["langs"]
    families = sorted({family_of(v) for v in langs})

    def vote(kind: str, names: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the winner and how clearly it beats each other name."""
        wins = np.zeros((len(at), len(names)))
        least = np.ones((len(at), len(names)))
        for i, j in itertools.combinations(range(len(names)), 2):
            w = model["machines"].get((kind, names[i], names[j]))
            if w is None:
                continue
            p = 1 / (1 + np.exp(-3.0 * (x[at] @ w[:-1] + w[-1]).astype(np.float64)))
            wins[:, i] += p
            wins[:, j] += 1 - p
            least[:, i] = np.minimum(least[:, i], p)
            least[:, j] = np.minimum(least[:, j], 1 - p)
        best = wins.argmax(axis=1)
        return best, least[np.arange(len(at)), best]

    everything = np.arange(len(x))
    fam, sure = vote("family", families, everything)
    out, score = np.empty(len(x), object), sure.copy()
    for f, name in enumerate(families):
        at = np.flatnonzero(fam == f)
        members = [v for v in langs if family_of(v) == name]
        best, clear = vote("language", members, at)
        out[at] = np.array(members, object)[best]
        score[at] *= clear
    return out.tolist(), score


def nearness(x: np.ndarray, langs: list[str], model: dict) -> np.ndarray:
    """How far each feature row fits its language better than the worst that is near it.

    Unlike the score, which only compares learned languages, it is below 0 for texts
    far from all of them.
    """
    out = np.full(len(x), -np.inf)
    named = np.array(langs, object)
    for lang, w in model["profiles"].items():
        at = np.flatnonzero(named == lang)
        out[at] = (x[at] ** 2) @ w[:-1] - w[-1]
    return out


def predict(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Append lang_pred, score and nearness to every row, from the text alone.

    Null text, text without a letter, and any text where nothing was learned get
    ``und``, 0 and minus infinity. Columns of the same names are replaced; others pass
    through.
    """
    ship(df.sparkSession)
    df = df.drop("lang_pred", "score", "nearness")
    names = df.columns
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    shared = df.sparkSession.sparkContext.broadcast(model)  # pairs of languages x DIMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for c in chunks(batch.column(names.index(text_col)), rows=256):
                x, has = gram_matrix(c)
                lang, score, near = [UNDETERMINED] * len(x), np.zeros(len(x)), np.full(len(x), -np.inf)
                if known["langs"]:
                    lang, score = classify(x, known)
                    near = nearness(x, lang, known)
                lang = [v if h else UNDETERMINED for v, h in zip(lang, has, strict=True)]
                part = batch.slice(c.start, c.stop - c.start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, near, -np.inf))],
                    names=[*names, "lang_pred", "score", "nearness"],
                )

    return df.mapInArrow(run, f"{fields}, lang_pred string, score double, nearness double")


def is_held_out(id_col: str = "doc_id"):
    """True for the fold that training never sees; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of every document, learned from the other fold.

    Whole texts, however long, one row of features each. Null texts, empty ones and those
    without a letter get ``und``. Rows without a language teach nothing; a null id is in no
    held-out fold. Repeated rows are rows of their own and get the same language, with a
    score that differs by rounding at most; ties between languages go to the first by
    name. Other columns are not read; an empty table gives no rows, and a table without a
    labelled row gives ``und`` throughout.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", is_held_out())
    model = fit(rows.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select(
        F.col("doc_id").alias(id_col), "held_out", "lang_pred", "score"
    )
