"""Quality by hierarchical empirical Bayes: document evidence combined with host and path posteriors.

A logistic model over character and shape features, fitted on a bounded sample of labelled rows, gives each document a
likelihood ratio. Grouped sums of what is known or expected about the documents of a host, and of a path on it, are
shrunk towards the level above by Beta priors whose strength is estimated from the spread between sites: a site with
few documents stays near the global rate. A document's own share is taken out of its site's sums before they become
its prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import batched, free_name, read, texts_of
from rollbook.session import table_of

#: Labelled rows that the document model is fitted on, drawn by hash of their id.
FIT_ROWS = 4000
#: Least posterior of a document that stays.
THRESHOLD = 0.5
#: Rates of sites are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
PAIRS = 512
#: A site of over 1/HOT of all documents is broadcast where others are joined by a shuffle.
HOT = 512


# ---------------------------------------------------------------- document evidence


def features(text: str) -> np.ndarray:
    """Shares of character classes and pairs, word statistics and repetition of a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    m = max(1, len(words))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, spaces = counts[48:58].sum(), counts[32] + counts[9] + counts[10] + counts[13]
    wide = counts[128:].sum()
    lines = text.split("\n")
    dense = [
        np.log1p(n) / 10, np.log1p(m) / 8, upper / n, upper / max(1, upper + lower), digits / n, spaces / n, wide / n,
        (n - upper - lower - digits - spaces - wide) / n, len(set(words)) / m, np.log1p(m / max(1, len(set(words)))),
        min(3.0, n / m / 5), counts[33] / m, counts[46] / m, counts[44] / m, counts[10] / m, len(set(lines)) / len(lines),
        sum(map(str.isalpha, words)) / m, sum(map(str.isupper, words)) / m, float(not words),
    ]
    pairs = np.bincount((raw[:-1].astype(np.int64) * 31 + raw[1:]) % PAIRS, minlength=PAIRS)
    return np.concatenate([np.array(dense), np.sqrt(pairs / n)]).astype(np.float32)


class DocumentModel:
    """Logistic regression on standardised features; log_ratio is the evidence without the prior."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return np.clip(z - np.log(self.prior / (1 - self.prior)), -12, 12)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 25) -> DocumentModel:
    """Newton steps on the penalised likelihood; with one class only, no evidence at all."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    width = x.shape[1] if x.ndim == 2 else PAIRS + 19
    if len(y) < 2 or y.min() == y.max():
        return DocumentModel(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    a = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), penalty * len(y))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return DocumentModel(mean, scale, w[:-1], float(w[-1]), prior)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DocumentModel:
    """The document model from at most fit_rows labelled rows (those of least hashed id)."""
    ids = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"))
    rows = rows.join(F.broadcast(ids), "_id")  # fit_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tobytes() for t in texts_of(b, "_text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(2), pa.array(x, pa.binary())], names=["_id", "_y", "_h", "x"])

    # of rows of one id the text of least hash speaks, so that a table has one model
    got = rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _y int, _h long, x binary")
    got = got.groupBy("_id").agg(F.max("_y").alias("_y"), F.min_by("x", "_h").alias("x")).limit(fit_rows).collect()
    got.sort(key=lambda r: str(r[0]))
    x = np.array([np.frombuffer(r[2], np.float32) for r in got])
    return fit(x, np.array([r[1] for r in got], float))


def with_evidence(docs: DataFrame, model: DocumentModel, text_col: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and _llr, the log likelihood ratio of the whole text (null: empty)."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + ["_llr double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in texts_of(b, "_text")])
            llr = model.log_ratio(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(llr, pa.float64())], names=[*b.schema.names[:-1], "_llr"])

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- site posteriors


def _logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def _strength(sites: DataFrame, rate: Column) -> float:
    """How many documents a prior is worth, by the moments of the site rates k / n around `rate`; one global aggregate."""
    r = sites.where("n >= 1").agg(
        F.sum(F.col("n") * (F.expr("k / n") - rate) * (F.expr("k / n") - rate)).alias("between"), F.sum(rate * (F.lit(1.0) - rate)).alias("within"),
        F.sum(F.col("n") * rate * (F.lit(1.0) - rate)).alias("total"), F.count(F.lit(1)).alias("sites"),
    ).first()
    if not r["sites"] or not r["total"]:
        return 10.0
    # E[n (k/n - r)^2] = r (1 - r) (1 + (n - 1) / (m + 1)) for a Beta prior worth m documents
    over = max(0.0, r["between"] - r["within"])
    spread = max(1e-9, r["total"] - r["within"])
    rho = min(0.999, max(1e-3, over / spread))
    return 1 / rho - 1


def _by_site(rows: DataFrame, sites: DataFrame, keys: list[str], size: str, broadcast_rows: int) -> DataFrame:
    """rows with the columns of their site; each row has one. Many sites are joined by a shuffle, of which the sites of over
    1/HOT of `size` (fewer than HOT) are left out: these are broadcast to their rows."""
    small = sites.limit(broadcast_rows + 1).count() <= broadcast_rows
    right = sites.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in sites.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    mine = [f"_{k}" for k in keys]
    if small:
        return rows.join(F.broadcast(right), on, "left").drop(*mine)
    is_hot = F.col(size) * HOT > F.lit(float(right.agg(F.sum(size)).first()[0]))
    hot = F.broadcast(right.where(is_hot).limit(HOT))
    settled = rows.join(hot, on).drop(*mine)
    rest = rows.join(hot, on, "left_anti").join(right.where(~is_hot), on, "left").drop(*mine)
    return settled.unionByName(rest)


def site_posteriors(rows: DataFrame, prior: float, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows (_host, _path, _llr, _y or null) with host_rate, path_rate and posterior."""
    known = F.coalesce(F.col("_y").cast("double"), F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_llr") + F.lit(float(np.log(prior / (1 - prior))))))))
    rows = rows.withColumn("_e", known)
    paths = table_of(rows.groupBy("_host", "_path").agg(F.sum("_e").alias("k"), F.count(F.lit(1)).cast("double").alias("n")), "paths")
    hosts = table_of(paths.groupBy("_host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "hosts")
    total = hosts.agg(F.sum("k"), F.sum("n")).first()
    rate = min(0.999, max(0.001, total[0] / total[1])) if total[1] else prior
    m_host = _strength(hosts, F.lit(rate))
    host_of = hosts.select("_host", F.col("k").alias("_hk"), F.col("n").alias("_hn"))
    both = _by_site(paths, host_of, ["_host"], "_hn", broadcast_rows)
    shrunk = F.least(F.lit(0.999), F.greatest(F.lit(0.001), (F.col("_hk") + F.lit(m_host * rate)) / (F.col("_hn") + F.lit(m_host))))
    m_path = _strength(both, shrunk)
    # without the row's own share: another row's label or estimate never counts twice
    host_rate = (F.col("_hk") - F.col("_e") + F.lit(m_host * rate)) / (F.col("_hn") - F.lit(1.0) + F.lit(m_host))
    path_rate = (F.col("k") - F.col("_e") + F.lit(m_path) * F.col("host_rate")) / (F.col("n") - F.lit(1.0) + F.lit(m_path))
    out = _by_site(rows, both, ["_host", "_path"], "n", broadcast_rows).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    held = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("path_rate")))
    return out.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_llr") + _logit(held))))).drop("k", "n", "_hk", "_hn", "_e")


def site_columns(source: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, or of a plain source name, whose only path is empty."""
    s = F.lower(F.coalesce(source, F.lit("")))
    is_url = s.contains("://")
    host = F.when(is_url, F.regexp_extract(s, r"://(?:[^/@]*@)?([^/:?#]*)", 1)).otherwise(s)
    return host, F.when(is_url, F.regexp_extract(s, r"://[^/]*/([^/?#]*)", 1)).otherwise(F.lit(""))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None,
    label_col: str = "quality", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, keep_columns: bool = False,
) -> DataFrame:
    """One row per input row: id_col, host, path, evidence, host_rate, path_rate, posterior, kept.

    With keep_columns the rows of docs that are kept, with their own columns only. evidence is the log likelihood ratio
    of the whole text; a label informs the site's rates, never its own row. Null and empty texts have features of zero;
    a null source is the host ''; very long texts are read whole. Repeated rows count each; of rows of one labelled id the
    model sees one, and of several labels the largest. Without labels, or labels of one class, nothing is known of
    documents and the rates decide. A posterior equal to the threshold is kept. Extra columns are ignored, or kept as they
    are with keep_columns. An empty table gives an empty one.
    """
    batched(docs.sparkSession)
    model = fitted(docs, labels, id_col, text_col, label_col, fit_rows)
    by_default = site_columns(F.col("source")) if "source" in docs.columns else (F.lit(""), F.lit(""))
    host, path = by_default[0] if host is None else host, by_default[1] if path is None else path
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))

    def known(rows: DataFrame) -> DataFrame:
        return rows.join(y, F.col("_id") == F.col("_lid"), "left").drop("_lid")

    sites = docs.withColumns({"_id": F.col(id_col), "_host": host, "_path": path})
    slim = table_of(known(with_evidence(sites, model, text_col, ["_id", "_host", "_path"])), "evidence")
    scored = site_posteriors(slim, model.prior)
    if not keep_columns:
        return scored.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_llr").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))
    good = scored.groupBy("_id").agg(F.max("posterior").alias("_p")).where(F.col("_p") >= threshold)
    name = free_name("_good", docs.columns)
    good = good.select(F.col("_id").alias(name))
    return docs.join(good.hint("merge"), docs[id_col].eqNullSafe(good[name]), "left_semi")  # ids grow with the documents: never broadcast


def lang_path(docs: DataFrame) -> Column:
    """The section of a source: its URL path, and the language where there is a column of it."""
    path = site_columns(F.col("source"))[1]
    return F.concat_ws("/", path, F.coalesce(F.col("lang"), F.lit(""))) if "lang" in docs.columns else path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, read(spark, sf_dir, "labels"), path=lang_path(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their own columns, whatever their names.

    Rows of one id, a null one as well, are judged by the best of them: all stay or go. Null and empty texts are judged by
    their site alone; very long texts are read whole; repeated rows stay repeated; an empty table gives an empty one.
    """
    return classify(docs, read(spark, sf_dir, "labels"), path=lang_path(docs), keep_columns=True)


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
