"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on hashed words, pairs of words and runs of bytes and on counts of
characters, words and lines gives each document's own evidence. Sums of that evidence by path and by host, taken with
grouped aggregation over all documents, give each site a posterior: a host's
mean is shrunk towards the global one, a path's towards its host's, the more the
fewer documents it has; how strongly is estimated from the spread between sites
(method of moments). A document's posterior odds are its own odds times the ratio
of its path's odds (without the document itself) to the global ones.

Only the regression is fitted on a bounded sample: at most ``max_train``
labelled documents, drawn by a hash of the id. Everything else covers all
documents. The table of path posteriors is broadcast while it has at most
BROADCAST_ROWS rows, and joined by a shuffle beyond that.

Labels count for rows whose id is their number. Null texts are empty; a null host or path is a site of its own; documents without
label are judged like all others; null labels and ids do not train. Without both classes
among the labels every document has even evidence and stays. Repeated rows are judged
alike. Columns other than those named are not looked at. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import col, hot_keys, row_key, salted_join, table, text_of, written
from textquarry.llm.minhash_dedup import parts
from textquarry.llm.spans import U, joined, keyed, mix, names, utf8, words

MAX_TRAIN = 8_000
BROADCAST_ROWS = 200_000
RIDGE = 1.0

#: Classes of bytes: symbols, exclamation marks, bars, digits, stops, capitals, blanks, line feeds, bytes within a character.
CLASSES = ("#*$%&<>", "!", "|", "0123456789", ".,;:?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " ", "\n", bytes(range(0x80, 0xC0)))
COUNTS = 11
#: Buckets of words and pairs of words, and of runs of GRAM bytes.
WORD_BUCKETS, BYTE_BUCKETS, GRAM = 2048, 1024, 4
BUCKETS = WORD_BUCKETS + BYTE_BUCKETS
#: Texts whose buckets are counted together.
TEXTS = 256


def byte_classes() -> np.ndarray:
    of = np.zeros(256, np.int64)
    for k, letters in enumerate(CLASSES, 1):
        of[np.frombuffer(letters if isinstance(letters, bytes) else letters.encode(), np.uint8)] = k
    return of


def unlike(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    ends = np.cumsum(per)
    return np.fromiter((len(np.unique(h[a:b])) for a, b in zip((ends - per).tolist(), ends.tolist())), np.int64, len(per))


def counts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Shares of characters, words and lines, a row for each text; all values are bounded or logarithmic, so that very long texts stay in range."""
    k, n = len(CLASSES) + 1, len(starts)
    of_text = np.repeat(np.arange(n) * k, ends - starts)
    count = np.bincount(byte_classes()[raw] + of_text, minlength=n * k).reshape(n, k).astype(float)
    chars, some = ends - starts - count[:, 9] + 1, np.maximum(per, 1)
    stops = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([starts, stops + 1]))
    end = np.sort(np.concatenate([ends, stops]))
    lines = count[:, 8].astype(np.int64) + 1
    few = lambda x: np.minimum(x, 5)
    other_lines = unlike(keyed(*names(raw, begin, end), 0), lines)
    return np.column_stack([few(count[:, j] / some) for j in range(1, 6)] + [count[:, 6] / chars, np.log1p(per) / 10, few(chars / some / 5), 1 - other_lines / lines, unlike(h, per) / some, count[:, 7] / chars])


def hashed(values: np.ndarray, of_text: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Logarithmic counts of the values' buckets, of unit length for each text that has any."""
    out = np.log1p(np.bincount(of_text * buckets + (values >> U(33)).astype(np.int64) % buckets, minlength=n * buckets).reshape(n, buckets).astype(np.float32))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-6)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows and their features: the counts, then the buckets of lower-case words, pairs of words and byte runs."""
    raw, starts, ends = utf8(texts)
    first, last, per = words(raw, starts, ends)
    h = keyed(*names(raw, first, last, lower=True), 0)
    own = counts(raw, starts, ends, keyed(*names(raw, first, last), 0), per)
    word_ends = np.cumsum(per)
    for a in range(0, len(starts), TEXTS):
        b = min(a + TEXTS, len(starts))
        n, low, high = b - a, word_ends[a] - per[a], word_ends[b - 1]
        w, of = h[low:high], np.repeat(np.arange(n), per[a:b])
        both = of[1:] == of[:-1]
        pairs = joined(w[:-1], w[1:], 0)[both]
        part = np.zeros(0, U) if starts[a] == ends[b - 1] else raw[starts[a] : ends[b - 1]].astype(U)
        of_byte = np.repeat(np.arange(n), ends[a:b] - starts[a:b])
        m = max(0, len(part) - GRAM + 1)
        grams = sum((part[j : j + m] << U(8 * j) for j in range(GRAM)), np.zeros(m, U))
        inside = of_byte[:m] == of_byte[GRAM - 1 :][:m]
        yield a, b, np.column_stack([own[a:b], hashed(np.concatenate([w, pairs]), np.concatenate([of, of[1:][both]]), n, WORD_BUCKETS), hashed(mix(grams[inside]), of_byte[:m][inside], n, BYTE_BUCKETS)])


def sampled(rows: DataFrame) -> DataFrame:
    """id, y and x (the features as 16-bit floats) of rows (id, y, text)."""

    def run(batches):
        for p in parts(batches, 2):
            for a, b, x in features(p.column(2)):
                yield pa.record_batch([p.column(0).slice(a, b - a), p.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["id", "y", "x"])

    return rows.mapInArrow(run, "id long, y double, x binary")


def with_odds(rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """The columns of rows but its last one, the text, and odds: the logarithmic odds by the text alone, zero without weights."""
    names_ = rows.columns[:-1]

    def run(batches):
        for p in parts(batches, len(names_)):
            odds = np.zeros(p.num_rows)
            for a, b, x in features(p.column(len(names_))) if weights is not None else ():
                odds[a:b] = np.clip(x @ weights[1:] + weights[0], -12, 12)
            yield pa.record_batch([*(p.column(i) for i in range(len(names_))), pa.array(odds)], [*names_, "odds"])

    return rows.mapInArrow(run, T.StructType([*rows.select(names_).schema.fields, T.StructField("odds", T.DoubleType())]))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients; weights on x as it is, the intercept first. The counts are scaled for it, within x."""
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean[:COUNTS], scale[:COUNTS] = x[:, :COUNTS].mean(0), x[:, :COUNTS].std(0) + 1e-3
    x[:, :COUNTS] = (x[:, :COUNTS] - mean[:COUNTS]) / scale[:COUNTS]
    z = x
    ridge = np.r_[1e-3, np.full(z.shape[1], RIDGE)]
    times = lambda w: z @ w[1:].astype(np.float32) + w[0]
    back = lambda r: np.r_[r.sum(), z.T @ r.astype(np.float32)]
    loss = lambda w: np.logaddexp(0, -np.where(y > 0, 1, -1) * times(w)).sum() + (ridge * w * w).sum() / 2
    w = np.zeros(z.shape[1] + 1)
    now = loss(w)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        r = -(back(p - y) + ridge * w)
        step, d, rr, first = np.zeros_like(w), r.copy(), r @ r, r @ r
        for _ in range(25):
            hd = back(p * (1 - p) * times(d)) + ridge * d
            alpha = rr / max(d @ hd, 1e-30)
            step, r = step + alpha * d, r - alpha * hd
            new = r @ r
            if new < 1e-6 * first:
                break
            d, rr = r + new / rr * d, new
        t = 1.0
        while (then := loss(w + t * step)) > now and t > 1e-3:
            t /= 2
        if then >= now - 1e-6 * abs(now):
            break
        w, now = w + t * step, then
    own = w[1:] / scale
    return np.r_[w[0] - own @ mean, own]


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights for batches (id, y, x), as bytes; none if y has fewer than two values."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.float16).reshape(b.num_rows, -1)) for b in batches if b.num_rows]
    if not found:
        return
    ids, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if len(np.unique(y)) < 2:
        return
    order = np.argsort(ids, kind="stable")
    x, place = np.empty((len(y), found[0][2].shape[1]), np.float32), np.empty_like(order)
    place[order] = np.arange(len(order))
    for part in reversed(np.split(place, np.cumsum([len(f[0]) for f in found])[:-1])):
        x[part] = found.pop()[2]
    yield pa.record_batch([pa.array([fit(x, y[order]).tobytes()], pa.binary())], ["weights"])


def train(rows: DataFrame, labels: DataFrame, label_id_col: str, label_col: str, max_train: int = MAX_TRAIN) -> np.ndarray | None:
    """Weights from rows (id, text), or None if the labels have fewer than two classes. One task fits them; only they come to the driver."""
    given = labels.select(col(label_id_col).cast("long").alias("id"), col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    chosen = given.orderBy(F.xxhash64("id"), "id", "y").limit(max_train)
    known = rows.select(F.expr("try_cast(id AS long)").alias("id"), "text").join(F.broadcast(chosen), "id")  # max_train rows at most are broadcast
    sample = sampled(known.select("id", (F.col("y") > 0).cast("double").alias("y"), "text")).limit(max_train)  # max_train rows at most, in one partition
    weights = sample.coalesce(1).mapInArrow(fitted, "weights binary").collect()
    return np.frombuffer(weights[0]["weights"]) if weights else None


def strength(means: DataFrame, center: str) -> float:
    """How many documents the prior of a level counts for, from rows (n, s) and the prior mean of each: the spread between sites against that of single documents."""
    row = means.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.expr(f"n * pow(s / n - {center}, 2)")).alias("between"), F.sum(F.expr(f"n * {center} * (1 - {center})")).alias("within")).first()
    if not row["n"]:
        return 1.0
    within = row["within"] / row["n"]
    spread = max(row["between"] / row["n"] - within * row["k"] / row["n"], 1e-6)
    return float(np.clip(within / spread - 1, 1.0, 1e6))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_id_col: str = "doc_id", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """A row for each row of df: id_col, h (row_key of the text), evidence (the document's own probability), site (its path's posterior), posterior and kept (posterior of at least one half)."""
    name = lambda c: F.struct(col(c).isNull().alias("none"), F.coalesce(col(c).cast("string"), F.lit("")).alias("name"))
    text = text_of(text_col)
    rows = df.select(col(id_col).alias("id"), row_key(text).alias("h"), name(host_col).alias("host"), name(path_col).alias("path"), text.alias("text"))
    weights = train(rows.select("id", "text"), labels, label_id_col, label_col, max_train)
    scored = written(with_odds(rows, weights), "evidence").withColumn("evidence", F.expr("1 / (1 + exp(-odds))"))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = float(np.clip(total["s"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    kappa = strength(hosts, f"{mu!r}D")
    hosts = hosts.select("host", ((F.col("s") + kappa * mu) / (F.col("n") + kappa)).alias("theta"))
    paths = written(paths.join(hosts, "host"), "paths")
    lam = strength(paths, "theta")
    posteriors = paths.select("host", "path", "n", "s", "theta")
    site = (F.col("s") - F.col("evidence") + lam * F.col("theta")) / (F.col("n") - 1 + lam)
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site))
    if posteriors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        judged = scored.join(F.broadcast(posteriors), ["host", "path"])
    else:  # a site of very many documents is dealt over several tasks
        named = lambda df: df.withColumn("name", F.to_json(F.struct("host", "path")))
        posteriors = named(posteriors).drop("host", "path")
        judged = salted_join(named(scored), posteriors, "name", hot_keys(posteriors, "name", "n"), ["id", "h"])
    judged = judged.withColumn("site", site)
    whole = F.col("odds") + F.log(F.col("site") / (1 - F.col("site"))) - float(np.log(mu / (1 - mu)))
    return judged.select(F.col("id").alias(id_col), "h", "evidence", "site", (1 / (1 + F.exp(-whole))).alias("posterior"), (whole >= 0).alias("kept"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")
