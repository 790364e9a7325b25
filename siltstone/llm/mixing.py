"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer over whole texts. A softmax regression on hashed tokens, fitted on at most `SAMPLE`
labelled documents (those with the smallest hash of their key; a fifth of them is held out to measure it), gives every document a posterior over
the sources. A document's own source weighs in as evidence that is right with `TRUST`, so a labelled document keeps to
its source but for a trace, and one without a source is spread over those its text resembles.

Each document gets a rate r between 0 and the max_repeats of its likeliest source. The rates minimise the weighted squared distance between expected
domain totals, the sum of r * tokens * posterior, and the targets, by projected gradient in the metric of the documents' sizes:
there a step moves a document's rate by its posterior times the gaps, whatever its size. The step is one over the largest eigenvalue of the
Hessian, which is one small matrix summed over all documents, so the distance falls at every step. A step is one distributed sum of as many numbers as there
are sources; a document's rate follows from the gaps so far, so no state is kept or shuffled. The steps end when
the totals move by less than `TOLERANCE` of the mixture; `converged` tells if that came within `STEPS`.

Rates become whole repeats by the hash of the key against the rate's fraction; a histogram of these quotients per source sets the
threshold so that the source's tokens meet its rates to a bin's size. A source too small for its share stays at its cap.

Defined cases: null and empty texts have no tokens and are never chosen; sources that aren't listed have target 0; a listed source
without documents stays at 0; repeated rows of one key are one document each; shares must not be negative and their sum above 0;
without labelled documents every posterior is even.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The byte-level BPE pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMS, SAMPLE, STEPS, BINS = 2048, 4000, 200, 2048
TRUST, TOLERANCE = 0.999, 1e-5


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _features(ids: list[int]) -> np.ndarray:
    """Square roots of hashed token counts, of length 1."""
    x = np.sqrt(np.bincount(np.array(ids, np.int64) % DIMS, minlength=DIMS)).astype(np.float32)
    return x / max(1e-9, float(np.linalg.norm(x)))


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 2.0, ridge: float = 1e-3) -> np.ndarray:
    """(DIMS + 1, classes) weights by gradient descent with momentum; the last row is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, v = np.zeros((x.shape[1], classes), x.dtype), np.zeros((x.shape[1], classes), x.dtype)  # one type throughout: no copies of x
    hot = np.eye(classes, dtype=x.dtype)[y]
    rate, ridge = x.dtype.type(rate), x.dtype.type(ridge)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        v = x.dtype.type(0.9) * v - rate * (x.T @ (p - hot) / x.dtype.type(len(x)) + ridge * w)
        w = w + v
    return w


def posteriors(x: np.ndarray, weights: np.ndarray | None, label: np.ndarray, classes: int) -> np.ndarray:
    """(rows, classes): the classifier's posterior with the label (-1: none) as evidence."""
    p = np.full((len(label), classes), 1 / classes)
    if weights is not None:
        z = x @ weights[:-1] + weights[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    if classes > 1:
        has = np.flatnonzero(label >= 0)
        seen = np.ones((len(label), classes))
        seen[has] = (1 - TRUST) / (classes - 1)
        seen[has, label[has]] = TRUST
        p = (p + 1e-9) * seen
    return p / p.sum(axis=1, keepdims=True)


def _measure(path: str, sources: list[str], shared):
    """Tokens of each text, its domain and its posterior; the latter two null for sources that aren't listed and for empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known, weights = load_encoding(path), {s: i for i, s in enumerate(sources)}, shared.value
        for b in batches:
            label = np.array([known.get(name, -1 if name is None else -2) for name in b.column(2).to_pylist()], np.int64)
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            tokens = np.array([len(x) for x in ids], np.int64)
            use = np.flatnonzero((label > -2) & (tokens > 0))
            x = np.stack([_features(ids[k]) for k in use]) if len(use) else np.zeros((0, DIMS), np.float32)
            post = posteriors(x, weights, label[use], len(sources))
            domain, rows = [None] * len(label), [None] * len(label)
            for k, p in zip(use, post, strict=True):
                domain[k], rows[k] = int(label[k] if label[k] >= 0 else p.argmax()), p.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(tokens), pa.array(domain, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["key", "source", "tokens", "domain", "post"]
            )

    return run


def _rates(post: np.ndarray, cap: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Rates of documents after the steps so far; history: (steps, classes)."""
    r = np.minimum(1.0, cap)
    for move in (post @ history.T).T:
        r = np.clip(r - move, 0, cap)
    return r


def _walk(caps: np.ndarray, shared, form: str):
    """'sum': expected totals by domain; 'square': the sum of tokens * post * post'; 'rate': each document's rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        total = np.zeros(len(caps) if form == "sum" else len(caps) ** 2)
        for b in batches:
            if not b.num_rows:
                continue
            post = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n = b.column(1).to_numpy().astype(float)
            if form == "square":
                total += ((post * n[:, None]).T @ post).ravel()
                continue
            r = _rates(post, caps[b.column(3).to_numpy()], history)
            if form == "rate":
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(r)], names=["key", "tokens", "post", "domain", "source", "rate"])
            else:
                total += (r * n) @ post
        if form != "rate":
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "n"])

    return run


class Mixture:
    """A mixture of `documents` towards `targets`(source, target_share, max_repeats); total_tokens defaults to the corpus' own size."""

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, total_tokens: int | None = None, most_sources: int = 10_000):
        rows = targets.filter("source is not null").limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError(f"more than {most_sources} target sources")
        self.sources = sorted({r["source"] for r in rows})
        by = {r["source"]: r for r in rows}
        share = np.array([max(0.0, by[s]["target_share"] or 0.0) for s in self.sources])
        self.caps = np.array([float(max(0, by[s]["max_repeats"] or 0)) for s in self.sources])
        if not share.sum() > 0:
            raise ValueError("the target shares sum to 0")
        self.shares = share / share.sum()
        docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
        self.spark, self._key, self._kind = documents.sparkSession, key, docs.schema["key"].dataType.simpleString()
        self.accuracy = self.majority = None
        weights = self.spark.sparkContext.broadcast(self._classifier(docs, tokenizer))
        self.sized = cut(docs.mapInArrow(_measure(tokenizer, self.sources, weights), f"key {self._kind}, source string, tokens long, domain int, post array<double>"))
        self.used = self.sized.filter("post is not null").select("key", "tokens", "post", "domain", "source")
        known = self.sized.filter("source is not null and domain is not null").groupBy("domain").agg(F.sum("tokens").alias("n")).collect()  # a row a target source
        self.available = np.zeros(len(self.sources))
        for r in known:
            self.available[r["domain"]] = r["n"]
        self.total = total_tokens or self.sized.agg(F.sum("tokens")).first()[0] or 0
        self.goal = self.shares * self.total
        self._solve()

    def _classifier(self, docs: DataFrame, tokenizer: str) -> np.ndarray | None:
        labelled = docs.filter(F.col("source").isin(self.sources) & (F.col("text") != ""))

        def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = load_encoding(tokenizer)
            for b in batches:
                x = [_features(enc.encode_ordinary(t)).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["source", "x"])

        chosen = labelled.select("key", F.xxhash64(F.lit(3), "key").alias("u")).orderBy("u", "key").limit(SAMPLE)  # bounded sample of labels
        got = labelled.join(F.broadcast(chosen), "key").select("source", "text").mapInArrow(blob, "source string, x binary").toPandas()
        if not len(got):
            return None
        x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), DIMS).astype(np.float32)
        y = np.array([self.sources.index(s) for s in got["source"]])
        held = np.arange(len(y)) % 5 == 4
        w = fit_softmax(x[~held], y[~held], len(self.sources))
        if held.any():
            self.accuracy = float(((x[held] @ w[:-1] + w[-1]).argmax(axis=1) == y[held]).mean())
            self.majority = float((y[held] == np.bincount(y[~held]).argmax()).mean())
        return w

    def _sums(self, form: str, history: np.ndarray) -> np.ndarray:
        """One distributed pass; a row a source (or pair of sources) comes back."""
        walk = _walk(self.caps, self.spark.sparkContext.broadcast(history), form)
        out = np.zeros(len(self.sources) ** (1 + (form == "square")))
        for r in self.used.mapInArrow(walk, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
            out[r["k"]] = r["n"]
        return out

    def _solve(self) -> None:
        k = len(self.sources)
        square = self._sums("square", np.zeros((0, k))).reshape(k, k)
        weight = 1 / np.maximum(square.sum(axis=1), 1.0)  # of the squared gaps: a source counts by its own size
        self.step = 1 / max(1e-12, float(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * square * np.sqrt(weight)[None, :]).max()))
        self.history, self.distances, self.converged = np.zeros((0, k)), [], False
        before = None
        while len(self.history) < STEPS and not self.converged:
            expected = self._sums("sum", self.history)
            gap = expected - self.goal
            self.distances.append(float((weight * gap**2).sum()))
            self.converged = before is not None and float(np.abs(expected - before).sum()) <= TOLERANCE * max(1, self.total)
            before = expected
            self.history = np.vstack([self.history, self.step * weight * gap])
        self.expected = before

    def chosen(self) -> DataFrame:
        """(key, source, post, domain, tokens, rate, repeats) of the documents used."""
        names = F.array(*map(F.lit, self.sources))
        u = (F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(1 << 40)) + 1) / float(1 << 40)
        walk = _walk(self.caps, self.spark.sparkContext.broadcast(self.history), "rate")
        rated = cut(self.used.mapInArrow(walk, f"key {self._kind}, tokens long, post array<double>, domain int, source string, rate double"))
        part = F.col("rate") - F.floor("rate")
        rated = rated.withColumn("part", part).withColumn("v", F.when(part > 0, u / part))
        width = 4.0 / BINS
        bins = rated.filter("v < 4").groupBy("domain", F.floor(F.col("v") / width).cast("int").alias("bin")).agg(F.sum("tokens").alias("n")).collect()  # sources x BINS rows at most
        want = np.zeros(len(self.sources))
        for r in rated.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("part")).alias("n")).collect():  # a row a source
            want[r["domain"]] = r["n"]
        counts = np.zeros((len(self.sources), BINS))
        for r in bins:
            counts[r["domain"], r["bin"]] = r["n"]
        cut_at = []
        for k in range(len(self.sources)):
            sums = np.concatenate([[0], np.cumsum(counts[k])])
            b = int(min(BINS, np.searchsorted(sums, want[k], side="right") - 1))
            inner = (want[k] - sums[b]) / counts[k][b] if b < BINS and counts[k][b] else 0.0
            cut_at.append((b + min(1.0, max(0.0, inner))) * width)
        threshold = F.element_at(F.array(*(F.lit(float(x)) for x in cut_at)), F.col("domain") + 1)
        repeats = F.floor("rate").cast("int") + F.coalesce(F.col("v") < threshold, F.lit(False)).cast("int")
        out = rated.select("key", "source", "post", F.element_at(names, F.col("domain") + 1).alias("domain"), "tokens", "rate", repeats.alias("repeats"))
        return out.filter("repeats > 0").withColumnRenamed("key", self._key)

    def mixture(self) -> DataFrame:
        """(key, source, domain, tokens, repeats) of the documents used."""
        return self.chosen().drop("post", "rate")

    def report(self) -> DataFrame:
        """One row a target source: its target, the rate of its documents and the share of the mixture's tokens reached.

        A labelled document counts to its source; one without a source to each source by its posterior, and labelled_tokens leaves it out."""
        size = F.col("tokens") * F.col("repeats")
        used = self.chosen().select("domain", "source", "post", "repeats", size.alias("size"))
        labelled = used.filter("source is not null").groupBy(F.col("domain").alias("source")).agg(
            F.count("*").alias("documents"), F.sum("size").alias("labelled_tokens"), F.max("repeats").alias("most_repeats")
        )
        soft = used.filter("source is null").select("size", F.posexplode("post").alias("k", "p")).groupBy("k").agg(F.sum(F.col("size") * F.col("p")).alias("soft"))
        rows = [(k, s, float(a), int(c), int(n), float(e)) for k, (s, a, c, n, e) in enumerate(zip(self.sources, self.shares, self.caps, self.available, self.expected, strict=True))]
        want = self.spark.createDataFrame(rows, "k int, source string, target_share double, max_repeats int, available_tokens long, expected_tokens double")
        out = want.join(labelled, "source", "left").join(soft, "k", "left").fillna(0, ["documents", "labelled_tokens", "most_repeats", "soft"])
        whole = used.agg(F.sum("size").alias("whole"))
        got = F.col("labelled_tokens") + F.col("soft")
        return out.crossJoin(F.broadcast(whole)).select(  # one row
            "source", "target_share", "max_repeats", "available_tokens", F.round("expected_tokens", 3).alias("expected_tokens"), "documents", "labelled_tokens", "most_repeats",
            F.round(F.coalesce(F.try_divide(got, F.col("whole")), F.lit(0.0)), 6).alias("share_reached"), F.round(got / F.lit(float(max(1, self.total))), 6).alias("share_of_corpus"),
            F.lit(self.converged).alias("converged"), F.lit(len(self.distances)).alias("steps"), F.lit(self.accuracy).cast("double").alias("classifier_accuracy"),
        )
