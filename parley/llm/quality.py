"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent."""

from __future__ import annotations

import io
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import mixed, per_process, picked
from parley.session import written_once

WORD_BUCKETS, GRAM_BUCKETS, SIZES = 1 << 16, 1 << 16, (2, 3, 4)
# The one feature that every document has: it carries what is true of any text, and of an empty one.
END = WORD_BUCKETS + GRAM_BUCKETS
# The word bigram whose second word refers back to the first: it means the same with any word.
AGAIN = END + 1
BUCKETS = AGAIN + 1


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, bucket)`` pairs: of every word its own bucket and those of the byte n-grams of ``<word>``.

    A word of ``n`` bytes has ``3 n + 1`` features.
    """
    owner = [np.arange(len(words))]
    bucket = [np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_BUCKETS for w in words), np.int64, len(words))]
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), lengths)
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + data[k : len(data) - n + 1 + k]
        inside = of[: len(h)] == of[n - 1 :]
        owner.append(of[: len(h)][inside])
        bucket.append((WORD_BUCKETS + (mixed(h[inside]) % np.uint64(GRAM_BUCKETS)).astype(np.int64)))
    return np.concatenate(owner), np.concatenate(bucket)


def repeats(words: list[bytes]) -> int:
    return sum(map(eq, words, words[1:]))


def document_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct buckets and the share of its features in each."""
    buckets = [np.array([END]), np.full(repeats(words), AGAIN)]
    for at in range(0, len(words), 20_000):
        buckets.append(word_features(words[at : at + 20_000])[1])
    found, counts = np.unique(np.concatenate(buckets), return_counts=True)
    return found.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def trained(texts: list[str], labels: list[int], dim: int, epochs: int, rate: float, seed: int = 1) -> np.ndarray:
    """Embeddings of the buckets with the two rows of output weights below them.

    A document is the mean of its features' vectors; softmax over the two classes; one step per
    document, in a new order each epoch, with a rate that falls to nothing.
    """
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    out = (draw.standard_normal((2, dim)) * 0.1).astype(np.float32)
    docs = [document_features(t.encode().split()) for t in texts]
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in draw.permutation(len(docs)):
            index, share = docs[k]
            now = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[index]
            logits = out @ hidden
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            back = error @ out
            out -= np.float32(now * 0.1) * np.outer(error, hidden)
            # Shares are small: the rate of the vectors is that of one feature alone.
            vectors[index] -= np.float32(now) * np.outer(share, back) / np.float32(np.sqrt(share @ share))
    return np.vstack([vectors, out])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows that are not held out, chosen by the hash of their id."""
    labels = picked(labels, key="doc_id", quality="quality").where("key is not null and quality in (0, 1)")
    # Ids that are marked both ways take no part.
    labels = labels.where(~held_out(F.col("key"))).groupBy("key").agg(F.min("quality").alias("low"), F.max("quality").alias("y"))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = labels.where("low = y").join(docs.select(F.col("doc_id").alias("key")), "key", "left_semi")
    chosen = written_once(chosen.orderBy(*order).limit(most).select("key", "y"), "labelled")
    # A bounded table: at most ``most`` ids.
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("key")).select("key", "text", "y")
    return found.orderBy(*order).limit(most)


def train_classifier(
    docs: DataFrame, labels: DataFrame, most: int = 3000, dim: int = 8, epochs: int = 8, rate: float = 2.0
) -> np.ndarray:
    """The model, trained in one task on at most ``most`` documents; a few megabytes whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"key": [], "text": [], "y": []})])
        model = trained([t or "" for t in rows["text"]], rows["y"].astype(int).tolist(), dim, epochs, rate)
        file = io.BytesIO()
        np.save(file, model)
        yield pd.DataFrame({"model": [file.getvalue()]})

    rows = training_rows(docs, labels, most).coalesce(1)
    data = rows.mapInPandas(run, "model binary").first()
    return np.load(io.BytesIO(bytes(data["model"]))) if data else trained([], [], dim, epochs, rate)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 3000,
) -> DataFrame:
    """``row`` (the input row), ``doc_id, held_out, score, predicted`` for every row.

    The model learns only from labelled rows whose id is not held out (crc32 of the id as text, modulo
    5, is not 0), at most ``most`` of them, and sees nothing of them but the text. The score is the
    softmax output for label 1 of the whole text. A null text is an empty one, which has the score of
    the feature that all documents share; a null id is held out; without any usable label every score
    comes from the untrained start; an empty table gives no rows. Other columns pass through in ``row``.
    """
    names = docs.columns
    source = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = F.coalesce(source[f"c{names.index(text_col)}"], F.lit(""))
    doc_id = source[f"c{names.index(id_col)}"]
    model = train_classifier(source.select(doc_id.alias("doc_id"), text.alias("text")), labels, most)
    # The output is linear in the features: one number per bucket says it all.
    weights = model[:-2] @ (model[-1] - model[-2])
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    name = xxhash.xxh3_64_hexdigest(weights.tobytes())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values = per_process(("quality", name), lambda: WordValues(shared.value))
        for texts in batches:
            yield pd.Series([s for at in range(0, len(texts), 500) for s in values.scores(texts.iloc[at : at + 500])], dtype=float)

    scored = source.withColumn("score", score(text))
    return scored.select(
        F.struct(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)]).alias("row"),
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


class WordValues(dict):
    """The sum of a word's feature weights, remembered up to ``most`` words."""

    def __init__(self, weights: np.ndarray, most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most

    def scores(self, texts: pd.Series) -> list[float]:
        split = [t.encode().split() for t in texts]
        everything = set().union(*split)
        new = list(everything.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(everything)
        for at in range(0, len(new), 50_000):
            words = new[at : at + 50_000]
            owner, bucket = word_features(words)
            sums = np.bincount(owner, self.weights[bucket], len(words))
            self.update(zip(words, sums.tolist()))
        out = []
        for words in split:
            total = float(np.fromiter(map(self.__getitem__, words), float, len(words)).sum()) + self.weights[END]
            again = repeats(words)
            total += again * self.weights[AGAIN]
            size = 1 + again + len(words) + 3 * sum(map(len, words))
            out.append(float(1 / (1 + np.exp(-total / size))))
        return out
