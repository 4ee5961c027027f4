"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass that sends a sparse count per (language, bucket) and task.
The model, languages times buckets, has a fixed size; it is broadcast as a matrix
of log-probabilities and documents are scored in Arrow batches with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, table

#: Buckets of hashed n-grams and the lengths of the n-grams.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3, 4)
#: Code points that are handled at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Bounds of the model: numbers in its matrix, and buckets of a language, of which there are fewer
#: where there are many languages. Beyond MODEL / FEWEST languages, those with the most documents are learned.
MODEL, FEWEST = 1 << 24, 1 << 8
_LETTER = regex.compile(r"\p{L}")
_MUL = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def buckets(text: str, n_buckets: int = BUCKETS):
    """Hashed n-grams of the lower-cased text, piece by piece."""
    low = f" {text.lower()} "
    widest = max(ORDERS)
    for at in range(0, len(low), PIECE):
        code = np.frombuffer(low[at : at + PIECE + widest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            size = min(len(code), PIECE + n - 1) - n + 1
            if size > 0:
                h = code[:size] * _MUL[0] + np.uint32(n)
                for i in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) * _MUL[1] + code[i : i + size] * _MUL[i]
                h ^= h >> np.uint32(16)
                yield h & np.uint32(n_buckets - 1)


def _counts(n_buckets: int):
    def run(batches):
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text and _LETTER.search(text):
                    mine = found.setdefault(lang, np.zeros(n_buckets, np.int64))
                    docs[lang] = docs.get(lang, 0) + 1
                    for ids in buckets(text, n_buckets):
                        mine += np.bincount(ids, minlength=n_buckets)
        for lang, mine in found.items():
            at = np.append(np.flatnonzero(mine), n_buckets)  # the last stands for the number of documents
            n = np.append(mine[at[:-1]], docs[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    return run


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def score(self, text: str) -> tuple[str, float]:
        total = self.prior.copy()
        for ids in buckets(text, len(self.weights)):
            total += np.bincount(ids, minlength=len(self.weights)) @ self.weights if len(ids) > 4 * len(self.weights) else self.weights[ids].sum(0, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, n_buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """Learns from all rows with a text and a language. Rows with a null of either, or no
    letter, teach nothing; rows that repeat teach each time; other columns are ignored. Very long texts
    are read in pieces. The model has at most MODEL numbers, whatever the rows are."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MODEL // FEWEST)
    langs = sorted(r["lang"] for r in known.collect())
    while n_buckets * len(langs) > MODEL and n_buckets > FEWEST:
        n_buckets //= 2
    if len(langs) == MODEL // FEWEST:
        rows = rows.join(F.broadcast(known.select(F.col("lang").alias("_l"))), F.col("lang") == F.col("_l"), "left_semi")
    sums = rows.mapInArrow(_counts(n_buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    counts = np.zeros((n_buckets + 1, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    lang = got["lang"].combine_chunks().dictionary_encode()
    at = np.array([place[x] for x in lang.dictionary.to_pylist()], int)[lang.indices.to_numpy(zero_copy_only=False)] if got.num_rows else np.zeros(0, int)
    counts[got["bucket"].to_numpy(), at] = got["n"].to_numpy()
    taught = counts[-1] > 0
    counts, langs = counts[:, taught], [x for x, t in zip(langs, taught, strict=True) if t]
    grams = counts[:-1] + smoothing
    prior = np.log(counts[-1] / max(1.0, counts[-1].sum())) if langs else np.zeros(0)
    return Model(langs, np.log(grams / grams.sum(0)).astype(np.float32), prior)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            out = [model.score(t) if t and model.langs and _LETTER.search(t) else ("und", 0.0) for t in batch["text"].to_pylist()]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, carry: list[Column]) -> DataFrame:
    """The `carry` columns of each row with lang_pred and score, the posterior
    probability of that language. A null text, or one without a letter, gets
    ``und`` and 0; so does every text if nothing was learned. Of languages that are equally
    probable the first by code point wins. Rows that repeat come back each; very long texts are
    read whole, in pieces."""
    d = docs.select(*carry, F.col("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]]
    return d.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), ", ".join([*kinds, "lang_pred string", "score double"]))


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out))
    return predict(docs, model, [F.col("doc_id"), out.alias("held_out")])
