"""Language of a text from averaged hashed subword embeddings and a linear softmax.

A word's vector is the mean of the embeddings of its hashed 1- to 4-letter
pieces, a text's the mean of its words' vectors. Embeddings and the softmax
layer are trained together by stochastic gradient descent in numpy. A
temperature fitted on a held-back part of the sample makes the softmax a
probability. The same part gives the least probability at which accepted
predictions are right as often as asked; texts below it are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import bounded_keys, crc_mod, fields, lean, pieces, rows_of

#: Rows the model is fitted on, at most, and bytes of one.
SAMPLE, SAMPLE_BYTES = 4000, 8192
#: Hash buckets, width of an embedding, distinct words that a worker remembers.
BUCKETS, WIDTH, REMEMBERED = 1 << 16, 16, 1 << 18
#: Share of accepted predictions that must be right in the held-back part.
ACCEPTED_RIGHT = 0.99

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 4-letter pieces of words (with their ends marked), word by
    word, and how many each word has."""
    marked = [f"<{w.lower()}>" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 5):
        h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        inside = owner[: len(h)] == owner[n - 1 :]
        ids.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    whole = np.concatenate(owners)
    return np.concatenate(ids)[np.argsort(whole, kind="stable")], np.bincount(whole, minlength=len(words))


@dataclass
class Model:
    """Embeddings, softmax layer, temperature, the languages in the order of its columns,
    and the probability below which a prediction is rejected."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    langs: list[str]
    reject: float = 0.5

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        z = (h @ self.layer + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to 1."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, int), np.zeros(0)
    ids, counts = grams(words)
    found, where = np.unique(ids, return_inverse=True)
    return found, np.bincount(where, np.repeat(1 / counts, counts)) / len(words)


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 2.0, batch: int = 32, seed: int = 7) -> Model:
    """Fits a model to (language, text) rows."""
    langs = sorted({lang for lang, _ in rows}) or ["und"]
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = random.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    parts = [(_parts(t), langs.index(lang)) for lang, t in rows]
    parts = [p for p in parts if len(p[0][0])]
    held, ours = parts[::8], [p for k, p in enumerate(parts) if k % 8] or parts
    steps = max(1, epochs * -(-len(ours) // batch))
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(ours))
        for at in range(0, len(ours), batch):
            rows = [ours[k] for k in order[at : at + batch]]
            ids = np.concatenate([r[0][0] for r in rows])
            weights = np.concatenate([r[0][1] for r in rows])
            starts = np.r_[0, np.cumsum([len(r[0][0]) for r in rows])[:-1]]
            h = np.add.reduceat(table[ids] * weights[:, None], starts)
            z = h @ layer + bias
            z = np.exp(z - z.max(1, keepdims=True))
            off = z / z.sum(1, keepdims=True)
            off[np.arange(len(rows)), [r[1] for r in rows]] -= 1
            now = rate * (1 - step / steps)
            back = off @ layer.T
            layer -= now * h.T @ off / len(rows)
            bias -= now * off.mean(0)
            spread = np.repeat(back, [len(r[0][0]) for r in rows], axis=0) * weights[:, None]
            np.subtract.at(table, ids, now * spread)
            step += 1
    model = Model(table.astype(np.float32), layer, bias, 1.0, langs)
    if held:
        h = np.stack([(table[i] * w[:, None]).sum(0) for (i, w), _ in held])
        y = np.array([c for _, c in held])
        losses = {}
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            losses[float(t)] = -np.log(model.probabilities(h)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = min(losses, key=losses.get)
        model.reject = rejection(model.probabilities(h), y)
    return model


def rejection(p: np.ndarray, y: np.ndarray) -> float:
    """The least of a coin's odds and more at which predictions `p` of classes `y` are right often enough."""
    order = np.argsort(-p.max(1), kind="stable")
    best, right = p.max(1)[order], (p.argmax(1) == y)[order]
    share = np.cumsum(right) / np.arange(1, len(y) + 1)
    # rows of equal probability are accepted together
    ends = np.r_[best[1:] != best[:-1], True]
    good = np.flatnonzero(ends & (share >= ACCEPTED_RIGHT))
    return float(max(0.5, best[good[-1]])) if len(good) and good[-1] < len(y) - 1 else 0.5 if len(good) else 1.0


class Vectors:
    """Vectors of distinct words, a row of a growing table each."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.rows = np.zeros((1024, WIDTH), np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        """The row of each word."""
        if len(self.index) > REMEMBERED:
            self.index.clear()
        index = self.index
        known = len(index)
        at = [index.setdefault(w, len(index)) for w in words]
        if len(index) > known:
            if len(index) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(index), WIDTH), np.float32)])
            new = list(islice(index, known, None))
            for a in range(0, len(new), 20_000):
                ids, counts = grams(new[a : a + 20_000])
                sums = np.add.reduceat(self.model.table[ids], np.r_[0, np.cumsum(counts)[:-1]])
                self.rows[known + a : known + a + len(counts)] = sums / counts[:, None]
        return self.rows[np.array(at, dtype=np.int64)]


def predict(texts: list[str | None], vectors: Vectors) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text; `und` and 0 without a letter."""
    words = [_WORD.findall(t or "") for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    some = np.flatnonzero(counts)
    if len(some):
        v = vectors.lookup([w for ws in words for w in ws])
        starts = np.r_[0, np.cumsum(counts)[:-1]][some]
        h = np.add.reduceat(v, starts, dtype=np.float64) / counts[some][:, None]
        p = vectors.model.probabilities(h)
        for k, row in zip(some, p):
            langs[k], scores[k] = vectors.model.langs[int(row.argmax())], row.max()
    return langs, scores


def fit(docs: DataFrame) -> Model:
    """A model from at most SAMPLE rows of at most SAMPLE_BYTES, as many of each language as there are.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from, nor rows
    with a null id, text or language. Languages not in the sample are not predicted.
    """
    ours = docs.select("doc_id", "text", "lang").filter(
        (crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)
    )
    keys = bounded_keys(ours.select("doc_id", F.xxhash64("text").alias("h"), "lang"), SAMPLE, ["lang"])
    return train(sorted((r.lang, r.text) for r in rows_of(ours, keys).select("lang", "text").collect()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row; only the text is an input.

    Null text, and text without a letter, is `und` with score 0 and rejected.
    Repeated rows are predicted each.
    """
    schema = T.StructType([docs.schema["doc_id"], *fields("lang_pred string, score double, rejected boolean")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(shared.value)
        for whole in batches:
            for batch in pieces(whole):
                langs, scores = predict(batch.column("text").to_pylist(), vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(scores < vectors.model.reject)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
