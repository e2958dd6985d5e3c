"""Toxic spans by a linear-chain conditional random field, and document scores from it.

Only documents are labelled, so token labels come first: a word or word
beginning that toxic training documents hold at several times the rate of the
others marks its tokens in toxic documents; every token of the others is clean.
The field has two states, a hashed feature set for each word (the word, its
beginnings and its ending) and four transition weights. Chains end at sentence
marks and after `CHAIN` words. With two states, forward and backward passes are
recursions of log odds, run over many chains at once in numpy. A document's
score is a logistic function of its words' marginals, fitted on a part of the
training sample that the field has not seen.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import bounded_keys, crc_mod, fresh, lean, pieces, rows_of, settle

#: Labelled rows of each class that the field is fitted on, at most, and bytes of one.
SAMPLE, SAMPLE_BYTES = 1500, 8192
#: Hash buckets of features; words of a chain.
BUCKETS, CHAIN = 1 << 18, 64
#: Documents and rate ratio from which a feature marks tokens.
LEAST_DOCS, LEAST_RATIO = 4, 5.0
#: Likelihood ratio of the counts (chi-squared, one degree) that chance seldom gives any of 100,000 features.
LEAST_SURPRISE = 20.0
#: Distinct words that a worker remembers.
REMEMBERED = 1 << 18

_TOKEN = re.compile(r"\w+|[.!?\n]+")


def _features(word: str) -> list[int]:
    """Buckets of a word: its ending, the word, and its beginnings of four bytes and more."""
    w = word.lower().encode("utf-8", "surrogatepass")
    begun = zlib.crc32(w[:4], 1)
    out = [zlib.crc32(w[-4:], 2) % BUCKETS, zlib.crc32(w, 3) % BUCKETS]
    for k in range(4, min(len(w), 10)):
        out.append(begun % BUCKETS)
        begun = zlib.crc32(w[k : k + 1], begun)
    return out


@dataclass
class Chains:
    """Words of many texts laid out as chains: a column each, the chain's words from the top."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, ends: np.ndarray) -> Chains:
        """ends: for each token whether a chain ends there; the ends are no words."""
        part = np.cumsum(ends)
        words = np.flatnonzero(~ends)
        part = part[words]
        first = np.r_[True, part[1:] != part[:-1]] if len(part) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(part)), 0)) if len(part) else np.zeros(0, int)
        place = np.arange(len(part)) - start
        first |= place % CHAIN == 0
        column = np.cumsum(first) - 1
        return cls(place % CHAIN, column, (min(CHAIN, int(place.max(initial=0)) + 1), int(column[-1]) + 1 if len(column) else 0))

    def spread(self, values: np.ndarray, empty: float = 0.0) -> np.ndarray:
        out = np.full(self.shape, empty)
        out[self.row, self.column] = values
        return out

    def follows(self) -> np.ndarray:
        """From the second place on: whether a word of the chain stands there."""
        return self.spread(np.ones(len(self.row))).astype(bool)[1:]


@dataclass
class Field:
    """The random field: feature weights, transition weights, and the document layer."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = -3.0
    layer: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        """Log odds of a word by itself; not a number at a mark that ends a chain."""
        if word[0] in ".!?\n":
            return float("nan")
        return self.bias + sum(map(self.weights.__getitem__, _features(word)))

    def passes(self, e: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the forward and backward messages of chains; `follows` tells where a
        word has one of its chain before it, so nothing below a chain's end speaks to it."""
        t = self.steps
        ahead, back = np.empty_like(e), np.zeros_like(e)
        for k in range(len(e)):
            ahead[k] = e[k] if k == 0 else e[k] + np.logaddexp(t[0, 1], ahead[k - 1] + t[1, 1]) - np.logaddexp(t[0, 0], ahead[k - 1] + t[1, 0])
        for k in range(len(e) - 2, -1, -1):
            x = e[k + 1] + back[k + 1]
            back[k] = np.where(follows[k], np.logaddexp(t[1, 0], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[0, 1]), 0.0)
        return ahead, back

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """Of each token, the probability that it is toxic; 0 where `e` is not a number."""
        ends = np.isnan(e)
        out = np.zeros(len(e))
        chains = Chains.of(ends)
        if not chains.shape[1]:
            return out
        ahead, back = self.passes(chains.spread(e[~ends]), chains.follows())
        out[~ends] = _sigmoid((ahead + back)[chains.row, chains.column])
        return out

    def summary(self, p: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What the document layer sees: a row for each document."""
        total = np.zeros(len(words))
        top = np.zeros(len(words))
        some = words > 0
        if len(p) and some.any():
            at = starts[some]
            total[some] = np.add.reduceat(p, at)
            top[some] = np.maximum.reduceat(p, at)
        rate = np.log1p(1000 * total / np.maximum(words, 1))
        return np.stack([np.ones(len(words)), np.log1p(total), top, rate], 1)

    def score(self, seen: np.ndarray) -> np.ndarray:
        return _sigmoid(seen @ self.layer)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marked(texts: list[tuple[str, int]]) -> set[int]:
    """Features that mark tokens of toxic documents, from documents and their labels."""
    toxic, clean = Counter(), Counter()
    n = [0, 0]
    for text, label in texts:
        found = {f for w in set(_TOKEN.findall(text)) if w[0] not in ".!?\n" for f in _features(w)[1:]}
        (toxic if label else clean).update(found)
        n[bool(label)] += 1
    if not min(n):
        return set()

    def surprise(k: int, c: int) -> float:
        """Twice the log likelihood ratio of k toxic and c clean documents against one rate for both."""
        cells = ((k, n[1], k + c), (c, n[0], k + c), (n[1] - k, n[1], sum(n) - k - c), (n[0] - c, n[0], sum(n) - k - c))
        return 2 * sum(x * math.log(x * sum(n) / (row * column)) for x, row, column in cells if x)

    return {
        f for f, k in toxic.items()
        if k >= LEAST_DOCS and k / n[1] >= LEAST_RATIO * (clean[f] + 0.5) / n[0] and surprise(k, clean[f]) >= LEAST_SURPRISE
    }


def train(texts: list[tuple[str, int]], rounds: int = 30, rate: float = 0.5) -> Field:
    """Fits the field and the document layer; without both labels, scores stay low."""
    out = Field()
    marks = marked(texts)
    if not marks:
        out.layer = np.array([-4.0, 0.0, 0.0, 0.0])
        return out
    part, rest = texts[::3] + texts[1::3], texts[2::3] or texts
    index: dict[str, int] = {}
    slices = []
    for at in range(0, len(part), 100):
        codes, gold = [], []
        for text, label in part[at : at + 100]:
            for w in [*_TOKEN.findall(text), "\n"]:
                codes.append(-1 if w[0] in ".!?\n" else index.setdefault(w, len(index)))
                gold.append(bool(label) and codes[-1] >= 0 and not marks.isdisjoint(_features(w)[1:]))
        code, y = np.array(codes), np.array(gold)
        slices.append((Chains.of(code < 0), code[code >= 0], y[code >= 0].astype(float)))
    feats = [_features(w) for w in index]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    square, step_square, bias_square = np.full(BUCKETS, 1e-3), np.full((2, 2), 1e-3), 1e-3
    for _ in range(rounds):
        by_word = out.bias + np.bincount(owner, out.weights[flat], len(feats))
        off, pair = np.zeros(len(feats)), np.zeros((2, 2))
        for chains, word, y in slices:
            some, steps = _pull(out, chains, word, y, by_word)
            off += some
            pair += steps
        g = np.bincount(flat, off[owner], BUCKETS) + 0.01 * out.weights
        square += g * g
        out.weights -= rate * g / np.sqrt(square)
        bias_square += off.sum() ** 2
        out.bias -= rate * off.sum() / np.sqrt(bias_square)
        pair += 0.01 * out.steps
        step_square += pair * pair
        out.steps = out.steps - 0.3 * rate * pair / np.sqrt(step_square)
    return _layer(out, rest)


def _pull(out: Field, chains: Chains, word: np.ndarray, y: np.ndarray, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of some chains: for each word its marginals less its labels, and for the
    transitions what the field expects less what stands there."""
    e, follows = chains.spread(by_word[word]), chains.follows()
    ahead, back = out.passes(e, follows)
    off = np.bincount(word, _sigmoid((ahead + back)[chains.row, chains.column]) - y, len(by_word))
    grid = chains.spread(y)
    x = (e + back)[1:]
    pair = np.stack([np.zeros_like(x), x, ahead[:-1], ahead[:-1] + x]) + out.steps.reshape(4, 1, 1)
    pair = np.exp(pair - pair.max(0))
    pair = (pair / pair.sum(0) * follows).sum((1, 2)).reshape(2, 2)
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] -= ((grid[:-1] == a) & (grid[1:] == b) & follows).sum()
    return off, pair


def _layer(out: Field, texts: list[tuple[str, int]]) -> Field:
    """Fits the document layer by Newton steps."""
    memo = Emissions(out)
    x = np.concatenate([_seen(memo, [t for t, _ in texts[k : k + 100]])[0] for k in range(0, len(texts), 100)])
    y = np.array([float(bool(label)) for _, label in texts])
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull
        w -= np.linalg.solve(h, x.T @ (p - y) + pull @ w)
    out.layer = w
    return out


class Emissions(dict):
    """word -> log odds, worked out once for a distinct word."""

    def __init__(self, model: Field) -> None:
        super().__init__()
        self.model = replace(model, weights=model.weights.tolist())  # a list is read faster, place by place

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        x = self[word] = self.model.emission(word)
        return x


def _seen(memo: Emissions, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the document layer's rows, all tokens' marginals, where each text's tokens start."""
    tokens = [[*_TOKEN.findall(t), "\n"] for t in texts]
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    e = np.fromiter((x for t in tokens for x in map(memo.__getitem__, t)), float, int(counts.sum()))
    starts = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    p = memo.model.marginals(e)
    return memo.model.summary(p, starts, counts), p, starts


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from a bounded sample: SAMPLE labelled rows a class, of SAMPLE_BYTES at most.

    Rows whose crc32(doc_id as text) mod 3 is 1 are never learned from, nor rows
    with a null id, label or text, nor documents whose labels contradict each other.
    """
    ours = labels.filter((crc_mod("doc_id", 3) != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id")
    ours = ours.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    short = docs.select("doc_id", "text").filter((F.octet_length("text") <= SAMPLE_BYTES) & (crc_mod("doc_id", 3) != 1))
    labelled = settle(short.select("doc_id", F.xxhash64("text").alias("h")).join(ours, "doc_id"))
    rows: set[tuple[str, int]] = set()
    for label in (0, 1):
        keys = bounded_keys(labelled.filter(F.col("toxic") == label).select("doc_id", "h"), SAMPLE)
        rows |= {(r.text, label) for r in rows_of(short, keys).select("text").collect()}
    return train(sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r)))


def score(docs: DataFrame, model: Field, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default doc_id) of each row with tox_score and tox_spans.

    Only the text is an input. Null counts as empty, and an empty text has the
    score of a document without a toxic word. Spans (code points, with their
    marginal) are listed where the score reaches the threshold. Repeated rows are
    scored each; the added names replace columns that clash with them.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in ("tox_score", "tox_spans")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_spans", SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Emissions(shared.value)
        for whole in batches:
            for batch in pieces(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                seen, p, starts = _seen(memo, texts)
                scores = memo.model.score(seen)
                spans = []
                for k, t in enumerate(texts):
                    found = []
                    if scores[k] >= threshold:
                        found = [{"start": m.start(), "end": m.end(), "p": float(p[starts[k] + j])} for j, m in enumerate(_TOKEN.finditer(t)) if p[starts[k] + j] >= 0.5]
                    spans.append(found)
                held = batch.select(keep)
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(scores), pa.array(spans, kind)], schema=pa.schema([*held.schema, ("tox_score", pa.float64()), ("tox_spans", kind)]))

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, model: Field, threshold: float = 0.7) -> DataFrame:
    """The rows that score below the threshold, with all their columns, whatever their names."""
    own = {c: fresh(f"own_{c}", docs.columns) for c in docs.columns if c in ("tox_score", "tox_spans")}
    safe = docs.select(*[F.col(c).alias(own.get(c, c)) for c in docs.columns])
    kept = score(safe, model, threshold, safe.columns).filter(F.col("tox_score") < threshold)
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
