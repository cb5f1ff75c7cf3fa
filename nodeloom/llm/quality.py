"""Quality by random indexing and a small network with calibrated probabilities.

Random indexing: every token has a fixed sparse vector of signs drawn from a hash of it; the vector
of a frequent token is the sum of those of its neighbours, over all places where it stands in the
sample. Tokens too rare for a vector use that of their shape (capitals, lower case, digits, signs).
A document is the mean of its tokens' unit vectors with four numbers on its tokens: how many, how
many different, how often one follows itself, the share of the commonest. A network with one hidden
layer, in numpy, gives a logit, and a temperature fitted on rows that the network has not
seen makes its sigmoid a probability.

At most ``sample`` labelled rows are fitted on, chosen by a hash of their id; every text is scored
whole. Context sums are made on the executors and added up by token; the driver receives the vectors
of at most ``VOCABULARY`` tokens and the sample's document vectors.

Defined cases: null and empty texts are documents without tokens, with a zero vector; with labels of
one kind only, or none, every score is the smoothed rate of label 1; repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm._common import append_columns, fresh, held_out, stored
from nodeloom.llm.learning import Adam, first_rows, labelled, sigmoid, softplus, with_texts

SAMPLE = 8_000
DIMENSIONS, SIGNS, WINDOW = 64, 6, 2
INPUTS = DIMENSIONS + 4
#: Tokens with a vector of their own, and how many texts of the sample must hold one: words of a single text would tell it.
VOCABULARY, LEAST = 30_000, 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
_BLOCK = 200_000


def shape(token: str) -> str:
    """What stands for a token too rare for a vector; shapes hold a blank, so no token equals one."""
    if token[0].isalpha():
        if len(token) > 1 and token.isupper():
            return " AA"
        return " Aa" if token[0].isupper() else " aa" if token.islower() else " aA"
    return " 9" if token[0].isdigit() else f" {token[0]}{len(token) > 1}"


def sign_vectors(tokens: list[str]) -> np.ndarray:
    """The tokens' fixed vectors: a few signs at places, all read from a hash of the token."""
    from xxhash import xxh64_intdigest

    hashes = np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7) for t in tokens], np.uint64)
    vectors = np.zeros((len(tokens), DIMENSIONS), np.float32)
    for k in range(SIGNS):
        bits = hashes >> np.uint64(10 * k)
        np.add.at(vectors, (np.arange(len(tokens)), (bits >> np.uint64(1)).astype(np.int64) % DIMENSIONS), 1 - 2 * (bits & np.uint64(1)).astype(np.float32))
    return vectors


def context_sums(texts) -> dict[str, tuple[int, np.ndarray]]:
    """Token, and shape, to (number of texts, sum of its neighbours' vectors), over whole texts."""
    index: dict[str, int] = {}
    kind_of: list[int] = []  # the index of the shape of each token
    vectors, sums = np.zeros((1024, DIMENSIONS), np.float32), np.zeros((1024, DIMENSIONS), np.float32)
    counts = np.zeros(1024, np.int64)

    def enter(tokens: list[str]) -> None:
        nonlocal vectors, sums, counts
        fresh = [t for t in dict.fromkeys(tokens) if t not in index]
        kinds = {shape(t) for t in fresh}.difference(index)
        for t in (*sorted(kinds), *fresh):
            index[t] = len(index)
        kind_of.extend([-1] * len(kinds))
        kind_of.extend(index[shape(t)] for t in fresh)
        while len(index) > len(counts):
            counts = np.concatenate((counts, np.zeros_like(counts)))
            vectors, sums = (np.concatenate((x, np.zeros_like(x))) for x in (vectors, sums))
        vectors[len(index) - len(fresh) : len(index)] = sign_vectors(fresh)

    def add(ids: np.ndarray, around: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        sums[ids[order][first]] += np.add.reduceat(around[order], first, axis=0)

    for text in texts:
        tokens, own_ids = _TOKENS(text), set()
        for i in range(0, len(tokens), _BLOCK):
            low = max(0, i - WINDOW)
            part = tokens[low : i + _BLOCK + WINDOW]
            enter(part)
            ids = np.array([index[t] for t in part])
            own = vectors[ids]
            around = np.zeros_like(own)
            for d in range(1, WINDOW + 1):
                around[d:] += own[:-d]
                around[:-d] += own[d:]
            own_ids.update(ids.tolist())
            inner = slice(i - low, i - low + min(_BLOCK, len(tokens) - i))
            add(ids[inner], around[inner])
            add(np.array([kind_of[k] for k in ids[inner].tolist()]), around[inner])
        seen = list(own_ids | {kind_of[k] for k in own_ids})
        counts[seen] += 1
    return {t: (int(counts[k]), sums[k]) for t, k in index.items() if counts[k]}


def fit_vectors(sample: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors of all shapes and of the commonest tokens of the sample."""

    def sums(batches):
        found = context_sums(t for batch in batches for t in batch.column(0).to_pylist())
        names = sorted(found)
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[t][0] for t in part], pa.int64()), pa.array([found[t][1].tobytes() for t in part], pa.binary())], names=["token", "n", "sums"])

    def total(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for token, n, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = found.setdefault(token, [0, np.zeros(DIMENSIONS, np.float64)])
                have[0] += n
                have[1] += np.frombuffer(one, np.float32)
        kept = sorted(t for t, (n, _) in found.items() if n >= LEAST or t[0] == " ")
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([found[t][0] for t in kept], pa.int64()), pa.array([found[t][1].astype(np.float32).tobytes() for t in kept], pa.binary())], names=["token", "n", "sums"])

    kind = "token string, n long, sums binary"
    parts = sample.select("__text").mapInArrow(fresh(sums), kind).repartition("token").sortWithinPartitions("token", "n", "sums")
    rows = parts.mapInArrow(fresh(total), kind).orderBy(F.col("token").startswith(" ").desc(), F.col("n").desc(), "token").limit(VOCABULARY).collect()
    found = {}
    for r in rows:
        vector = np.frombuffer(r["sums"], np.float32)
        size = np.linalg.norm(vector)
        found[r["token"]] = vector / size if size > 0 else vector
    return found


class Pooler:
    """Documents to mean token vectors, and how many, how varied and how repetitive the tokens are."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.index = {t: k for k, t in enumerate(vectors)}
        self.matrix = np.array([*vectors.values(), np.zeros(DIMENSIONS)], np.float32)

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKENS(text)
        counts, total = Counter(tokens), len(tokens)
        ids = list(map(self.index.get, counts))
        if None in ids:
            none = len(self.index)
            ids = [self.index.get(shape(t), none) if k is None else k for k, t in zip(ids, counts, strict=True)]
        pooled = np.zeros(INPUTS, np.float32)
        if total:
            often = np.fromiter(counts.values(), np.float32, len(ids))
            pooled[:DIMENSIONS] = often @ self.matrix[ids] / total
            same = sum(map(eq, tokens, tokens[1:]))
            pooled[DIMENSIONS:] = np.log1p(total) / 10, np.log1p(len(ids)) / 10, same / total, often.max() / total
        return pooled


class Network:
    """Standardised inputs, one hidden layer with ReLU, a logit, and its temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        held = np.arange(len(x)) % 5 == 4  # rows come in the order of a hash
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held[:] = False
        z, t = self.standard(x[~held]), y[~held]
        self.a, self.b = random.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.c, self.d = random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array([np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))])
        adam = Adam([self.a, self.b, self.c, self.d], RATE, EPOCHS * -(-len(z) // BATCH))
        for _ in range(EPOCHS):
            order = random.permutation(len(z))
            for i in range(0, len(z), BATCH):
                pick = order[i : i + BATCH]
                hidden = np.maximum(z[pick] @ self.a + self.b, 0)
                error = (sigmoid(hidden @ self.c + self.d) - t[pick]) / len(pick)
                back = np.outer(error, self.c) * (hidden > 0)
                adam.step([z[pick].T @ back + DECAY * self.a, back.sum(0), hidden.T @ error + DECAY * self.c, np.array([error.sum()])])
        self.temperature = 1.0
        if held.any():
            logits, truth = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            self.temperature = float(min(grid, key=lambda g: np.mean(softplus(logits / g) - truth * logits / g)))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.standard(x) @ self.a + self.b, 0) @ self.c + self.d

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


class Constant:
    """The smoothed rate of label 1, where there is nothing to tell apart."""

    def __init__(self, y: np.ndarray):
        self.rate = (y.sum() + 1) / (len(y) + 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.rate)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int):
    """(pooler, scorer) from a bounded sample of labelled rows."""
    chosen = first_rows(labelled(labels, label_col, id_col), sample)
    rows = stored(with_texts(docs, chosen, id_col, text_col), "labelled")
    pooler = Pooler(fit_vectors(rows))
    shipped = docs.sparkSession.sparkContext.broadcast(pooler)

    def pool(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shipped.value(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["__id", "label", "x"])

    order = F.xxhash64(F.col("__id").cast("string"))
    pooled = rows.select("__id", "label", "__text").mapInArrow(fresh(pool), f"__id {dict(rows.dtypes)['__id']}, label int, x binary").orderBy(order, "__id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in pooled], float).reshape(-1, INPUTS)
    y = np.array([r["label"] for r in pooled], float)
    return pooler, Network(x, y) if len(set(y.tolist())) == 2 else Constant(y)


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    threshold: float = 0.3,
) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))

    def make():
        pooler, scorer = model.value

        def columns(texts):
            scores = scorer(np.array([pooler(t) for t in texts], float).reshape(-1, INPUTS)) if texts else np.zeros(0)
            return [scores, (scores >= threshold).astype(np.int32)]

        return columns

    return append_columns(docs.withColumn("held_out", held_out(id_col)), text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)
