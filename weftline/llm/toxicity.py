"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is scored by its tokens: runs between white space, outer punctuation stripped,
and runs of single characters ("i d i o t") as one token. The kernel of two tokens sums
over all common subsequences of three characters, each weighted by LAMBDA to the span
it takes in both (so inserted characters only lower the weight), and is normalised.
Landmarks are training tokens; a token's Nyström features are its kernel values with
them, times the inverse root of the landmarks' kernel matrix; a linear SVM is trained on
them. As the kernel is explicit over character triples, the trained machine is one
table of triple weights, and scoring costs no kernel evaluation against landmarks.

Training is multiple-instance: labels are of texts, insults are tokens. Positive
instances are tokens whose distinct contexts (neighbouring tokens) are far more
frequent in toxic texts; counting contexts, not texts, keeps the words of a copied text
out. Negatives are tokens of clean texts, with rounds of hard negatives. A logistic
curve over the largest margin and the numbers of tokens over some margins gives the
text's score.

Labels are of texts, and the machine is trained on their tokens, not on sentences as
bags: insults are single words here, and a bag's kernel is dominated by its other words.

The fit is bounded by documented parameters: at most ``max_toxic`` and ``max_clean``
labelled texts (by hash order), and of their tokens at most ``max_insults`` positive
ones (those of most contexts), ``max_words`` + ``max_common`` negative ones (by hash,
and the most frequent) and ``max_hard`` hard negatives a round. Texts are read whole, in
the fit as in scoring; a token of over 24 characters is read as overlapping pieces in
both. Every row is scored. Only label rows whose
crc32(doc_id as text) mod 5 is not 0 are used.

Nulls: null or empty texts have no token and get the score of no insult. Null labels,
and ids without a text, do not train; conflicting labels of an id count as toxic if
half of them are. Without toxic or clean training texts every score is 0. Repeated rows
are scored alike. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, materialise, table

LAMBDA = 0.7
SYMBOLS = 64
LONGEST, STRIDE = 24, 12
MAX_TOXIC, MAX_CLEAN = 3000, 6000
MAX_INSULTS, MAX_WORDS, MAX_COMMON, MAX_HARD = 3000, 8000, 2000, 4000
LANDMARKS = 160
FOLDS = 5
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—"
SINGLES = re.compile(r"(?<!\S)(?:[^\s] ){2,}[^\s](?!\S)")
CACHE = 400_000
GROUP = 20_000
#: margins over which a text's distinct tokens are counted
LEVELS = (0.0, 0.4, 0.7)


def tokens_of(text: str) -> list[str]:
    low = text.lower()
    found = low.split()
    if SINGLES.search(low):
        found += [m.group().replace(" ", "") for m in SINGLES.finditer(low)]
    return found


class _Symbols(dict):
    """Code point to symbol: letters and digits own 1-36, other letters share 37-63 by code point; punctuation is 0 and matches nothing."""

    def __missing__(self, c: int) -> int:
        x = chr(c)
        self[c] = found = c - 96 if "a" <= x <= "z" else 27 + c - 48 if "0" <= x <= "9" else 37 + c % 27 if x.isalnum() else 0
        return found


_SYMBOLS = _Symbols()


def codes_of(text: str) -> np.ndarray:
    """The symbol of every character."""
    return np.frombuffer(text.translate(_SYMBOLS).encode("latin-1"), np.uint8).astype(np.int64)


_TRIPLES: dict[int, tuple] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        i, j, k = (x.astype(np.int64) for x in np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]).T)
        _TRIPLES[n] = (i, j, k, LAMBDA ** (k - i + 1.0))
    return _TRIPLES[n]


def self_kernels(x: np.ndarray) -> np.ndarray:
    """K(x, x) of rows of symbols of one length, by the subsequence recursion."""
    t, n = x.shape
    decay = LAMBDA
    before = np.ones((n + 1, n + 1, t))
    for _ in range(2):
        now = np.zeros((n + 1, n + 1, t))
        for i in range(1, n + 1):
            run = np.zeros(t)
            for j in range(1, n + 1):
                run = decay * run + decay**2 * ((x[:, i - 1] == x[:, j - 1]) & (x[:, i - 1] > 0)) * before[i - 1, j - 1]
                now[i, j] = decay * now[i - 1, j] + run
        before = now
    total = np.zeros(t)
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            total += decay**2 * ((x[:, i - 1] == x[:, j - 1]) & (x[:, i - 1] > 0)) * before[i - 1, j - 1]
    return total


def pieces(token: str) -> list[str]:
    """The token, or its overlapping pieces if it is longer than LONGEST."""
    n = len(token)
    return [token] if n <= LONGEST else [token[s : s + LONGEST] for s in range(0, n - LONGEST + STRIDE, STRIDE)]


def explicit(token: str) -> tuple[np.ndarray, np.ndarray]:
    """The normalised feature vector of a token of at most LONGEST characters (see `pieces`): (triple numbers, values)."""
    x = codes_of(token)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    i, j, k, w = _triples(len(x))
    real = (x[i] > 0) & (x[j] > 0) & (x[k] > 0)
    which, at = np.unique(((x[i] * SYMBOLS + x[j]) * SYMBOLS + x[k])[real], return_inverse=True)
    values = np.bincount(at, w[real], len(which)) if len(which) else np.zeros(0)
    norm = np.sqrt((values**2).sum())
    return which, values / norm if norm else values


def margins(tokens: list[str], beta: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each token; tokens over LONGEST go in overlapping pieces, of which the largest counts."""
    by_length: dict[int, tuple[list, list]] = {}
    for at, token in enumerate(tokens):
        n = len(token)
        if n > LONGEST:
            for piece in pieces(token):
                rows = by_length.setdefault(len(piece), ([], []))
                rows[0].append(at)
                rows[1].append(piece)
        elif n >= 3:
            rows = by_length.setdefault(n, ([], []))
            rows[0].append(at)
            rows[1].append(token)
    best = np.full(len(tokens), -np.inf)
    for n, (at, rows) in by_length.items():
        if n < 3:
            continue
        i, j, k, w = _triples(n)
        every, at = codes_of("".join(rows)).reshape(-1, n), np.array(at)
        step = max(16, 400_000 // len(i))
        for s in range(0, len(rows), step):
            x = every[s : s + step]
            value = np.einsum("ij,j->i", beta[(x[:, i] * SYMBOLS + x[:, j]) * SYMBOLS + x[:, k]], w)
            hot = np.flatnonzero(value > 0)
            if len(hot):  # the norm only scales, so it is needed where the value is positive
                value[hot] /= np.sqrt(np.maximum(self_kernels(x[hot]), 1e-12))
            np.maximum.at(best, at[s : s + step], np.minimum(value, np.where(value > 0, value, 0)) + bias)
    return np.where(np.isfinite(best), best, bias)


def train_svm(features: np.ndarray, y: np.ndarray, weights: np.ndarray, c: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Linear SVM (squared hinge) by accelerated gradient; the last feature is the constant."""
    w = v = np.zeros(features.shape[1])
    lipschitz = 1 + 2 * c * np.linalg.norm(features * np.sqrt(weights)[:, None], 2) ** 2
    ridge = np.ones(features.shape[1])
    ridge[-1] = 1e-3
    for r in range(rounds):
        slack = np.maximum(0, 1 - y * (features @ v))
        grad = ridge * v - 2 * c * features.T @ (weights * y * slack)
        after = v - grad / lipschitz
        v, w = after + r / (r + 3) * (after - w), after
    return w


class Model:
    """Triple weights and bias of the machine, and the logistic curve over a text's features."""

    def __init__(self, beta: np.ndarray, bias: float, curve: np.ndarray | None = None):
        self.beta, self.bias, self.curve = beta, bias, curve

    def features(self, texts: Iterable[str | None], cache: dict[str, float]) -> np.ndarray:
        """Per text: the largest margin, the log of distinct tokens over each level, and of all; new tokens of many texts are valued together."""
        out: list[list[float]] = []
        waiting: list[set[str]] = []
        new: set[str] = set()

        def settle() -> None:
            order = list(new)
            cache.update(zip(order, margins([t.strip(PUNCTUATION) for t in order], self.beta, self.bias).tolist(), strict=True))
            for seen in waiting:
                values = [cache[t] for t in seen]
                out.append([max(values, default=self.bias), *(float(np.log1p(sum(v > level for v in values))) for level in LEVELS), float(np.log1p(len(values)))])
            waiting.clear()
            new.clear()
            if len(cache) > CACHE:
                cache.clear()

        for text in texts:
            seen = set(tokens_of(text)) if text else set()
            waiting.append(seen)
            new.update(t for t in seen if t not in cache)
            if len(new) > GROUP or len(waiting) >= GROUP:
                settle()
        settle()
        return np.array(out).reshape(-1, len(LEVELS) + 2)

    def scores(self, texts: Iterable[str | None], cache: dict[str, float]) -> np.ndarray:
        x = self.features(texts, cache)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _fit_machine(positives: list[str], positive_weights: np.ndarray, negatives: list[str], landmarks: int) -> Model:
    """Nyström landmarks from both classes, no two alike, then the SVM on their features."""
    sides = [(t, True) for t in positives[: landmarks * 4]] + [(t, False) for t in negatives[: landmarks]]
    quota = {True: landmarks * 5 // 8, False: landmarks - landmarks * 5 // 8}
    chosen: list[tuple[np.ndarray, np.ndarray]] = []
    holders: dict[int, list[tuple[int, float]]] = {}  # triple: the landmarks that have it

    def kernels(which: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chosen))
        for u, v in zip(which.tolist(), values.tolist(), strict=True):
            for at, x in holders.get(u, ()):
                out[at] += v * x
        return out

    for token, side in sides:
        which, values = explicit(token)
        if not len(which) or not quota[side] or kernels(which, values).max(initial=0) > 0.9:
            continue
        quota[side] -= 1
        for u, v in zip(which.tolist(), values.tolist(), strict=True):
            holders.setdefault(u, []).append((len(chosen), v))
        chosen.append((which, values))
    if not chosen:
        return Model(np.zeros(SYMBOLS**3), -1.0)
    gram = np.array([kernels(*x) for x in chosen])
    value, vector = np.linalg.eigh(gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    every = [*positives, *negatives]
    kernel = np.array([kernels(*explicit(token)) for token in every])
    features = np.hstack([kernel @ root, np.ones((len(every), 1))])
    y = np.repeat([1.0, -1.0], [len(positives), len(negatives)])
    weights = np.concatenate([positive_weights, np.full(len(negatives), 1.0)])
    weights *= np.where(y > 0, 0.5 * len(y) / positive_weights.sum(), 1.0)
    w = train_svm(features, y, weights)
    beta = np.zeros(SYMBOLS**3)
    for alpha, (which, values) in zip(root @ w[:-1], chosen, strict=True):
        beta[which] += alpha * values
    return Model(beta, float(w[-1]))


def training_texts(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(_id, text, toxic, weight) of at most max_toxic + max_clean labelled texts outside the held-out fold, by hash order."""
    own = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    own = own.groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [own.where(f"toxic = {t}").orderBy(*order).limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    sample = parts[0].union(parts[1]).select(F.col("doc_id").alias("label_id"), "toxic")
    weights = F.when(F.col("toxic") == 1, max(1.0, counts.get(1, 0) / max_toxic)).otherwise(max(1.0, counts.get(0, 0) / max_clean))
    texts = keyed(docs).where("text is not null")
    # at most max_toxic + max_clean ids are broadcast
    return materialise(texts.join(F.broadcast(sample), texts["_id"] == sample["label_id"]).select("_id", "text", "toxic", weights.alias("weight")), "toxic-sample")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, context, toxic): every token of a text (the pieces of a long one) with its neighbours, once."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = [t.strip(PUNCTUATION) for t in tokens_of(text)]
            rows = list({(p, f"{a} {b}") for a, t, b in zip(["", *found], found, [*found[1:], ""], strict=False) for p in pieces(t) if len(p) >= 3})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([toxic] * len(rows), pa.int32())], ["token", "context", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, landmarks: int = LANDMARKS, max_insults: int = MAX_INSULTS, max_words: int = MAX_WORDS, max_common: int = MAX_COMMON, max_hard: int = MAX_HARD) -> Model | None:
    """The model, or None where a class has no training text. The driver gets at most the tokens that the parameters allow, of 24 characters each, and a few numbers a sampled text."""
    sample = training_texts(docs, labels, max_toxic, max_clean)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    rows = sample.mapInArrow(_contexts, "token string, context string, toxic int")
    per_token = rows.groupBy("token", F.xxhash64("context").alias("c")).agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("clean"))
    vocabulary = materialise(per_token.groupBy("token").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("clean")).alias("n")), "toxic-words")
    ratio = (F.col("p") / sizes[1]) / ((F.col("n") + 0.5) / sizes[0])
    found = vocabulary.where("p >= 4").where(ratio >= 8).orderBy(F.col("p").desc(), "token").limit(max_insults).toPandas()
    clean = vocabulary.where("n >= 1").where(ratio < 4)
    negatives = [r["token"] for r in clean.orderBy(F.xxhash64("token"), "token").limit(max_words).collect()]
    negatives += [r["token"] for r in clean.orderBy(F.col("n").desc(), "token").limit(max_common).collect()]
    positives, weights = found["token"].tolist(), np.sqrt(found["p"].to_numpy(float))
    if not positives or not negatives:
        return None
    model = _fit_machine(positives, weights, negatives, landmarks)
    for _ in range(2):
        beta, bias = model.beta, model.bias

        def hardest(batches: Iterator[pa.RecordBatch], beta=beta, bias=bias) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = batch.column("token").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(margins(tokens, beta, bias))], ["token", "margin"])

        hard = clean.select("token").mapInArrow(hardest, "token string, margin double").where("margin > -0.7").orderBy(F.col("margin").desc(), "token").limit(max_hard)
        negatives = list(dict.fromkeys([*negatives, *(r["token"] for r in hard.collect())]))
        model = _fit_machine(positives, weights, negatives, landmarks)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            values = model.features((t.as_py() for t in batch.column("text")), cache)
            yield pa.RecordBatch.from_arrays([pa.array(values.tolist(), pa.list_(pa.float64())), batch.column("toxic"), batch.column("weight")], ["x", "toxic", "weight"])

    seen = sample.mapInArrow(measured, "x array<double>, toxic int, weight double").toPandas()
    x = np.column_stack([np.array(seen["x"].tolist()), np.ones(len(seen))])
    model.curve = _logistic(x, seen["toxic"].to_numpy(float), seen["weight"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, grad), -5, 5)
    return w


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(_id, _th, score) of every row."""
    own = keyed(docs)
    if model is None:
        return own.select("_id", "_th", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            scores = shared.value.scores((t.as_py() for t in batch.column("text")), cache)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(scores, pa.float64())], ["_id", "_th", "score"])

    return own.mapInArrow(run, f"_id {own.schema['_id'].dataType.simpleString()}, _th bigint, score double")


def clean_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score under 0.5, all columns kept; trained on ``labelled`` texts."""
    toxic = materialise(scored(docs, fit(labelled, labels)).where("score >= 0.5").select("_id", "_th").distinct(), "toxic-ids")
    return docs.join(toxic, docs["doc_id"].eqNullSafe(toxic["_id"]) & (F.xxhash64(docs["text"]) == toxic["_th"]), "left_anti")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select(F.col("_id").alias("doc_id"), "score").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
