"""Toxicity by a classifier chain (operator 4).

Categories are predicted one after another: a linear model for each, whose
inputs are a text's features and the probabilities of the categories before
it.  When the chain is trained these are out-of-fold predictions, so later
models see them as uncertain as they will be for new texts.

Features are properties of single words: the word without the punctuation
around it, its first four and five letters (which find inflected forms that
were never seen), and the signs that end it.  A feature stands for a property
that at least one, two or three different words of the text have (one only for
whole words and ends).  The ``FEATURES`` with the highest chi-square of each
category are kept, if it is at least ``LEAST_CHI``.

Models are fitted to convergence (L-BFGS until no component of the gradient is
over ``TOLERANCE``); the folds of a category and its final model are tasks of
one Spark job.

Training uses at most ``SAMPLE`` labelled documents, those first by a hash of
their id; of equal texts one is used, with the least id and, for each category,
the greatest label.  The model does not depend on the order of rows.  Scoring
reads every whole text.

Defined cases: a null text counts as empty and gets the models' base rates; a
document with a null label is not used; of several labels for an id the
greatest counts; without labels, or with one class only, a category's
probability is its base rate (0 without labels); rows are scored one by one, so
ties and repeated rows do not matter; extra columns are kept unless named like
an output column, in any case of letters.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import releasing, shared_dir, slices, stored, without

SAMPLE = 12_000
FEATURES = 2048
#: Least chi-square (one degree of freedom), so that words which are in few texts by chance are not learnt.
LEAST_CHI = 20.0
#: A feature is in at least so many texts of the sample.
LEAST_TEXTS = 3
FOLDS = 5
SEED = 20_011
#: Features that a task counts before it sends its counts on.
HELD = 100_000
#: Words of either kind that scoring remembers.
REMEMBERED = 100_000
PENALTY, TOLERANCE, MOST_STEPS = 1e-2, 1e-6, 1000
#: Different words that a feature of first letters may ask for.
DEPTH = 3
EDGE = string.punctuation + string.digits + "¿¡«»…–—“”„’‘"


def word_features(word: bytes) -> list[str]:
    """Properties of a word, each once."""
    text = word.decode("utf-8", "replace").lower()
    core = text.strip(EDGE)
    out = ["w" + core, "4" + core[:4], "5" + core[:5]] if len(core) > 1 else []
    if len(end := text[len(text.rstrip(string.punctuation)) :]) > 1:
        out.append("e" + end)
    return out


def leveled(name: str, words: int) -> list[str]:
    """The features of a property that so many words have."""
    return [f"{name}@{k}" for k in range(1, min(words, DEPTH if name[0] in "45" else 1) + 1)]


def text_features(text: bytes | None) -> list[str]:
    counts = Counter(f for w in set((text or b"").split()) for f in word_features(w))
    return [x for f, n in counts.items() for x in leveled(f, n)]


@dataclass
class Model:
    """A chain: features by place, and for each category its name, weights of the features, of earlier probabilities, bias and threshold."""

    features: dict[str, int]
    names: list[str]
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    bias: list[float]
    threshold: list[float]

    def levels(self) -> dict[str, list[tuple[int, int]]]:
        """Of each property, how many words a feature asks for, and the feature's place."""
        out: dict[str, list[tuple[int, int]]] = {}
        for name, place in self.features.items():
            out.setdefault(name.rsplit("@", 1)[0], []).append((int(name.rsplit("@", 1)[1]), place))
        return out

    def probabilities(self, places: list[int]) -> list[float]:
        out: list[float] = []
        for w, e, b in zip(self.weights, self.earlier, self.bias, strict=True):
            out.append(_sigmoid(float(w[places].sum()) + sum(x * p for x, p in zip(e, out, strict=True)) + b))
        return out


def _sigmoid(z):  # noqa: ANN001, ANN202
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Presence of features in rows, with a few dense columns."""

    def __init__(self, rows: list[list[int]], width: int, dense: np.ndarray) -> None:
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], dtype=np.int32)
        self.n, self.width, self.dense = len(rows), width, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.width :]

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.col, g[self.row], self.width), self.dense.T @ g))


def fit(x: Sparse, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over the rows in use: the minimum of mean loss plus half of ``PENALTY`` times the squared weights."""
    rate = float(y[use].mean()) if use.any() else 0.0
    w = np.append(np.zeros(x.width + x.dense.shape[1]), np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    if rate in (0.0, 1.0):
        return w[:-1], float(w[-1])
    scale, ridge = use / use.sum(), np.append(np.full(len(w) - 1, PENALTY), 0.0)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w[:-1]) + w[-1]
        g = (_sigmoid(z) - y) * scale
        return float((scale * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2), np.append(x.transposed(g), g.sum()) + ridge * w

    loss, g = at(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []  # the last steps and changes of the gradient
    for _ in range(MOST_STEPS):
        if np.abs(g).max() <= TOLERANCE:
            break
        q, used = g.copy(), []
        for s, d in reversed(moves):
            used.append((s @ q) / (s @ d))
            q -= used[-1] * d
        if moves:
            q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1])
        for (s, d), a in zip(moves, reversed(used), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        step, fall = 1.0, float(g @ q)
        while (new := at(w - step * q))[0] > loss - 1e-4 * step * fall and step > 1e-12:
            step /= 2
        if step <= 1e-12:  # no lower place can be told apart
            break
        s, d = -step * q, new[1] - g
        w, loss, g = w + s, *new
        if s @ d > 1e-14:
            moves = [*moves[-9:], (s, d)]
    return w[:-1], float(w[-1])


Fits = Callable[[Sparse, np.ndarray, list[np.ndarray]], list[tuple[np.ndarray, float]]]


def fits_here(x: Sparse, y: np.ndarray, uses: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    return [fit(x, y, use) for use in uses]


def fits_in_tasks(spark: SparkSession) -> Fits:
    """A task for each model; what goes to a task and back is bounded by the sample."""

    def fits(x: Sparse, y: np.ndarray, uses: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    w, b = fit(x, y, uses[i])
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w.tobytes()]), pa.array([b])], names=["i", "w", "b"])

        got = {r["i"]: (np.frombuffer(r["w"]), r["b"]) for r in spark.range(0, len(uses), 1, len(uses)).mapInArrow(releasing(run), "i long, w binary, b double").collect()}
        return [got[i] for i in range(len(uses))]

    return fits


def threshold_of(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities; halfway to the next lower one, and 0.5 where there is nothing to choose."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    k = int(f1.argmax())
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def train_chain(rows: list[list[int]], labels: np.ndarray, features: dict[str, int], names: list[str], folds: np.ndarray, fits: Fits = fits_here) -> Model:
    """A chain over rows of feature places and a column of labels for each category."""
    model = Model(features, names, [], [], [], [])
    earlier = np.zeros((len(rows), 0))
    for k in range(len(names)):
        x, y = Sparse(rows, len(features), earlier), labels[:, k].astype(float)
        out = np.zeros(len(rows))
        *parts, (w, b) = fits(x, y, [*(folds != f for f in range(FOLDS)), np.ones(len(rows), dtype=bool)])
        for f, (wf, bf) in enumerate(parts):
            out[folds == f] = _sigmoid(x.times(wf) + bf)[folds == f]
        model.weights.append(w[: len(features)])
        model.earlier.append(w[len(features) :])
        model.bias.append(b)
        model.threshold.append(threshold_of(out, labels[:, k]))
        earlier = np.column_stack((earlier, out))
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits a chain. categories: for each name, in the chain's order, an SQL expression over the labels table that is 1 or 0."""
    names = list(categories)
    one = labels.select(F.col(key).cast("long").alias("_id"), *(F.expr(e).cast("int").alias(n) for n, e in categories.items())).dropna()
    one = one.groupBy("_id").agg(*(F.max(n).alias(n) for n in names))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")  # at most ``sample`` short rows
    texts = rows.groupBy(F.sha2("text", 256).alias("_text")).agg(F.min("_id").alias("_id"), F.first("text").alias("text"), *(F.max(n).alias(n) for n in names))  # equal texts
    rows = stored(spark, texts, f"{shared_dir(spark, 'toxicity')}/sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        hits = [Counter() for _ in names]

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(seen)
            for k in range(0, len(keys), 10_000):
                part = keys[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[f] for f in part], type=pa.int64()), *(pa.array([h[f] for f in part], type=pa.int64()) for h in hits)], names=["feature", "seen", *names])
            for c in (seen, *hits):
                c.clear()

        for batch, texts in slices(batches, "text"):
            marks = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for i, t in enumerate(texts):
                found = text_features(t)
                seen.update(found)
                for h, m in zip(hits, marks, strict=True):
                    if m[i]:
                        h.update(found)
                if len(seen) >= HELD:
                    yield from flush()
        yield from flush()

    total = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    counts = rows.mapInArrow(releasing(count), "feature string, seen long, " + ", ".join(f"`{n}` long" for n in names)).groupBy("feature").agg(F.sum("seen").alias("seen"), *(F.sum(n).alias(n) for n in names)).where(F.col("seen") >= LEAST_TEXTS)
    counts = stored(spark, counts, f"{shared_dir(spark, 'toxicity')}/features")
    features: dict[str, int] = {}
    for n in names:
        size, with_ = float(total["n"]), float(total[n])
        if not 0 < with_ < size:
            continue
        a, s = F.col(n).cast("double"), F.col("seen").cast("double")
        chi = F.pow(a * size - s * with_, 2) * size / (s * (size - s + 0.5) * with_ * (size - with_))
        for r in counts.where(chi >= LEAST_CHI).orderBy(chi.desc(), "feature").limit(FEATURES).collect():
            features.setdefault(r["feature"], len(features))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = [sorted(features[f] for f in text_features(t) if f in features) for t in texts]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("_id", "_text", *names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, type=pa.list_(pa.int32()))], names=["_id", "_text", *names, "places"])

    got = rows.mapInArrow(releasing(place), "_id long, _text string, " + ", ".join(f"`{n}` int" for n in names) + ", places array<int>").collect()  # at most ``sample`` rows
    got.sort(key=lambda r: (r["_id"], r["_text"]))
    labels_of = np.array([[r[n] for n in names] for r in got], dtype=int).reshape(len(got), len(names))
    folds = np.random.Generator(np.random.PCG64(SEED)).permutation(len(got)) % FOLDS
    return train_chain([r["places"] for r in got], labels_of, features, names, folds, fits_in_tasks(spark))


def probabilities_of(texts: Iterable[bytes | None], model: Model, dull: set[bytes], sharp: dict[bytes, list[str]]) -> np.ndarray:
    """A row of the chain's probabilities for each text. Words without a property that the model knows, and the others with theirs, are remembered between calls."""
    levels: dict[str, list[tuple[int, int]]] = model.levels()
    rows = []
    for t in texts:
        counts: Counter = Counter()
        for w in set(t.split()).difference(dull) if t else ():
            if (known := sharp.get(w)) is None:
                known = [f for f in word_features(w) if f in levels]
                if not known:
                    if len(dull) > REMEMBERED:
                        dull.clear()
                    dull.add(w)
                    continue
                if len(sharp) > REMEMBERED:
                    sharp.clear()
                sharp[w] = known
            counts.update(known)
        rows.append(model.probabilities(sorted(place for f, n in counts.items() for k, place in levels[f] if k <= n)))
    return np.array(rows, dtype=float).reshape(len(rows), len(model.names))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds p_<category> and is_<category> for each category of a chain."""
    added = {f"p_{n}": T.DoubleType() for n in model.names} | {f"is_{n}": T.BooleanType() for n in model.names}
    fields = without(df.schema.fields, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dull: set[bytes] = set()
        sharp: dict[bytes, list[str]] = {}
        for batch, texts in slices(batches, text):
            p = probabilities_of(texts, model, dull, sharp)
            columns = [*(pa.array(p[:, k]) for k in range(p.shape[1])), *(pa.array(p[:, k] >= model.threshold[k]) for k in range(p.shape[1]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *columns], names=[*(f.name for f in fields), *added])

    return df.mapInArrow(releasing(run), T.StructType([*fields, *(T.StructField(n, t) for n, t in added.items())]))


def rejected(df: DataFrame, model: Model, category: str, text: str = "text") -> DataFrame:
    """The rows that the chain does not put into a category, as they are."""
    k = model.names.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dull: set[bytes] = set()
        sharp: dict[bytes, list[str]] = {}
        for batch, texts in slices(batches, text):
            yield batch.filter(pa.array(probabilities_of(texts, model, dull, sharp)[:, k] < model.threshold[k]))

    return df.mapInArrow(releasing(run), df.schema)
