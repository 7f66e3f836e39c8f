"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from .common import text_or_empty

#: Byte classes whose shares are features.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"?", b".", b",",
    b"|", b"#", b"%", b"$", b"&", b"*", b"'\"`", b"()[]{}<>", b"/\\", b"-_=+~^", b":;", b"@",
)
NAMES = [f"share_{c[:1]!r}" for c in CLASSES] + [
    "share_high", "log_bytes", "log_words", "word_bytes", "distinct_words", "distinct_pairs", "repeated_next",
    "words_a_line", "distinct_lines", "marks_a_word",
]
_TABLE = np.zeros((256, len(CLASSES) + 1), np.float64)
for _k, _c in enumerate(CLASSES):
    _TABLE[list(_c), _k] = 1
_TABLE[128:, len(CLASSES)] = 1
_MARKS = [k for k, c in enumerate(CLASSES) if c in (b"!", b"|", b"#", b"%", b"$", b"&", b"*")]


def features(text: str) -> np.ndarray:
    """Shares of byte classes and repetition figures of one whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / n
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    rest = (
        np.log1p(len(raw)), np.log1p(len(words)), min(len(raw) / k, 50.0), len(set(words)) / k,
        len(set(zip(words, words[1:], strict=False))) / k, sum(map(eq, words, words[1:])) / k,
        np.log1p(k / len(lines)), len(set(lines)) / len(lines), shares[_MARKS].sum() * n / k,
    )
    return np.concatenate((shares, rest)).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(w: list[np.ndarray], x: np.ndarray, batch: int, prior: float | None) -> list[np.ndarray]:
    """Of the risk over ``batch`` positive rows followed by unlabelled ones: plain
    logistic loss without a prior, else the non-negative unbiased risk, whose
    negative part is driven up where it has fallen below zero."""
    h = np.tanh(x @ w[0] + w[1])
    g = h @ w[2] + w[3]
    s = _sigmoid(g)
    if prior is None:
        d = np.concatenate((s[:batch] - 1, s[batch:])) / batch
    else:
        minus = np.concatenate((-prior * s[:batch], s[batch:])) / batch
        plus = np.concatenate((prior * (s[:batch] - 1), np.zeros(len(x) - batch))) / batch
        risk = np.logaddexp(0, g[batch:]).mean() - prior * np.logaddexp(0, g[:batch]).mean()
        d = plus + minus if risk >= 0 else -minus
    d = d.astype(w[2].dtype)
    back = np.outer(d, w[2]) * (1 - h * h)
    return [x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16,
         steps: int = 1000, rate: float = 0.01, decay: float = 1e-4, batch: int = 768, seed: int = 7) -> dict:
    """One hidden layer, logistic loss, Adam, averaged weights.

    With a prior it minimises prior*R_p^+ + max(0, R_u^- - prior*R_p^-): where
    the estimate of the negative part falls below zero, the step goes up its
    gradient instead, so that the model can't fit the negative risk away.
    Without one it tells positive from unlabelled rows.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate((positive, unlabelled))
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    w = [x.astype(np.float32) for x in w]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
    average = [x.copy() for x in w]
    for step in range(1, steps + 1):
        x = np.concatenate((p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]))
        grads = gradients(w, x, batch, prior)
        grads[0] += decay * w[0]
        grads[2] += decay * w[2]
        now = rate * (0.1 if step > 0.7 * steps else 1)
        for k, grad in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w[k] = w[k] - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            average[k] += (w[k] - average[k]) * 0.02
    return {"mean": mean, "scale": scale, "w": average}


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 4) -> float:
    """Share of positives among unlabelled rows: the least ratio, over all score
    thresholds, of unlabelled to positive rows above it. Negatives only add to
    the numerator, so the ratio comes down to the prior where few are left; a
    margin for chance keeps thresholds with few rows out. Every row is scored by
    a model that was fitted without its fold.

    The ratio errs upwards, the more the fewer rows there are, so two of its
    standard errors are taken off. A single row of a kind tells nothing: 0.5.
    """
    folds = min(folds, len(positive), len(unlabelled))
    if folds < 2:
        return 0.5
    rng = np.random.default_rng(3)
    sides = [(x, rng.permutation(len(x)) % folds) for x in (positive, unlabelled)]  # folds alike whatever the order
    scores = [np.empty(len(x)) for x, _ in sides]
    for k in range(folds):
        model = _fit(*(x[fold != k] for x, fold in sides), None)
        for out, (x, fold) in zip(scores, sides, strict=True):
            out[fold == k] = posterior(model, x[fold == k])
    sp, su = map(np.sort, scores)
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    over_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    over_u = 1 - np.searchsorted(su, cuts) / len(su)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((over_u + margin) / over_p)
    ratio = min(over_u[best] / over_p[best], 1.0)
    error = np.sqrt(ratio * (1 - ratio) * (1 / len(sp) + 1 / len(su)))
    return float(np.clip(ratio - 2 * error, 0.02, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> dict:
    """The model that minimises the non-negative unbiased risk; the class prior
    is estimated where none is given. Without a row of either kind, every score
    is the prior, or 0.5."""
    if not len(positive) or not len(unlabelled):
        return {"constant": 0.5 if prior is None else prior}
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    return _fit(positive, unlabelled, prior) | {"prior": prior}


def posterior(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    w = model["w"]
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return _sigmoid(np.tanh(z @ w[0] + w[1]) @ w[2] + w[3])


def fit_quality(docs: DataFrame, labels: DataFrame, trusted, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample: int = 12_000, prior: float | None = None) -> dict:
    """The fitted model. Trusted positives are documents with label 1 in ``labels``
    for which the column ``trusted`` (over ``id``) holds; unlabelled text is
    that of all documents, whether labels name them or not. Up to ``sample``
    documents of each kind are used, those with the smallest hash of their id;
    only their features reach the driver.

    Rows with a null id never train; of rows with one id, the least text does,
    null counting as empty. Repeated labels of an id count once, as positive only
    if all say 1. Other columns are ignored, whatever their names. Without enough
    rows of both kinds, as of empty tables, every score is ``prior``, or 0.5.
    """
    ship(docs.sparkSession)
    ids = docs.select(docs[id_col].cast("long").alias("id")).where("id is not null").distinct()
    known = labels.groupBy(labels[id_col].cast("long").alias("id")).agg(F.min(labels[label_col]).alias("y"))
    narrow = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("t"))

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])

    def drawn(rows: DataFrame) -> np.ndarray:
        few = rows.select("id", F.xxhash64("id", F.lit(11)).alias("o")).orderBy("o", "id").limit(sample).select("id")
        texts = narrow.join(F.broadcast(few), "id").groupBy("id").agg(F.min("t").alias("t"))  # ``sample`` ids at most
        got = texts.mapInArrow(run, "id long, x array<float>").toPandas().sort_values("id")["x"]  # tasks end in any order
        return np.array(got.tolist(), np.float64).reshape(len(got), len(NAMES))

    positive = drawn(ids.join(known.where("y = 1").where(trusted), "id", "left_semi"))
    return fit_pu(positive, drawn(ids), prior)


def _scores(model: dict, texts: list[str]) -> np.ndarray:
    x = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))
    return posterior(model, x)


def quality_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of ``docs``, 0 to 1, from the whole text alone. Null
    text counts as empty and gets the model's score for the empty text; other
    columns are ignored; no rows give no rows."""

    def run(batches):
        for batch in batches:
            got = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["id", "score"])

    ship(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(docs, text_col).alias("t"))
    return narrow.mapInArrow(run, "id long, score double")


def quality_filter(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, unchanged, with
    all columns, whatever their names. Null text has the score of the empty text;
    repeated rows go or stay together; no rows give no rows."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(_scores(model, texts) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
