"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded;
a gated attention (a tanh branch times a sigmoid branch) learned from document
labels alone weighs the passages, and the weighted sum is scored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, release, tidy

#: Bytes of UTF-8 in a passage.
PASSAGE = 512
#: Labelled documents that the model is fitted on, at most, and passages of them.
SAMPLE, FITTED = 6000, 100_000
THRESHOLD = 0.3
#: Bytes of text that are encoded at a time, a multiple of PASSAGE; working arrays are about 60 times that.
ENCODED = 1 << 20

_COARSE = 9  # lower, upper, digit, space, line end, stop, other mark, other control, above ASCII


def _tables() -> tuple[np.ndarray, np.ndarray]:
    fine, coarse = np.zeros(256, np.int64), np.full(256, 7, np.int64)
    fine[:] = 127
    fine[:127] = np.arange(127)
    fine[0x80:0xC0], fine[0xC0:] = 127, 126
    for kind, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:?")):
        coarse[[ord(c) for c in chars]] = kind
    marks = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?"]
    coarse[marks], coarse[128:] = 6, 8
    return fine, coarse


FINE, COARSE = _tables()
WIDTH = 128 + _COARSE * _COARSE + 2


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text (1 for an empty one).

    Square roots of the shares of single bytes and of pairs of coarse kinds,
    the share of distinct four-byte sequences, and the passage's length.
    """
    count = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(texts)), size)
    passage = first[owner] + (np.arange(len(data)) - begin[owner]) // PASSAGE
    n = int(count.sum())
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :128] = np.bincount(passage * 128 + FINE[data], minlength=n * 128).reshape(n, 128)
    kind = COARSE[data]
    inside = passage[1:] == passage[:-1]
    pair = (passage[1:] * _COARSE + kind[:-1]) * _COARSE + kind[1:]
    out[:, 128:-2] = np.bincount(pair[inside], minlength=n * _COARSE * _COARSE).reshape(n, -1)
    length = np.bincount(passage, minlength=n).astype(np.float32)
    out[:, :-2] = np.sqrt(out[:, :-2] / np.maximum(length, 1)[:, None])
    if len(data) > 3:
        wide = data.astype(np.uint64)
        four = (wide[:-3] << np.uint64(24)) | (wide[1:-2] << np.uint64(16)) | (wide[2:-1] << np.uint64(8)) | wide[3:]
        key = np.sort(((passage[:-3].astype(np.uint64) << np.uint64(32)) | four)[passage[:-3] == passage[3:]])
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        out[:, -2] = np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=n) / np.maximum(length - 3, 1)
    out[:, -1] = np.log1p(length) / 7
    return out, count


@dataclass
class Model:
    """h = tanh(W x + b); a = softmax(w (tanh(V h) * sigmoid(U h))); p = sigmoid(c . sum(a h) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) * self.scale, count)["p"]

    def score_long(self, text: bytes) -> float:
        """The score of one text of any length, encoded part by part; passages don't reach over a part's end."""
        w, most, total, z = self.weights, -np.inf, 0.0, 0.0
        for at in range(0, len(text), ENCODED):
            x, _ = encode([text[at : at + ENCODED]])
            h, _, _, e = self._gated((x - self.mean) * self.scale)
            top = max(most, float(e.max()))
            own, before = np.exp(e - top), np.exp(most - top)
            most, total, z = top, total * before + own.sum(dtype=np.float64), z * before + own @ h
        return float(1 / (1 + np.exp(-(z / total @ w["c"] + w["d"]))))

    def _gated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, t, s, (t * s) @ w["w"]

    def _forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w, (h, t, s, e) = self.weights, self._gated(x)
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), count))
        a = e / np.repeat(np.add.reduceat(e, start), count)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))}


def gradients(model: Model, x: np.ndarray, count: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the bags ``x`` (scaled) with ``labels``, by each weight."""
    w, f, n = model.weights, model._forward(x, count), len(count)
    doc = np.repeat(np.arange(n), count)
    dz_out = (f["p"] - labels) / n
    dz = dz_out[:, None] * w["c"]
    da = (dz[doc] * f["h"]).sum(axis=1)
    inner = np.bincount(doc, f["a"] * da, n)
    de = f["a"] * (da - inner[doc])
    ds, dt = de[:, None] * w["w"] * f["t"], de[:, None] * w["w"] * f["s"]
    gt, gs = dt * (1 - f["t"] ** 2), ds * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz[doc] + gt @ w["V"].T + gs @ w["U"].T
    du = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ du, "b": du.sum(axis=0), "V": f["h"].T @ gt, "U": f["h"].T @ gs, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dz_out, "d": dz_out.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 48, gate: int = 16, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the cross-entropy of document labels; same bags, same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 0.02)
    del every
    w = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(())}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = Model(mean, scale, w)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = (np.concatenate([bags[i] for i in part]) - mean) * scale
            step += 1
            lr = rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for k, g in gradients(model, x, np.array([len(bags[i]) for i in part]), labels[part]).items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _raw(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _features(batches):
    """(label, text) to (label, features)."""
    for batch in batches:
        for a, b in by_bytes(batch.column(1), ENCODED):
            x, count = encode(_raw(batch.column(1).slice(a, b - a)))
            rows = [p.tobytes() for p in np.split(x, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], ["label", "x"])


def _fitted(batches):
    """(label, features) in a fixed order to one model, from the first rows that have FITTED passages together."""
    bags, labels, held = [], [], 0
    for batch in batches:
        for label, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held <= FITTED:
                bags.append(np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH))
                labels.append(label)
                held += len(bags[-1])
    if len({*labels}) > 1:
        model = fit(bags, np.array(labels, np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fold(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``labels`` (doc_id, label), fitted on at most ``sample`` rows, first by hash of id; None without both labels.

    Texts of over FITTED passages aren't learned from. One task fits the model,
    as rows and passages are bounded; only the model (50 KB) comes to the driver.
    """
    chosen = labels.where("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FITTED * PASSAGE)
    rows = short.join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    features = rows.mapInArrow(tidy(_features), "label int, x binary").repartition(1).sortWithinPartitions(F.xxhash64("x"), "label")
    got = features.mapInArrow(tidy(_fitted), "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def fitted(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int, label_col: str) -> Model | None:
    known = labels.select(labels["doc_id"].alias("doc_id"), labels[label_col].alias("label"))
    return train(docs, known.where(fold(F.col("doc_id"), folds) != held), sample)


def scorer(model: Model | None):
    """The model as a column function of a text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), 0.5)
        for a, b in by_bytes(texts, ENCODED) if model else ():
            raw = _raw(texts.slice(a, b - a))
            if b - a == 1 and len(raw[0]) > ENCODED:
                out[a] = model.score_long(raw[0])
            else:
                out[a:b] = model.score(*encode(raw))
        release()
        return pa.array(np.clip(out, 0, 1), pa.float64())

    return score


def good_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, sample: int = SAMPLE, label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that the classifier of quality_scores keeps, as they are."""
    return docs.where(scorer(fitted(docs, labels, folds, held, sample, label_col))(docs["text"]) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``, read whole.

    The model is fitted here on a bounded sample (``sample`` rows in hash order,
    FITTED passages) of the labelled rows outside fold ``held``; only the text
    is an input of a score, and all of it, in parts where it is long.
    Null and empty texts are one empty passage. Without both labels among the
    rows to learn from every score is 0.5. Repeated rows score alike, null ids
    are held out and never learned from; an empty table gives no rows.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    score = scorer(fitted(own, labels, folds, held, sample, label_col))
    out = own.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
