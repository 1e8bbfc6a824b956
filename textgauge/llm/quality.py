"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of some hundred bytes. Each passage is encoded; gated attention
(tanh of one map times the sigmoid of another) gives it a weight among the passages of its
document; the weighted sum of the encodings gives the score. Only the label of the document is
known, and the attention weights are learned from it.

A passage's input is how often each kind of byte follows each other kind (letters of either case,
digits, kinds of punctuation, spaces, line breaks, bytes of longer characters), so it depends on
neither words nor language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import low_hash, sliced, text_udf, wide_share

PASSAGE = 400
#: Labelled documents a model is fitted on, at most (those with the smallest hash of their id), and passages of them.
FIT_DOCS = 3000
FIT_PASSAGES = 40_000
#: Passages scored at once; bounds the memory a very long text takes.
STEP = 4096
HIDDEN, GATES, ROUNDS, RATE, DECAY = 24, 12, 250, 0.02, 1e-4


def _kinds() -> np.ndarray:
    """A class for each byte."""
    out = np.full(256, 8)
    groups = ((0, " \t"), (1, "\n\r"), (5, "."), (6, ",;:"), (7, "!?"), (9, "()[]{}\"'-"))
    for kind, members in groups:
        out[[ord(c) for c in members]] = kind
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 2, 3, 4
    out[128:192], out[192:] = 10, 11
    return out


KINDS, CLASSES = _kinds(), 12
INPUTS = CLASSES * CLASSES + 1


def inputs(raw: bytes) -> np.ndarray:
    """A row for each passage; one row of zeros but for the constant where there is no text."""
    n = max(1, round(len(raw) / PASSAGE))
    out = np.zeros((n, INPUTS), np.float32)
    out[:, -1] = 1
    if len(raw) > 1:
        data = KINDS[np.frombuffer(raw, np.uint8)]
        at = np.minimum(np.arange(len(raw) - 1) // PASSAGE, n - 1)
        counts = np.bincount(at * (INPUTS - 1) + data[:-1] * CLASSES + data[1:], minlength=n * (INPUTS - 1)).reshape(n, -1)
        out[:, :-1] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    return out


class Attention:
    """Parameters: W (inputs to encoding), V and U (the two maps of the gate), w, and the output c, b."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def start(cls, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)
        scaled = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        return cls({"W": scaled(INPUTS, HIDDEN) * 2, "V": scaled(HIDDEN, GATES), "U": scaled(HIDDEN, GATES), "w": scaled(GATES, 1)[:, 0], "c": scaled(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)})

    def _passages(self, x: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, g, (t * g) @ p["w"]

    def score(self, raw: bytes) -> float:
        """The probability of label 1; the passages of a long text pass through in parts, with a running softmax."""
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, max(1, len(raw)), STEP * PASSAGE):
            part = raw[at : at + STEP * PASSAGE]
            h, _, _, a = self._passages(inputs(part))
            high = max(top, float(a.max()))
            shrink = np.exp(top - high) if np.isfinite(top) else 0.0
            e = np.exp(a - high)
            total, z, top = total * shrink + float(e.sum()), z * shrink + e @ h, high
        return float(1 / (1 + np.exp(-(z / total @ self.p["c"] + self.p["b"][0]))))

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """score() of many documents; short ones pass through together."""
        out, run = np.zeros(len(raws)), []
        for i, raw in enumerate(raws):
            if len(raw) > STEP * PASSAGE // 4:
                out[i] = self.score(raw)
            else:
                run.append(i)
        for group in _groups(run, raws):
            bags = [inputs(raws[i]) for i in group]
            sizes = np.array([len(b) for b in bags])
            starts = np.cumsum(sizes) - sizes
            h, _, _, a = self._passages(np.concatenate(bags))
            e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
            z = np.add.reduceat(h * e[:, None], starts, axis=0) / np.add.reduceat(e, starts)[:, None]
            out[group] = 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["b"][0])))
        return out

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of whole documents, whose passages are the rows of x in runs of `sizes`."""
        p, starts = self.p, np.cumsum(sizes) - sizes
        h, t, g, a = self._passages(x)
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * alpha[:, None], starts, axis=0)
        out = 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))
        d_out = (out - y) / len(sizes)
        d_z = np.repeat(np.outer(d_out, p["c"]), sizes, axis=0)
        d_alpha = (d_z * h).sum(axis=1)
        d_a = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, starts), sizes))
        d_gate = np.outer(d_a, p["w"])
        d_t, d_g = d_gate * g * (1 - t * t), d_gate * t * g * (1 - g)
        d_h = alpha[:, None] * d_z + d_t @ p["V"].T + d_g @ p["U"].T
        return {"W": x.T @ (d_h * (1 - h * h)), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_a, "c": z.T @ d_out, "b": np.array([d_out.sum()])}

    def train(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> Attention:
        """Adam on the mean log loss of whole documents."""
        p, x = self.p, np.concatenate(bags)
        sizes = np.array([len(b) for b in bags])
        y = labels.astype(np.float32)
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            for k, grad in self.gradients(x, sizes, y).items():
                grad = grad.astype(np.float32) + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _groups(run: list[int], raws: list[bytes], room: int = STEP * PASSAGE) -> Iterator[list[int]]:
    group, held = [], 0
    for i in run:
        group.append(i)
        held += len(raws[i]) + PASSAGE
        if held >= room:
            yield group
            group, held = [], 0
    if group:
        yield group


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", fit_docs: int = FIT_DOCS, fit_passages: int = FIT_PASSAGES) -> Attention:
    """A model of `label` from at most `fit_docs` labelled documents and `fit_passages` of their passages (a longer document is not used).

    Labels of rows where `usable` does not hold (an expression on the id) are never read. A document
    with several labels counts with their greatest, null labels do not count, and a label without a
    document, or a document with a null text, is not used. With no labels at all every score is 0.5.
    """
    usable_labels = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    few = low_hash(F.col(id_col), F.lit(wide_share(fit_docs, usable_labels.count())))
    known = usable_labels.where(few).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__label"))
    chosen = known.orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)), "__id").limit(fit_docs)
    sample = docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))  # fit_docs rows at most

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [inputs(t.encode("utf-8", "replace")) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "tie": pdf["tie"], "label": pdf["label"], "bag": [b.tobytes() for b in bags]})

    rows = sample.select(F.col("__id").alias("id"), F.xxhash64(text).alias("tie"), F.col("__label").cast("int").alias("label"), F.col(text).alias("text"))
    # sizes alone settle which documents have room; only those are encoded
    passages = F.greatest(F.lit(1), F.bround(F.octet_length("text") / PASSAGE)).cast("long")
    order = [F.xxhash64("id"), F.col("id"), F.col("tie")]
    sizes = rows.select("id", "tie", passages.alias("n")).where(F.col("n") <= fit_passages)
    room = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # fit_docs rows of three numbers
    picked = sizes.withColumn("__room", room).where(F.col("__room") <= fit_passages).select("id", "tie").distinct()
    got = rows.join(F.broadcast(picked), ["id", "tie"]).select("id", "tie", "label", "text").mapInPandas(encode, "id bigint, tie bigint, label int, bag binary")
    got = sorted(got.collect(), key=lambda r: (r.id, r.tie, r.label, r.bag))
    model = Attention.start()
    if not got:
        model.p["c"][:] = 0
        return model
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, INPUTS) for r in got]
    return model.train(bags, np.array([1 if r.label == 1 else 0 for r in got]))


def score(docs: DataFrame, model: Attention, text: str = "text", to: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 in column `to`, from the whole of each text; a null text scores as an empty one. A column of that name is replaced."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            yield pa.array(model.scores([(t.as_py() or "").encode("utf-8", "replace") for t in texts]), pa.float64())

    return docs.withColumn(to, text_udf(scored, "double")(F.col(text)))
