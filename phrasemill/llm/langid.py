"""Language identification with a byte convolutional network (operator 3).

The network embeds bytes, convolves them with filters of several widths, takes each filter's maximum over a window and
ends in a softmax. It is trained here with plain gradient steps in numpy on SAMPLE labelled windows at most, a documented bound,
drawn by a hash of the row from whole texts. Prediction covers each whole text with overlapping windows of fixed length and
averages their probabilities, weighted by the bytes they hold.

Results: a text that is null or has no letter is `und` with score 0; so is every text where there is nothing to learn
from; ties go to the first language in alphabetical order; equal texts get equal results; texts of any length are read whole.
Only the id, text and label columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 6
#: Labelled windows that training takes at most, dealt evenly to the languages.
SAMPLE = 8000
STRIDE = WINDOW - max(WIDTHS) + 1
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """Weights; embed (256, EMBED), one filter bank (width * EMBED, FILTERS) and bias a width, output (features, classes)."""

    labels: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            labels,
            draw(256, EMBED, scale=0.5),
            [draw(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            draw(len(WIDTHS) * FILTERS, len(labels), scale=0.2),
            np.zeros(len(labels), np.float32),
        )

    def train(self, windows: np.ndarray, classes: np.ndarray, steps: int = 1500, rate: float = 0.004, batch: int = 64, seed: int = 11) -> None:
        """Adam on the cross entropy; windows (n, WINDOW) uint8."""
        rng = np.random.default_rng(seed)
        weights = [self.embed, *self.banks, *self.biases, self.out, self.out_bias]
        first, second, step = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights], 0
        while step < steps:
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                step += 1
                for x, g, m, v in zip(weights, self.gradients(windows[order[at : at + batch]], classes[order[at : at + batch]]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def gradients(self, windows: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        n, rows = len(windows), np.arange(len(windows))[:, None]
        embedded = self.embed[windows]
        columns, tops, pooled = [], [], []
        for w, bank, bias in zip(WIDTHS, self.banks, self.biases, strict=True):
            size = WINDOW - w + 1
            cols = np.concatenate([embedded[:, i : i + size] for i in range(w)], axis=2)
            scores = cols @ bank + bias
            top = scores.argmax(axis=1)
            columns.append(cols[rows, top])
            tops.append(top)
            pooled.append(np.take_along_axis(scores, top[:, None], axis=1)[:, 0])
        features = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = features @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), classes] -= 1
        p /= n
        back = (p @ self.out.T) * (features > 0)
        embed, banks, biases = np.zeros_like(self.embed), [], []
        for k, (w, bank) in enumerate(zip(WIDTHS, self.banks, strict=True)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            banks.append(np.einsum("nf,nfc->cf", d, columns[k]))
            biases.append(d.sum(axis=0))
            through = d[:, :, None] * bank.T[None]
            for i in range(w):
                np.add.at(embed, windows[rows, tops[k] + i], through[:, :, i * EMBED : (i + 1) * EMBED])
        return [embed, *banks, *biases, features.T @ p, p.sum(axis=0)]

    def probabilities(self, windows: np.ndarray, block: int = 96) -> np.ndarray:
        """(n, classes) of windows (n, WINDOW) uint8, block by block."""
        out = np.zeros((len(windows), len(self.labels)), np.float32)
        widest = max(WIDTHS)
        bank = np.zeros((len(WIDTHS) * FILTERS, widest * EMBED), np.float32)
        for k, (w, b) in enumerate(zip(WIDTHS, self.banks, strict=True)):
            bank[k * FILTERS : (k + 1) * FILTERS, : w * EMBED] = b.T
        for at in range(0, len(windows), block):
            stream = windows[at : at + block].reshape(-1)
            n = len(stream) // WINDOW
            columns = np.zeros((widest * EMBED, len(stream)), np.float32)
            for e in range(EMBED):
                np.take(self.embed[:, e], stream, out=columns[e])
                for i in range(1, widest):
                    columns[i * EMBED + e, :-i] = columns[e, i:]
            scores = (bank @ columns).reshape(len(bank), n, WINDOW)
            features = np.empty((n, len(bank)), np.float32)
            for k, w in enumerate(WIDTHS):
                # The last positions of a window would reach into the next one.
                features[:, k * FILTERS : (k + 1) * FILTERS] = scores[k * FILTERS : (k + 1) * FILTERS, :, : WINDOW - w + 1].max(axis=2).T + self.biases[k]
            logits = np.maximum(features, 0) @ self.out + self.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + n] = p / p.sum(axis=1, keepdims=True)
        return out


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows that cover all of data, the last filled up with spaces, and the bytes that each holds."""
    n = max(1, -(-(len(data) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.full((n - 1) * STRIDE + WINDOW, 32, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    starts = np.arange(n) * STRIDE
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts], np.minimum(WINDOW, len(data) - starts)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def predict_texts(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    chosen, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if net else []
    if not known:
        return chosen, scores
    parts = [windows_of(prepared(texts[i])) for i in known]
    p = net.probabilities(np.concatenate([w for w, _ in parts]))
    at = 0
    for i, (windows, held) in zip(known, parts, strict=True):
        mean = (p[at : at + len(windows)].astype(np.float64) * held[:, None]).sum(axis=0) / held.sum()
        at += len(windows)
        chosen[i] = net.labels[int(mean.argmax())]
        scores[i] = float(min(1.0, max(0.0, mean.max())))
    return chosen, scores


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """Trains on `sample` windows of labelled rows at most: of each language the rows of smallest hash, three windows of each text."""
    rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y")).where("y is not null and t is not null and t rlike '\\\\p{L}'")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = sample / len(sizes) / 3
    share = F.element_at(F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, each / n))]), F.col("y"))
    drawn = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30) < share)
    spots = [F.expr(f"substring(t, 1 + cast(pmod(xxhash64(t, {k}), greatest(char_length(t) - {WINDOW}, 1)) as int), {WINDOW})") for k in range(3)]
    got = drawn.select("y", F.explode(F.array_distinct(F.array(*spots))).alias("w")).distinct().orderBy("y", "w").limit(2 * sample).toPandas()
    got = got[got["w"].map(has_letter)]
    if not len(got):
        return None
    net = ByteNet.new(sorted(got["y"].unique()))
    place = {y: i for i, y in enumerate(net.labels)}
    windows = np.stack([windows_of(prepared(w)[:WINDOW])[0][0] for w in got["w"]])
    net.train(windows, got["y"].map(place).to_numpy())
    return net


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(keys, texts):
            chosen, scores = predict_texts(shared.value, texts)
            return pa.RecordBatch.from_arrays([keys, pa.array(chosen, pa.string()), pa.array(scores, pa.float64())], ["_id", "lang_pred", "score"])

        return work

    return map_texts(docs, id_col, text_col, f"_id {kind}, lang_pred string, score double", make).withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, net: ByteNet | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose language is determined with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def run(batches):
        from .common import text_slices

        for batch in text_slices(batches, text_col):
            chosen, scores = predict_texts(shared.value, batch.column(place).to_pylist())
            yield batch.filter(pa.array([c != UNDETERMINED and s >= least for c, s in zip(chosen, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
