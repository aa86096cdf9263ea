"""Language identification with a bidirectional gated recurrent network over bytes, in numpy alone.

Texts are read as UTF-8 in segments of ``SEGMENT`` bytes, each with a state of its own. One gated recurrent unit
reads a segment forwards, another backwards; at every byte the two states give a probability for each language.
A document's probabilities are the mean over all its bytes. The network is trained by backpropagation through time
(Adam) on ``PER_DOCUMENT`` segments of ``LENGTH`` bytes, drawn anywhere, of each of at most ``SAMPLE`` labelled documents. All languages of labelled documents with a text are
known to it: they share the sample evenly, what rare ones leave over goes to the others, and of each language the
documents with the least seeded hash of their id are taken. With more languages than ``SAMPLE``, each gets one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, kind

HIDDEN, SEGMENT, CHUNK = 8, 128, 4096
SAMPLE, PER_DOCUMENT, STEPS, BATCH, LENGTH, RATE, SEED = 800, 12, 260, 128, 64, 0.02, 5
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """E: gate inputs for each direction and byte; U: recurrent weights; V, c: the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.weights = {
            "E": rng.normal(0, 0.5, (2, 257, 3 * hidden)),
            "U": rng.normal(0, 0.5 / hidden**0.5, (2, hidden, 3 * hidden)),
            "V": rng.normal(0, 0.5 / hidden**0.5, (2, hidden, len(languages))),
            "c": np.zeros(len(languages)),
        }

    # -- training ---------------------------------------------------------------------------------------------

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted cross-entropy over all bytes of the segments x (PAD behind their end), and its gradients."""
        w, n = self.weights, self.hidden
        count, length = x.shape
        both = np.stack([x, x[:, ::-1]])
        mask = (both != PAD)[..., None]
        h = np.zeros((2, count, n))
        steps, states = [], np.zeros((length + 1, 2, count, n))
        for t in range(length):
            g = np.stack([w["E"][d, both[d, :, t]] for d in (0, 1)])
            a = h @ w["U"]
            r, z = _sigmoid(g[..., :n] + a[..., :n]), _sigmoid(g[..., n : 2 * n] + a[..., n : 2 * n])
            new = np.tanh(g[..., 2 * n :] + r * a[..., 2 * n :])
            steps.append((r, z, new, a[..., 2 * n :]))
            h = ((1 - z) * new + z * h) * mask[:, :, t]
            states[t + 1] = h
        forward, backward = states[1:, 0], states[:0:-1, 1]
        logits = forward @ w["V"][0] + backward @ w["V"][1] + w["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        each = (x.T != PAD) * weight
        total = each.sum()
        loss = -(np.log(np.take_along_axis(p, np.broadcast_to(y, (length, count))[..., None], -1)[..., 0] + 1e-12) * each).sum() / total
        d_logits = p.copy()
        d_logits[:, np.arange(count), y] -= 1
        d_logits *= each[..., None] / total
        grad = {"V": np.stack([np.einsum("tbh,tbl->hl", s, d_logits) for s in (forward, backward)]), "c": d_logits.sum((0, 1)), "U": np.zeros_like(w["U"])}
        d_out = np.stack([d_logits @ w["V"][0].T, (d_logits @ w["V"][1].T)[::-1]], axis=1)
        d_gates = np.zeros((length, 2, count, 3 * n))
        d_h = np.zeros((2, count, n))
        for t in range(length - 1, -1, -1):
            r, z, new, a = steps[t]
            d_h = (d_h + d_out[t]) * mask[:, :, t]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_r, d_z = d_new * a * r * (1 - r), d_h * (states[t] - new) * z * (1 - z)
            d_a = np.concatenate([d_r, d_z, d_new * r], axis=-1)
            d_gates[t] = np.concatenate([d_r, d_z, d_new], axis=-1)
            grad["U"] += np.swapaxes(states[t], 1, 2) @ d_a
            d_h = d_h * z + d_a @ np.swapaxes(w["U"], 1, 2)
        grad["E"] = np.zeros_like(w["E"])
        for d in (0, 1):
            at, flat = both[d].T.ravel(), d_gates[:, d].reshape(-1, 3 * n)
            for k in range(3 * n):
                grad["E"][d, :, k] = np.bincount(at, flat[:, k], 257)
        return float(loss), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """Adam over seeded batches of segments; every language weighs the same."""
        rng = np.random.default_rng(seed)
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.languages)), 1)[y]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        chance = weight / weight.sum()
        for step in range(1, steps + 1):
            at = rng.choice(len(x), min(batch, len(x)), p=chance)
            _, grad = self.gradients(x[at], y[at], np.ones(len(at)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.weights[k] = self.weights[k] - rate * min(1.0, 2 - 2 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)

    # -- use --------------------------------------------------------------------------------------------------

    def positions(self, x: np.ndarray, padded: bool) -> np.ndarray:
        """Probabilities (byte, segment, language), from segments laid out byte by byte."""
        n, (length, count) = self.hidden, x.shape
        half = np.concatenate([np.full(2 * n, 0.5), np.ones(n)])  # sigmoid(x) is (1 + tanh(x / 2)) / 2
        e = (self.weights["E"] * half).astype(np.float32)
        u = (self.weights["U"] * half).astype(np.float32)
        v, c = self.weights["V"].astype(np.float32), self.weights["c"].astype(np.float32)
        out = np.empty((length, count, len(self.languages)), np.float32)
        a, g = np.empty((count, 3 * n), np.float32), np.empty((count, 3 * n), np.float32)
        for d in (0, 1):
            h = np.zeros((count, n), np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                np.take(e[d], x[t], axis=0, out=g, mode="clip")
                np.matmul(h, u[d], out=a)
                gates = np.tanh(g[:, : 2 * n] + a[:, : 2 * n])
                gates += 1
                gates *= 0.5
                new = a[:, 2 * n :] * gates[:, :n]
                new += g[:, 2 * n :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:, n:]
                h += new
                if padded:
                    h[x[t] == PAD] = 0
                if d == 0:
                    np.matmul(h, v[0], out=out[t])
                else:
                    out[t] += h @ v[1]
        out += c
        out -= out.max(axis=-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=-1, keepdims=True)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document, the sum of its bytes' probabilities, and how many bytes are labelled as which."""
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = offsets[:-1][owner] + inside * SEGMENT
        lengths = np.minimum(SEGMENT, offsets[1:][owner] - starts)
        total = np.zeros((len(size), len(self.languages)))
        count = np.zeros((len(size), len(self.languages)), np.int64)
        order = np.argsort(-lengths, kind="stable")
        for first in range(0, len(order), CHUNK):
            at = order[first : first + CHUNK]
            longest, padded = int(lengths[at[0]]), lengths[at[0]] != lengths[at[-1]]
            place = starts[at] + np.arange(longest)[:, None]
            x = data[np.minimum(place, len(data) - 1)].astype(np.int16)
            if padded:
                x[np.arange(longest)[:, None] >= lengths[at]] = PAD
            p = self.positions(x, bool(padded))
            label = p.argmax(axis=-1)
            if padded:
                p[x == PAD] = 0
                label[x == PAD] = -1
            np.add.at(total, owner[at], p.sum(axis=0, dtype=np.float64))
            for k in range(len(self.languages)):
                np.add.at(count[:, k], owner[at], np.count_nonzero(label == k, axis=0))
        return total, count


def segments(texts: list[str], length: int = LENGTH, most: int = PER_DOCUMENT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Training segments (PAD behind their end) of each text, and the number of its text."""
    rng, x, owner = np.random.default_rng(seed), [], []
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        starts = np.arange(0, len(raw), length)
        for s in rng.permutation(starts)[:most]:
            row = np.full(length, PAD, np.int64)
            row[: len(raw[s : s + length])] = raw[s : s + length]
            x.append(row)
            owner.append(k)
    return np.array(x, np.int64).reshape(-1, length), np.array(owner, np.int64)


def shares(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """How many documents of each language to take: evenly, but for those that have fewer; one at least."""
    out: dict[str, int] = {}
    for y, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        out[y] = max(1, min(n, (sample - sum(out.values())) // (len(sizes) - len(out))))
    return out


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    sample: int = SAMPLE, per_document: int = PER_DOCUMENT, steps: int = STEPS, seed: int = SEED,
) -> Network | None:
    """A network from at most `sample` labelled documents, but one of each language at least; None where none has a
    label and a text. Of each, `per_document` segments of LENGTH bytes are taken, drawn from the whole text."""
    text = col(text_col).cast("string")
    rows = docs.select(text.alias("t"), col(lang_col).cast("string").alias("y"), F.xxhash64(F.lit(seed), col(id_col).cast("string")).alias("h"), F.length(text).alias("n")).filter("y IS NOT NULL AND n > 0")
    share = shares({r[0]: r[1] for r in rows.groupBy("y").count().collect()}, sample) if sample > 0 else {}
    if not share:
        return None
    spark = docs.sparkSession
    each = Window.partitionBy("y").orderBy("o")
    rows = rows.select("y", F.struct("h", "n", F.xxhash64("t").alias("x")).alias("o"), "t")
    most = max(share.values())
    granted = F.broadcast(spark.createDataFrame(list(share.items()), "y string, share long"))
    # The last place of each language first, so that few texts but the sample's own are moved.
    placed = rows.select("y", "o").withColumn("r", F.row_number().over(each)).filter(F.col("r") <= most)
    last = placed.join(granted, "y").filter("r <= share").groupBy("y", "share").agg(F.max("o").alias("last")).collect()
    bounds = F.broadcast(spark.createDataFrame([(r.y, r.share, r.last.h, r.last.n, r.last.x) for r in last], "y string, share long, h long, n int, x long").select("y", "share", F.struct("h", "n", "x").alias("last")))
    near = rows.join(bounds, "y").filter("o <= last").withColumn("r", F.row_number().over(each)).filter(F.col("r") <= most)
    rows = near.filter("r <= share").orderBy("o", "y").select("t", "y").collect()
    languages = sorted({r.y for r in rows})
    network = Network(languages, seed=seed)
    x, owner = segments([r.t for r in rows], most=per_document)
    network.fit(x, np.array([languages.index(r.y) for r in rows])[owner], steps)
    return network


def _label(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = network.value.languages
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                texts = batch.column(1).fill_null("")
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                total, count = network.value.documents(data, offsets)
                size = np.diff(offsets)
                best = total.argmax(axis=1)
                lang = [names[k] if n else None for k, n in zip(best.tolist(), size.tolist())]
                sure = [float(p / n) if n else None for p, n in zip(total[np.arange(len(best)), best].tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(size), pa.array([names] * len(size), pa.list_(pa.string())), pa.array(count.tolist(), pa.list_(pa.int64()))], names=["doc_id", "lang", "confidence", "n_bytes", "languages", "position_counts"])

    return run


def identify(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    sample: int = SAMPLE, per_document: int = PER_DOCUMENT, steps: int = STEPS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, lang, confidence, n_bytes, languages, position_counts) for every row of docs, in place.

    confidence is the document's probability of lang, position_counts says how many bytes are labelled as each of
    languages. Ties go to the first language. Null and empty texts have null lang and confidence and no bytes.
    Ids keep their type; repeated rows, and rows without an id, get rows of their own; long texts are labelled whole,
    byte by byte; an empty table gives an empty result; other columns are never looked at, whatever their names. The
    network is trained on labelled (docs itself if not given), on a sample that is bounded by the parameters `sample`
    (documents) and `per_document` (segments of each, drawn from its whole text); where that has no labels, every lang
    is null and there are no languages.
    """
    network = train(docs if labelled is None else labelled, id_col, text_col, lang_col, sample=sample, per_document=per_document, steps=steps, seed=seed)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("t"))
    schema = f"doc_id {kind(docs, id_col)}, lang string, confidence double, n_bytes long, languages array<string>, position_counts array<long>"
    if network is None:
        none = F.array().cast("array<string>"), F.array().cast("array<long>")
        return rows.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"), none[0].alias("languages"), none[1].alias("position_counts"))
    return rows.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(network)), schema)
