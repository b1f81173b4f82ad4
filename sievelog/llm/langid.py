"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample: at most ``SAMPLE`` documents of
every language that has any, one window of ``WINDOW`` characters of each. Windows and documents are chosen by hash, so the same table gives the same network. Prediction reads whole texts: bytes are cut into
stretches of ``STEPS``, every byte of a stretch gets label probabilities from both directions, and a document's
probabilities are their mean over its bytes.

A null text or one without a letter is ``und`` with score 0, as is every text if nothing could be learned. Repeated rows
are predicted each; ties go to the alphabetically first label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievelog.llm.encoder import tidy
from sievelog.session import ship_package

SAMPLE, WINDOW = 1500, 200
STEPS, HIDDEN, BATCH = 128, 16, 1024
ROWS_AT_ONCE = 1000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights of both directions and of the labels. ``table`` is the input weight of each byte, biases included."""

    labels: list[str]
    table: np.ndarray  # 2 x 256 x 3H
    recurrent: np.ndarray  # 2 x H x 3H
    out: np.ndarray  # (2H + 1) x L

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.3, (2, 256, 3 * hidden))
        table[:, :, :hidden] += 1.0  # gates start mostly keeping
        recurrent = rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden))
        out = rng.normal(0, 0.1, (2 * hidden + 1, len(labels)))
        return cls(labels, *(x.astype(np.float32) for x in (table, recurrent, out)))

    def states(self, data: np.ndarray, direction: int) -> np.ndarray:
        """Hidden states of each step (steps x rows x H); direction 1 runs from the end."""
        rows, steps = data.shape
        size = self.recurrent.shape[1]
        # the gates apart, so that every operation runs over adjoining numbers
        tables = [np.ascontiguousarray(self.table[direction][:, k * size : (k + 1) * size]) for k in range(3)]
        weights = [np.ascontiguousarray(self.recurrent[direction][:, k * size : (k + 1) * size]) for k in range(3)]
        at = np.ascontiguousarray(data.T).astype(np.intp)
        out = np.empty((steps, rows, size), np.float32)
        h = np.zeros((rows, size), np.float32)
        z, r, n, x = (np.empty((rows, size), np.float32) for _ in range(4))
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            for gate, table, u in ((z, tables[0], weights[0]), (r, tables[1], weights[1])):
                np.take(table, at[t], axis=0, out=gate, mode="clip")
                np.matmul(h, u, out=x)
                gate += x
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            np.matmul(h, weights[2], out=n)
            n *= r
            np.take(tables[2], at[t], axis=0, out=x, mode="clip")
            n += x
            np.tanh(n, out=n)
            # h' = n + z (h - n)
            np.subtract(h, n, out=out[t])
            h = out[t]
            h *= z
            h += n
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities of every byte: steps x rows x L."""
        h = self.out.shape[0] // 2
        scores = self.states(data, 0) @ self.out[:h] + self.states(data, 1) @ self.out[h : 2 * h] + self.out[2 * h]
        np.clip(scores, -40, 40, out=scores)
        np.exp(scores, out=scores)
        scores /= scores @ np.ones((scores.shape[-1], 1), np.float32)
        return scores


def _backward(net: Network, data: np.ndarray, states: np.ndarray, grad: np.ndarray, direction: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the recurrent weights from those of all hidden states."""
    table, u = net.table[direction], net.recurrent[direction]
    hs, steps = u.shape[0], data.shape[1]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    order = range(steps - 1, -1, -1) if direction == 0 else range(steps)
    step = -1 if direction == 0 else 1
    carry = np.zeros_like(states[0])
    all_gates = np.empty((steps, len(data), 3 * hs), np.float32)
    for t in order:
        before = states[t + step] if 0 <= t + step < steps else np.zeros_like(states[0])
        gates, hu = table[data[:, t]], before @ u
        z = 1 / (1 + np.exp(-(gates[:, :hs] + hu[:, :hs])))
        r = 1 / (1 + np.exp(-(gates[:, hs : 2 * hs] + hu[:, hs : 2 * hs])))
        n = np.tanh(gates[:, 2 * hs :] + r * hu[:, 2 * hs :])
        g = grad[t] + carry
        d_n = g * (1 - z) * (1 - n * n)
        d_z = g * (before - n) * z * (1 - z)
        d_r = d_n * hu[:, 2 * hs :] * r * (1 - r)
        d_gates = np.concatenate([d_z, d_r, d_n], 1)
        d_hu = np.concatenate([d_z, d_r, d_n * r], 1)
        all_gates[t] = d_gates
        d_u += before.T @ d_hu
        carry = g * z + d_hu @ u.T
    used = data.T.ravel()
    by_byte = np.argsort(used, kind="stable")
    starts = np.flatnonzero(np.diff(used[by_byte], prepend=-1))
    d_table[used[by_byte][starts]] = np.add.reduceat(all_gates.reshape(-1, 3 * hs)[by_byte], starts)
    return d_table, d_u


def fit(samples: list[tuple[bytes, int]], labels: list[str], rounds: int = 200, rows: int = 64, seed: int = 1) -> Network:
    """Train on (bytes, label number) windows with Adam; every byte of a window is to get the window's label."""
    net, rng = Network.fresh(labels, seed=seed), np.random.default_rng(seed)
    cut = [(x[i : i + STEPS], y) for x, y in samples for i in range(0, max(1, len(x) - STEPS // 2), STEPS)]
    data = np.zeros((len(cut), STEPS), np.uint8)
    for i, (x, _) in enumerate(cut):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    target = np.array([y for _, y in cut])
    of_label = [np.flatnonzero(target == k) for k in range(len(labels))]
    weights = [net.table, net.recurrent, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    h = HIDDEN
    for step in range(1, rounds + 1):
        # languages in equal shares
        pick = np.concatenate([rng.choice(k, -(-rows // len(labels))) for k in of_label])
        x, y = data[pick], target[pick]
        forth, back = net.states(x, 0), net.states(x, 1)
        both = np.concatenate([forth, back], -1)
        scores = both @ net.out[: 2 * h] + net.out[2 * h]
        p = np.exp(scores - scores.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        live = (x.T != 0)[:, :, None]
        d = (p - np.eye(len(labels), dtype=np.float32)[y][None]) * live / max(1, live.sum())
        d_both = d @ net.out[: 2 * h].T
        d_out = np.concatenate([np.einsum("tbh,tbl->hl", both, d), d.sum((0, 1))[None]])
        forward, backward = _backward(net, x, forth, d_both[..., :h], 0), _backward(net, x, back, d_both[..., h:], 1)
        grads = [np.stack([forward[k], backward[k]]) for k in (0, 1)] + [d_out]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def remainder(of: int) -> Column:
    """crc32 of the document id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def train(documents: DataFrame, held_out: Column, sample: int = SAMPLE) -> Network:
    """Train on documents that have a language and are not held out."""
    docs = documents.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(True)).alias("_held"))
    docs = docs.where(~F.col("_held") & F.col("lang").isNotNull() & (F.char_length("text") > 0))
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row per language
    if not counts:
        return Network.fresh([])
    labels = sorted(r["lang"] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * sample / r["count"]))])
    h = F.xxhash64("doc_id", "text")
    picked = docs.where(F.pmod(h, F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    start = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1)
    window = F.substring(F.col("text"), start.cast("int") + 1, F.lit(WINDOW))
    rows = picked.select(h.alias("h"), "lang", window.alias("w")).toArrow().to_pylist()
    samples, taken = [], dict.fromkeys(labels, 0)
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"], r["w"])):
        if taken[r["lang"]] < sample:
            taken[r["lang"]] += 1
            samples.append((r["w"].encode(), labels.index(r["lang"])))
    learned = [k for k in labels if taken[k]]
    return fit([(x, learned.index(labels[y])) for x, y in samples], learned) if learned else Network.fresh([])


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities of each text (rows x L), all bytes read."""
    sizes = np.array([len(t) for t in texts])
    stretches = -(-sizes // STEPS)
    owner = np.repeat(np.arange(len(texts)), stretches)
    padded = b"".join(t + bytes(-len(t) % STEPS) for t in texts)
    data = np.frombuffer(padded, np.uint8).reshape(-1, STEPS)
    inside = np.minimum(STEPS, sizes[owner] - STEPS * (np.arange(len(owner)) - (np.cumsum(stretches) - stretches)[owner]))
    total = np.zeros((len(texts), len(net.labels)))
    for at in range(0, len(data), BATCH):
        rows, n = data[at : at + BATCH], inside[at : at + BATCH]
        p = net.positions(rows)
        p[np.arange(STEPS)[:, None] >= n[None]] = 0
        np.add.at(total, owner[at : at + BATCH], p.sum(0))
    return total / np.maximum(sizes, 1)[:, None]


def predict(documents: DataFrame, net: Network) -> DataFrame:
    """(row, lang_pred, score) of every document; ``row`` holds its own columns."""
    spark = documents.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(net)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts = batch.column(0).field("text").to_pylist()
            known = [i for i, t in enumerate(texts) if net.labels and t and _LETTER.search(t)]
            labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            # as many texts at a time as fill a few batches
            at = 0
            while at < len(known):
                group, size = [], 0
                while at < len(known) and (not group or size < BATCH * STEPS):
                    group.append(known[at])
                    size += len(texts[known[at]])
                    at += 1
                p = pooled(net, [texts[i].encode() for i in group])
                for i, row in zip(group, p):
                    labels[i], scores[i] = net.labels[int(row.argmax())], float(min(1.0, row.max()))
            yield pa.record_batch([batch.column(0), pa.array(labels), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), f"row {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents whose crc32 remainder by 3 is not 1, predict all: (row, held_out, lang_pred, score)."""
    held_out = remainder(3) == 1
    net = train(documents, held_out)
    out = predict(documents, net)
    held = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("row", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
