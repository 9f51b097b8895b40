"""Language identification with a byte-level convolutional network, trained and applied in numpy.

Filters of several widths slide over the bytes of a fixed-length window; the largest response of each filter over the
window goes through a rectifier to a softmax over the languages. A filter is a table of weights for each byte value at
each of its places. A text is cut into windows from end to end, and its windows' probabilities are averaged by their
lengths. Windows of many texts go through the network together, one position of all windows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import small_batches
from ._words import tidy

UNDETERMINED = "und"


class ByteCNN:
    """tables[w]: (width, 256, filters); bias[w]: (filters); dense: (filters of all widths + 1, classes)."""

    def __init__(self, classes: int, widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, window: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.window, self.widths = window, widths
        self.tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.bias = [np.zeros(filters, np.float32) for _ in widths]
        self.dense = rng.normal(0, 0.2, (len(widths) * filters + 1, classes)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.dense]

    def _head(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense[:-1] + self.dense[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean loss over windows x (windows, bytes) with classes y."""
        n, pooled, best = len(x), [], []
        for t, b, w in zip(self.tables, self.bias, self.widths, strict=True):
            size = x.shape[1] - w + 1
            conv = sum(t[k][x[:, k : k + size]] for k in range(w))
            at = conv.argmax(axis=1)
            best.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0] + b)
        pooled = np.concatenate(pooled, axis=1)
        p = self._head(pooled)
        loss = -float(np.log(p[np.arange(n), y] + 1e-12).mean())
        p[np.arange(n), y] -= 1
        p /= n
        h = np.maximum(pooled, 0)
        grad_dense = np.concatenate([h.T @ p, p.sum(axis=0, keepdims=True)])
        back = (p @ self.dense[:-1].T) * (pooled > 0)
        grads, f = [], self.bias[0].size
        for i, (t, at, w) in enumerate(zip(self.tables, best, self.widths, strict=True)):
            g, part = np.zeros_like(t), back[:, i * f : (i + 1) * f]
            for k in range(w):
                byte = np.take_along_axis(x, at + k, 1)
                np.add.at(g[k], (byte, np.arange(f)[None, :]), part)
            grads.append(g)
        return [*grads, *(back[:, i * f : (i + 1) * f].sum(axis=0) for i in range(len(self.widths))), grad_dense], loss

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam, with windows of random lengths: the rest of a window is zero, as at the end of a text."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, steps + 1):
            i = rng.integers(0, len(x), batch)
            part = x[i].copy()
            short = rng.integers(20, part.shape[1] + 1, batch)
            short[rng.random(batch) < 0.5] = part.shape[1]
            part[np.arange(part.shape[1])[None, :] >= short[:, None]] = 0
            grads, _ = self.step(part, y[i])
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return self

    def ready(self) -> ByteCNN:
        """Tables over byte pairs, so that two places of a filter take one look-up."""
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, -1))
        self.pairs = [[pair(t[k], t[k + 1]) for k in range(0, w - 1, 2)] + ([t[-1].copy()] if w % 2 else []) for t, w in zip(self.tables, self.widths, strict=True)]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for windows x (windows, bytes)."""
        cols = np.ascontiguousarray(x.T).astype(np.intp)
        two = cols[:-1] * 256 + cols[1:]
        acc = [np.full((len(x), b.size), -np.inf, np.float32) for b in self.bias]
        tmp, more = np.empty_like(acc[0]), np.empty_like(acc[0])
        for i in range(x.shape[1]):
            for parts, w, best in zip(self.pairs, self.widths, acc, strict=True):
                if i + w > x.shape[1]:
                    continue
                np.take(parts[0], two[i], axis=0, out=tmp, mode="clip")
                for k, part in enumerate(parts[1:], 1):
                    np.take(part, two[i + 2 * k] if part.shape[0] > 256 else cols[i + 2 * k], axis=0, out=more, mode="clip")
                    np.add(tmp, more, out=tmp)
                np.maximum(best, tmp, out=best)
        return self._head(np.concatenate([a + b for a, b in zip(acc, self.bias, strict=True)], axis=1))


def _windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, padded with zeros, and how many each text has."""
    many = np.array([max(1, -(-len(t) // length)) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(m * length, b"\0") for t, m in zip(texts, many.tolist(), strict=True)), np.uint8).reshape(-1, length), many


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600, length: int = 256, steps: int = 400) -> tuple[list[str], ByteCNN | None]:
    """A network for the languages of docs, and their names, sorted.

    Learns from at most `per_language` documents of each language, those with the smallest hashes of their key and text, and
    of each from at most 512 characters at a place that the hash chooses. The rows of each language are counted first; only
    those below a hash that about `per_language` and a third more are expected under are ranked, so that no task gets more of
    a frequent language. One row for each language, and the sample, come to the driver. Rows without text or language are
    left out.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return [], None
    most = per_language + 8 * per_language**0.5
    below = [min((1 << 63) - 1, int(min(1, most / r["count"]) * (1 << 64)) - (1 << 63)) for r in counts]
    bound = F.create_map(*[x for r, b in zip(counts, below, strict=True) for x in (F.lit(r.lang), F.lit(b).cast("long"))])
    order = Window.partitionBy("lang").orderBy("h", "snippet")
    snippet = F.substring("text", F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - 512)).cast("int") + 1, F.lit(512))
    sample = usable.where(F.col("h") <= bound[F.col("lang")]).select("lang", "h", snippet.alias("snippet")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    rows = sample.orderBy("lang", "k").select("lang", "snippet").collect()
    names = sorted({r.lang for r in rows})
    x, many = _windows([r.snippet.encode()[: 2 * length] for r in rows], length)
    y = np.repeat([names.index(r.lang) for r in rows], many)
    # each language counts alike
    rng, size = np.random.default_rng(3), np.bincount(y, minlength=len(names))
    pick = np.concatenate([rng.choice(np.flatnonzero(y == c), size.max()) for c in range(len(names))])
    return names, ByteCNN(len(names), window=length).fit(x[pick], y[pick], steps)


def _apply(shared, with_text: bool, batch_windows: int = 1024):
    def rows(batches):
        names, net = shared.value
        net.ready()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [(t or "").encode() if ok else b"" for t, ok in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                score, total = np.zeros((len(texts), len(names))), np.zeros(len(texts))
                for k, p, size in _scored(net, texts, batch_windows):
                    np.add.at(score, k, p * size[:, None])
                    np.add.at(total, k, size)
                mean = score / np.maximum(total, 1)[:, None]
                best = mean.argmax(axis=1)
                ok = [len(t) > 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(c for k, c in enumerate(part.columns) if k != 2 and (k != 1 or with_text)), pa.array([names[b] if o else UNDETERMINED for b, o in zip(best, ok, strict=True)]), pa.array(np.where(ok, np.clip(mean.max(axis=1), 0, 1), 0.0))],
                    names=[*(c for k, c in enumerate(part.schema.names) if k != 2 and (k != 1 or with_text)), "lang_pred", "score"],
                )

    return rows


def _scored(net: ByteCNN, texts: list[bytes], most: int):
    """(text, probabilities, bytes) of all windows, `most` windows at a time, however long a text is."""
    held, owner, sizes = [], [], []
    for k, t in enumerate(texts):
        for a in range(0, len(t), net.window):
            held.append(t[a : a + net.window])
            owner.append(k)
            sizes.append(len(held[-1]))
            if len(held) == most:
                yield np.array(owner), net.predict(_windows(held, net.window)[0]), np.array(sizes)
                held, owner, sizes = [], [], []
    if held:
        yield np.array(owner), net.predict(_windows(held, net.window)[0]), np.array(sizes)


def identify(docs: DataFrame, names: list[str], net: ByteCNN | None, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred (a name, or `und` if the text is null or has no letter) and score (0 to 1; 0 for `und`) of each row.

    Whole texts are read, of any length. Rows with one id, or a null id, are judged each for itself; an empty table gives
    an empty result; other columns are ignored, but that those named in `carry` come back. Without a network (nothing to learn from) every row is `und`.
    """
    small_batches(docs.sparkSession)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    carry = carry or []
    with_text, others = text in carry, [c for c in carry if c != text]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), letters.alias("letters"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(others)))
    back = [F.col("text").alias(text)] * with_text + [F.col(f"carry_{k}").alias(c) for k, c in enumerate(others)]
    if net is None:
        return rows.select("doc_id", *back, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((names, net))
    kept = ", text string" * with_text + "".join(f", carry_{k} {rows.schema[f'carry_{k}'].dataType.simpleString()}" for k in range(len(others)))
    return rows.mapInArrow(tidy(_apply(shared, with_text)), f"doc_id long{kept}, lang_pred string, score double").select("doc_id", *back, "lang_pred", "score")


def held_out(key: str = "doc_id"):
    """The fifth of documents that is never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
