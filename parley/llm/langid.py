"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text as they stand, blanks, digits and marks included, forward and
backward, with states that run on across words, and gives every position probabilities over the languages;
a document pools the logarithms over all its positions. Texts are read in segments of SEGMENT bytes, cut
before a character: both directions start anew there, which bounds what a text of any length takes. It is
trained in numpy by backpropagation through time on pieces of raw text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textbuf as tb
from parley.llm.lineage import small_batches

UNKNOWN = "und"
#: The training sample: documents of a language at most (about; chosen by hash), documents at all, pieces of a
#: document, bytes of a piece.
SAMPLE_DOCS, TRAIN_DOCS, PIECES, PIECE_BYTES = 500, 4000, 6, 96
HIDDEN, EPOCHS, BATCH, RATE = 16, 5, 128, 0.01
#: Bytes that the network reads without a break.
SEGMENT = 4096
#: Segments, and label scores (positions times languages), that are worked on at once; bytes of
#: texts, of as many Arrow batches as it takes, gathered for that.
AT_ONCE, SCORES, GATHERED = 1024, 1 << 22, 16 << 20


def _by_unit(states: np.ndarray) -> np.ndarray:
    """A copy of [2, n, H] as [2H, n]."""
    return states.transpose(0, 2, 1).copy().reshape(-1, states.shape[1])


class Network:
    """Weights: x [2, 256, 3H], what a byte adds to the gates update, reset and candidate in each direction;
    u [2, 3H, H], what the last state adds; the output layer v [languages, 2H], c [languages].

    Both directions run together. A step reads byte t forward and byte length - 1 - t backward.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.w = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "u": rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)),
            "v": rng.normal(0, 0.1, (len(languages), 2 * hidden)), "c": np.zeros(len(languages)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _joint(self) -> np.ndarray:
        """u of both directions in one matrix [3 gates x 2 directions x H, 2H]."""
        k = self.h
        joint = np.zeros((3, 2, k, 2, k), self.w["u"].dtype)
        for d in range(2):
            joint[:, d, :, d] = self.w["u"][d].reshape(3, k, k)
        return joint.reshape(6 * k, 2 * k)

    def _steps(self, ahead: np.ndarray, back: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The states [2, n, H] after each step; ahead, back: the bytes [steps, n] as each direction reads them.
        A state is only valid until the next step, unless what gradients need is kept, each as [2H, n]."""
        k, n = self.h, ahead.shape[1]
        x = np.zeros((2, 257, 3, k), self.w["x"].dtype)
        x[:, :256] = self.w["x"].reshape(2, 256, 3, k)
        x[:, 256, 0] = 100  # the update gate is exactly 1
        # gate by gate, rows of H: so that nothing is turned around and every operation runs over whole arrays
        x, u = x.reshape(514, 3, k).transpose(1, 0, 2).copy(), self.w["u"].reshape(2, 3, k, k).transpose(1, 0, 3, 2).copy()
        for w in (x, u):
            w[:2] *= -1
            w[2] *= -2
        h, a, g = np.zeros((2, n, k), x.dtype), np.empty((3, 2, n, k), x.dtype), np.empty((3, 2, n, k), x.dtype)
        rows, zr, z, r, own, m = a.reshape(3, 2 * n, k), a[:2], a[0], a[1], a[2], g[2]
        for read in np.concatenate([ahead, back + 257], 1):
            x.take(read, 1, out=rows, mode="clip")
            np.matmul(h, u, out=g)
            zr += g[:2]
            np.exp(zr, out=zr)  # of the negative sums: the logistic function
            zr += 1
            np.divide(1, zr, out=zr)
            if keep is not None:
                keep.append((_by_unit(h), _by_unit(z), _by_unit(r), _by_unit(m * -0.5)))
            m *= r
            m += own
            np.exp(m, out=m)  # of -2 times the sums: the hyperbolic tangent
            m += 1
            np.divide(2, m, out=m)
            m -= 1
            if keep is not None:
                keep[-1] += (_by_unit(m),)
            h -= m
            h *= z
            h += m
            yield h

    def pooled(self, segments: list[np.ndarray]) -> np.ndarray:
        """[segments, languages]: sums over all positions of the logarithms of the labels' probabilities. The
        segments' lengths should be alike: what shorter ones are filled up with is not read."""
        sizes = np.array([len(s) for s in segments])
        n, length, least, many = len(segments), int(sizes.max()), int(sizes.min()), len(self.languages)
        ahead, back = (np.full((n, length), 256, np.intp) for _ in range(2))  # 256: nothing, where a state stays
        for i, s in enumerate(segments):
            ahead[i, : len(s)], back[i, length - len(s) :] = s, s[::-1]
        v, k = self.w["v"], self.h
        forward, backward = v[:, :k].copy(), v[:, k:].copy()
        scores = np.empty((length, 2 * many, n), v.dtype)  # what each direction adds to the labels, apart
        for t, h in enumerate(self._steps(ahead.T, back.T)):
            np.dot(forward, h[0].T, out=scores[t, :many])
            np.dot(backward, h[1].T, out=scores[t, many:])
        out = np.zeros((n, many))
        for lo in range(0, length, 64):
            hi = min(length, lo + 64)
            s = scores[lo:hi, :many] + scores[length - hi : length - lo, many:][::-1] + self.w["c"][:, None]
            s -= s.max(1, keepdims=True)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            if hi > least:
                s *= (np.arange(lo, hi)[:, None] < sizes)[:, None]
            out += s.sum(0, dtype=np.float64).T
        return out

    def gradients(self, data: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions of bytes [length, n], and its gradients by backpropagation through time."""
        length, n = data.shape
        k, keep = self.h, []
        states = np.stack([_by_unit(h) for h in self._steps(data, data[::-1], keep)])
        at = np.concatenate([states[:, :k], states[::-1, k:]], 1)  # both directions' states at each position
        s = np.matmul(self.w["v"], at) + self.w["c"][:, None]
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        scale = (weight / (weight.sum() * length)).astype(p.dtype)
        loss = float(-(np.log(p[:, label, np.arange(n)] + 1e-12) * scale).sum())
        p[:, label, np.arange(n)] -= 1
        p *= scale
        g = {"v": np.einsum("tln,thn->lh", p, at, optimize=True), "c": p.sum((0, 2))}
        onto = np.matmul(self.w["v"].T, p)
        onto = np.concatenate([onto[:, :k], onto[::-1, k:]], 1)  # by step again
        u, dh = self._joint(), np.zeros((2 * k, n), p.dtype)
        gu, gates = np.zeros_like(u), np.empty((length, 6 * k, n), p.dtype)
        for t in range(length - 1, -1, -1):
            h, z, r, gm, m = keep[t]
            dh += onto[t]
            dm = dh * (1 - z) * (1 - m * m)
            dz, dr = dh * (h - m) * z * (1 - z), dm * gm * r * (1 - r)
            gates[t] = np.concatenate([dz, dr, dm])
            dg = np.concatenate([dz, dr, dm * r])
            gu += dg @ h.T
            dh = dh * z + u.T @ dg
        gu, gates = gu.reshape(3, 2, k, 2, k), gates.reshape(length, 3, 2, k, n)
        g["u"] = np.stack([gu[:, d, :, d].reshape(3 * k, k) for d in range(2)])
        g["x"] = np.zeros_like(self.w["x"])
        for d, read in enumerate((data, data[::-1])):
            order = np.argsort(read, axis=None, kind="stable")
            flat = gates[:, :, d].reshape(length, 3 * k, n).transpose(0, 2, 1).reshape(length * n, 3 * k)[order]
            seen, first = np.unique(read.reshape(-1)[order], return_index=True)
            g["x"][d, seen] = np.add.reduceat(flat, first, 0)
        return loss, g


def train(pieces: list[tuple[bytes, str]], seed: int = 5, epochs: int = EPOCHS) -> Network | None:
    """A network trained on (bytes, language) pieces, each language with the same weight (Adam); None without any."""
    pieces = [p for p in pieces if p[0]]
    if not pieces:
        return None
    languages = sorted({lang for _, lang in pieces})
    net, rng = Network(languages), np.random.default_rng(seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for piece, lang in pieces:
        by_length.setdefault(len(piece), []).append((piece, languages.index(lang)))
    count = np.bincount([i for own in by_length.values() for _, i in own], minlength=len(languages))
    weight = count.sum() / (len(languages) * np.maximum(count, 1))
    sets = {k: (np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, k), np.array([i for _, i in own])) for k, own in by_length.items()}
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    step, total = 0, epochs * sum(-(-len(y) // BATCH) for _, y in sets.values())
    for _ in range(epochs):
        batches = [(k, part) for k, (_, y) in sets.items() for part in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH))]
        for j in rng.permutation(len(batches)):
            k, part = batches[j]
            x, y = sets[k]
            _, g = net.gradients(x[part].T.astype(np.intp), y[part], weight[y[part]])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                net.w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# ---- tables


def _remainder(id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)), F.lit(-1))


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on a bounded sample of the labelled rows: about SAMPLE_DOCS documents of each
    language and TRAIN_DOCS at all, chosen by hash, of each PIECES pieces of PIECE_BYTES bytes from hashed
    places anywhere in its text (a shorter text whole, once). Rows whose crc32(id) mod 4 is 2, or whose id,
    text or language is null, aren't learned from."""
    open_rows = docs.filter((_remainder(id) != 2) & F.col(id).isNotNull() & (F.length(text) > 0) & F.col(lang).isNotNull())
    open_rows = open_rows.select(F.encode(text, "UTF-8").alias("data"), F.col(lang).alias("lang"), F.xxhash64(F.lit(23), id, text).alias("key"))
    counts = {r["lang"]: r["n"] for r in open_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    most = min(SAMPLE_DOCS, max(1, TRAIN_DOCS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))])
    chosen = open_rows.filter(F.pmod("key", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))
    room = F.greatest(F.octet_length("data") - PIECE_BYTES, F.lit(0)).cast("long")
    place = F.explode(F.when(room > 0, F.sequence(F.lit(1), F.lit(PIECES))).otherwise(F.array(F.lit(1))))
    pieces = chosen.select("lang", "data", "key", room.alias("room"), place.alias("i"))
    start = (F.pmod(F.xxhash64("key", "i"), F.col("room") + 1) + 1).cast("int")
    rows = pieces.select("lang", F.substring("data", start, F.lit(PIECE_BYTES)).alias("piece")).collect()  # TRAIN_DOCS * PIECES, about
    return train(sorted((bytes(r["piece"]), r["lang"]) for r in rows))  # in an order that doesn't depend on partitions


def segments_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of a text in runs of SEGMENT at most, each cut before a character."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        while hi < len(data) and hi > lo + SEGMENT - 4 and (data[hi] & 0xC0) == 0x80:
            hi -= 1
        yield data[lo:hi]
        lo = hi


class Reader:
    """Pools texts' segments, many texts' together and in groups of like length."""

    def __init__(self, net: Network | None, texts: int):
        self.net, self.totals = net, np.zeros((texts, len(net.languages) if net else 0))
        self.held: list[tuple[int, np.ndarray]] = []
        self.bytes = 0

    def add(self, i: int, data: np.ndarray) -> None:
        for segment in segments_of(data):
            self.held.append((i, segment))
            self.bytes += len(segment)
            if self.bytes >= GATHERED:
                self.flush()

    def flush(self) -> None:
        held, lo = sorted(self.held, key=lambda x: len(x[1])), 0
        while lo < len(held):
            hi = min(len(held), lo + AT_ONCE)
            while hi > lo + 1 and (hi - lo) * len(held[hi - 1][1]) * len(self.net.languages) > SCORES:
                hi = lo + (hi - lo + 1) // 2
            np.add.at(self.totals, [i for i, _ in held[lo:hi]], self.net.pooled([s for _, s in held[lo:hi]]))
            lo = hi
        self.held, self.bytes = [], 0


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of GATHERED bytes at most, or one larger batch."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > GATHERED:
            yield held
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held


def _predicted(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for group in _gathered(batches):
        reader, read, first = Reader(net, sum(map(len, group))), [], 0
        for batch in group:
            column = batch.column(1)
            data, offsets = tb.column(column)
            lettered = [i for i in range(len(column)) if net is not None and any(map(str.isalpha, column[i].as_py() or ""))]
            for i in lettered:
                reader.add(first + i, data[offsets[i] : offsets[i + 1]])
            read.append((first, lettered, np.diff(offsets)))
            first += len(batch)
        reader.flush()
        for batch, (first, lettered, sizes) in zip(group, read):
            langs, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if lettered:
                mean = reader.totals[first : first + len(batch)] / np.maximum(sizes, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i in lettered:
                    best = int(p[i].argmax())
                    langs[i], scores[i] = net.languages[best], p[i, best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.round(scores, 5))], names=["id", "lang_pred", "score"])


def predicted(docs: DataFrame, net: Network | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score of every row, from the bytes of the whole text alone.

    A null text, and a text without a letter, is "und" with score 0; so is every text where nothing was
    learned. The score, to 5 digits, is the pooled probability of the language named: the geometric mean
    over positions, normed over the languages. Ties go to the first language by name. Repeated rows get
    equal results; an empty table gives an empty table. Other columns are left out.
    """
    small_batches(docs.sparkSession)
    schema = f"id {docs.schema[id].dataType.simpleString()}, lang_pred string, score double"
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _predicted(it, net), schema).withColumnRenamed("id", id)


def op7_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predicted(docs, learn(docs))
    return out.select("doc_id", (_remainder("doc_id") == 2).alias("held_out"), "lang_pred", "score")
