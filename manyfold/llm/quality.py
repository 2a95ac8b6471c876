"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention learns from
document labels alone how much each counts, and the weighted sum of encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import cut, id_text, slices, table, trim

#: Words of a passage.
PASSAGE = 64
#: Bytes after which a new word begins in any case, so that a passage is bounded whatever the text holds.
LONG = 1024
#: Bytes of text whose passages are encoded together; a longer text is encoded piece by piece.
BLOCK = 1 << 18
#: The sample that fitting looks at: so many labelled documents and so many bytes of their texts at most, the same at
#: every size of the corpus. All passages of a chosen document count; a document that would pass the bytes isn't chosen.
TRAIN_DOCS, TRAIN_BYTES = 3000, 32_000_000
BUCKETS, HIDDEN, EPOCHS, RATE, DECAY, SEED = 64, 16, 150, 0.03, 1e-4, 42
SLICE_CHARS = 1_000_000

CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!", b"*#$%&|@^~=+<>[]{}\\/_`", b"\n\r", bytes(range(128, 256))]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _i
WIDTH = len(CLASSES) + 1 + 5 + BUCKETS
BLANKS = b" \t\n\v\f\r"
SPACE = np.zeros(256, bool)
SPACE[list(BLANKS)] = True


def word_starts(buf: np.ndarray) -> np.ndarray:
    """Where words begin, the first byte included; a stretch of LONG bytes without a beginning begins another."""
    space = SPACE[buf]
    starts = np.flatnonzero(np.concatenate([[True], ~space[1:] & space[:-1]]))
    gap = np.diff(np.concatenate([starts, [len(buf)]]))
    more = (gap - 1) // LONG
    if more.any():
        nth = np.arange(len(starts) + more.sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        starts = np.repeat(starts, more + 1) + LONG * nth
    return starts


def pieces(text: str) -> Iterator[bytes]:
    """The text's bytes in runs of whole passages, BLOCK bytes at most; nothing if it has no words."""
    raw = text.encode().strip(BLANKS)
    at = 0
    while len(raw) - at > BLOCK:
        starts = word_starts(np.frombuffer(raw, np.uint8, BLOCK, at))
        whole = (len(starts) - 1) // PASSAGE * PASSAGE
        yield raw[at : at + int(starts[whole])] + b" "
        at += int(starts[whole])
    if len(raw) > at:
        yield raw[at:] + b" "  # so that no byte counts for a neighbour


def _encode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, passages of each piece); an empty piece has one passage of zeros."""
    parts = [word_starts(np.frombuffer(r, np.uint8)) if r else np.zeros(0, np.int64) for r in raw]
    words = np.array([len(x) for x in parts], np.int64)
    size = np.array([len(r) for r in raw], np.int64)
    held = np.maximum(1, -(-words // PASSAGE))
    first, n = np.cumsum(held) - held, int(held.sum())
    out = np.zeros((n, WIDTH), np.float32)
    if not words.sum():
        return out, held
    starts = np.concatenate(parts) + np.repeat(np.cumsum(size) - size, words)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    owner = np.repeat(first, words) + place // PASSAGE
    # a word's bytes and the spaces after it belong to its passage
    length = np.diff(np.concatenate([starts, [len(buf)]]))
    at = np.repeat(owner, length)
    chars = np.bincount(at, minlength=n)[:, None] + 1e-9
    kinds = len(CLASSES) + 1
    out[:, :kinds] = np.bincount(at * kinds + CLASS_OF[buf], minlength=n * kinds).reshape(n, kinds) / chars
    pairs = ((buf[:-1].astype(np.int64) * 31 + buf[1:]) * 2654435761 >> 11) % BUCKETS
    within = at[:-1] == at[1:]
    out[:, kinds + 5 :] = np.bincount((at[:-1] * BUCKETS + pairs)[within], minlength=n * BUCKETS).reshape(n, BUCKETS) / chars
    offset = np.arange(len(buf)) - np.repeat(starts, length)
    weight = (np.uint64(0x9E3779B97F4A7C15) * (2 * offset.astype(np.uint64) + np.uint64(1))) * ~SPACE[buf]
    code = np.add.reduceat(weight * (buf.astype(np.uint64) + np.uint64(1)), starts)
    back = lambda k: np.concatenate([np.zeros(k, bool), (code[k:] == code[:-k]) & (owner[k:] == owner[:-k])])[: len(code)]
    once, twice = back(1), back(2)
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    out[:, kinds] = np.bincount(owner, once, minlength=n) / some
    out[:, kinds + 1] = np.bincount(owner, once | twice, minlength=n) / some
    out[:, kinds + 2] = np.log1p(count) / 4
    out[:, kinds + 3] = np.log1p(chars[:, 0] / some) / 3 * (count > 0)
    out[:, kinds + 4] = count > 0
    return out, held


def passages(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, text that each belongs to) of all passages, some BLOCK bytes of text at a time.

    Every text has one passage at least, all zeros if it has no words. Features: shares of kinds of characters, size,
    how often a word repeats one of the two before it in its passage, and hashed shares of neighbouring bytes.
    """
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text) if text.strip(" \t\n\v\f\r") else [b""]:
            if held and size + len(piece) > BLOCK:
                x, counts = _encode(held)
                yield x, np.repeat(owners, counts)
                held, owners, size = [], [], 0
            held.append(piece)
            owners.append(i)
            size += len(piece) + 64
    if held:
        x, counts = _encode(held)
        yield x, np.repeat(owners, counts)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Attention:
    """Gated attention over encoded passages."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.p = {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, hidden), "U": draw(hidden, hidden), "w": draw(hidden), "c": draw(hidden), "o": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def encode(self, xs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encodings of standardised passages, the two halves of their gates, and their attention before it is shared out."""
        p = self.p
        h = np.tanh(xs @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, v, u, (v * u) @ p["w"]

    def gradient(self, xs: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logits of bags of standardised passages that begin at ``first``, and the mean log loss's gradient."""
        p = self.p
        h, v, u, s = self.encode(xs)
        size = np.diff(np.concatenate([first, [len(xs)]]))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        logit = z @ p["c"] + p["o"]
        off = (_sigmoid(logit) - y) / len(y)
        dz = np.repeat(off[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return logit, {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": z.T @ off, "o": off.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        xs = ((x - self.mean) / self.scale).astype(np.float32)
        m, r = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, EPOCHS + 1):
            _, grad = self.gradient(xs, first, y)
            for k, g in grad.items():
                g = g + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                r[k] = 0.999 * r[k] + 0.001 * g * g
                self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(r[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: list[str]) -> np.ndarray:
        """Of each text, with its attention's greatest value, sum and weighted sum carried from block to block: nothing grows with a text."""
        n, hidden = len(texts), len(self.p["b"])
        most, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, hidden))
        for x, owner in passages(texts):
            h, _, _, s = self.encode((x - self.mean) / self.scale)
            here, at = np.unique(owner, return_index=True)
            now = np.maximum(most[here], np.maximum.reduceat(s, at))
            fade = np.exp(most[here] - now)
            most[here] = now
            e = np.exp(s - most[owner])
            total[here] = total[here] * fade + np.add.reduceat(e, at)
            z[here] = z[here] * fade[:, None] + np.add.reduceat(e[:, None] * h, at)
        return _sigmoid((z / total[:, None]) @ self.p["c"] + self.p["o"]) if n else np.zeros(0)


def held_out(doc_id) -> F.Column:
    """Rows that fitting never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, quality) of the labelled documents that fitting looks at: those of least hash, up to both bounds.

    Null labels and ids don't count, nor do ids without a document. An id labelled more than once has its labels' mean, an id of several documents
    the least of their texts, so that each gives one row; null text counts as empty.
    """
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    text = id_text(docs, id_col, text_col)
    # at most train_docs ids and labels are broadcast, and as many texts come out
    rows = text.join(F.broadcast(chosen), text["doc_id"] == chosen["_id"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = cut(rows.select("doc_id", "text", "quality"))
    took, fits = 0, []
    for r in rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        if took + r.n <= train_bytes:
            took += r.n
            fits.append(r.doc_id)
    return rows.where(F.col("doc_id").isin(fits))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Attention:
    """A model from all passages of the sampled documents that may be learnt from.

    Without labels of both kinds every score is the share of ones (one half without any).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.concatenate([x for x, _ in passages([b.column(1)[i].as_py()])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([x.astype("<f4").tobytes()]), b.column(2).slice(i, 1)], ["doc_id", "x", "quality"])

    rows = sample(docs, labels, train_docs, train_bytes, id_col, text_col).mapInArrow(run, "doc_id long, x binary, quality double")
    got = sorted(((r.doc_id, r.x, r.quality) for r in rows.collect()), key=lambda r: r[0])
    model = Attention(WIDTH)
    y = np.array([float(q > 0.5) for _, _, q in got])
    if len(set(y)) == 2:
        parts = [np.frombuffer(x, "<f4").reshape(-1, WIDTH) for _, x, _ in got]
        model.fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]), y)
    else:
        model.p["c"][:] = 0
        share = y.mean() if len(y) else 0.5
        model.p["o"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
    return model


def scores(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row from its whole text alone; null counts as empty, repeated rows score alike, other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.score(texts))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Attention, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is ``least`` or more, in one pass."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, since = 0, 0
            for i in range(b.num_rows):
                held += len(b.column(at)[i].as_py() or "")
                if held >= SLICE_CHARS or i + 1 == b.num_rows:
                    part = b.slice(since, i + 1 - since)
                    good = shared.value.score([t or "" for t in part.column(at).to_pylist()]) >= least
                    yield part.filter(pa.array(good))
                    held, since = 0, i + 1
        trim()

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
