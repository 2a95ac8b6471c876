"""Byte-level BPE, encoding and decoding, as recursive DuckDB queries over token-position rows.

Each task keeps one in-process DuckDB holding the merge table, made once from the rank
file. The distinct words of a slice of texts become rows (word, position, token); a
recursive query joins neighbouring tokens with the merge table, contracts the leftmost
pair of least rank in every word at once, and goes on with the words that still changed.
Decoding joins the ids of documents with the vocabulary and aggregates their bytes in order of position.

The query passes over a word once for each merge. So that a long word doesn't cost the square of
its length, it is contracted as overlapping windows, words like any other, which are joined where both hold
the same token at the same place. That is exact: a sequence of tokens is the contraction
of its bytes if and only if each two neighbours are the contraction of theirs, since the first merge across
a boundary would also be the first between those two alone; and each two neighbours of the joined sequence stand in
one of the windows. Windows without such a token are contracted again as one.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from manyfold.llm.common import id_text, slices, table

#: Bytes of text that are worked on together; words of a text that are held at once; words that a worker remembers between slices.
SLICE_CHARS, WORDS, MEMO = 1_000_000, 200_000, 150_000
#: Bytes of a window of a long word, and how far one begins after the other; words up to WINDOW are whole.
WINDOW, STEP = 256, 128
#: Rows that the states of one recursive query may take together, and ids of one decoding query.
STATES, IDS = 3_000_000, 500_000

# The letters, numbers and white space of code points below 256.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: Contractions, words, numbers, other signs, and white space: the usual pattern of these rank files, for code points below 256.
NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

CONTRACT = """
WITH RECURSIVE state AS (
  SELECT w, p, t, true AS live FROM start
  UNION ALL
  SELECT s.w, CASE WHEN s.p > b.at THEN s.p - 1 ELSE s.p END, CASE WHEN s.p = b.at THEN b.made ELSE s.t END, b.best IS NOT NULL
  FROM (SELECT w, p, t FROM state WHERE live) s LEFT JOIN (
    SELECT a.w, min(m.made::BIGINT * 1048576 + a.p) AS best, (best & 1048575)::INT AS at, (best >> 20)::INT AS made
    FROM (SELECT w, p, t, lead(t) OVER (ORDER BY w, p) AS t2, lead(w) OVER (ORDER BY w, p) AS w2 FROM state WHERE live) a
    JOIN merges m ON m.l = a.t AND m.r = a.t2 AND a.w2 = a.w
    GROUP BY a.w) b ON b.w = s.w
  WHERE b.best IS NULL OR s.p <> b.at + 1
)
SELECT w, p, t FROM state WHERE NOT live ORDER BY w, p
"""
DECODE = "SELECT d, string_agg(v.bytes, '' ORDER BY i.p) AS bytes FROM ids i JOIN vocab v ON v.t = i.t GROUP BY d ORDER BY d"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes under one rank file and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import public_tokenizers
        import regex

        self.wide = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))
        self.usual = pattern == public_tokenizers.PATTERN
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        left, right, made = array("i"), array("i"), array("i")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False})
        self._table("merges", {n: pa.array(np.array(x, np.int32)) for n, x in (("l", left), ("r", right), ("made", made))})
        self._table("vocab", {"t": pa.array(ranks.values(), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        self.memo: dict[str, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    def _ask(self, query: str, **tables: dict) -> pa.Table:
        for name, columns in tables.items():
            self.db.register(name, pa.table(columns))
        out = self.db.sql(query).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def words(self, text: str) -> Iterator[list[str]]:
        """What the pattern finds, in order, some WORDS at a time; together they are the text."""
        pattern = self.wide
        if self.usual:
            try:
                text.encode("latin-1")
                pattern = NARROW
            except UnicodeEncodeError:
                pass
        if len(text) <= SLICE_CHARS:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, WORDS)):
            yield part

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by the recursive query, words of like lengths together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        load = np.cumsum(size[order] ** 2 // 2 + 1) // STATES
        for part in np.split(order, np.flatnonzero(np.diff(load)) + 1) if len(words) else ():
            n = size[part]
            raw = np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8)
            w = np.repeat(np.arange(len(part), dtype=np.int32), n)
            p = (np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            got = self._ask(CONTRACT, start={"w": w, "p": p, "t": self.byte[raw]})
            counts = np.bincount(got["w"].to_numpy(), minlength=len(part))
            ids, stops = got["t"].to_numpy().astype("<u4"), np.cumsum(counts)
            for k, stop, count in zip(part.tolist(), stops.tolist(), counts.tolist(), strict=True):
                out[k] = ids[stop - count : stop]
        return out

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        spans = [(k, a, min(len(w), a + WINDOW)) for k, w in enumerate(words) for a in (range(0, max(1, len(w) - WINDOW + STEP), STEP) if len(w) > WINDOW else (0,))]
        done: dict[int, list] = {}
        for (k, a, b), ids in zip(spans, self._contract([words[k][a:b] for k, a, b in spans]), strict=True):
            done.setdefault(k, []).append((a, b, ids))
        long = [k for k, parts in done.items() if len(parts) > 1]
        while long:
            again = []
            for k in long:
                done[k] = self._join(done[k])
                again += [(k, i) for i, part in enumerate(done[k]) if part[2] is None]
            fresh = self._contract([words[k][done[k][i][0] : done[k][i][1]] for k, i in again])
            for (k, i), ids in zip(again, fresh, strict=True):
                done[k][i] = (*done[k][i][:2], ids)
            long = [k for k in long if len(done[k]) > 1]
        return [done[k][0][2] for k in range(len(words))]

    def _join(self, parts: list[tuple]) -> list[tuple]:
        """Neighbouring windows (from, to, ids) joined at a token that both hold; where there is none they become one without ids."""
        out = [parts[0]]
        for a, b, ids in parts[1:]:
            left, upto, before = out[-1]
            if before is not None and out[-1][2] is not None:
                stop = left + np.cumsum(self.size[before])
                other = a + np.cumsum(self.size[ids])
                _, i, j = np.intersect1d(stop, other, return_indices=True)
                same = np.flatnonzero(before[i] == ids[j])
                if len(same):
                    at = same[len(same) // 2]
                    out[-1] = (left, b, np.concatenate([before[: i[at] + 1], ids[j[at] + 1 :]]))
                    continue
                out[-1] = (left, b, None)
            else:
                out.append((a, b, ids))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        out, held, count = [bytearray() for _ in texts], [], 0
        for i, text in enumerate(texts):
            for part in self.words(text):
                held.append((i, part))
                count += len(part)
                if count >= WORDS:
                    self._encode(held, out)
                    held, count = [], 0
        self._encode(held, out)
        return [bytes(x) for x in out]

    def _encode(self, held: list[tuple[int, list[str]]], out: list[bytearray]) -> None:
        every: set[str] = set()
        for _, part in held:
            every.update(part)
        missing = sorted(every.difference(self.memo))
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = sorted(every)
        fresh = dict(zip(missing, (x.tobytes() for x in self.contract([w.encode() for w in missing])), strict=True))
        known = self.memo
        known.update(fresh)
        for i, part in held:
            out[i] += b"".join([known[w] for w in part])
        for w in fresh:
            if len(w) > WINDOW:  # a few long words could outweigh all others
                del known[w]

    def expand(self, raw: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(i, bytes) of runs of ids, some IDS at a time and in order; ids outside the vocabulary stand for nothing."""
        runs = ((i, x[at : at + 4 * IDS]) for i, x in enumerate(raw) for at in range(0, len(x), 4 * IDS))
        held, count = [], 0
        for run in runs:
            if held and count + len(run[1]) > 4 * IDS:
                yield from self._expand(held)
                held, count = [], 0
            held.append(run)
            count += len(run[1])
        if held:
            yield from self._expand(held)

    def _expand(self, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        ids = np.frombuffer(b"".join([x for _, x in held]), "<i4")
        d = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) // 4 for _, x in held])
        got = self._ask(DECODE, ids={"d": d, "p": np.arange(len(ids), dtype=np.int32), "t": ids})
        for k, text in zip(got["d"].to_pylist(), got["bytes"], strict=True):
            yield held[k][0], text.as_py().encode("latin-1")


_codecs: dict[tuple, Codec] = {}


def _codec(shared: tuple[str, dict[bytes, int]], pattern: str) -> Codec:
    """This worker's codec of a rank file, known by the file's digest, and a pattern; it holds one at a time."""
    key = (shared[0], pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared[1], pattern)
    return _codecs[key]


def _shared(df: DataFrame, path: str):
    """The file's digest and ranks, broadcast: their size is the vocabulary's, whatever the corpus holds."""
    with open(path, "rb") as f:
        digest = sha256(f.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, load_ranks(path)))


def _lists(raw: list[bytes]) -> pa.Array:
    stops = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row, by the rank file at ``path``, without special tokens.

    Null and empty texts have no ids; repeated rows and ids give a row each; other columns are
    ignored. Words of any length are contracted exactly.
    """
    ranks = _shared(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for ids, texts in slices(batches, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(codec.encode_batch(texts))], ["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary) per row of ids; null ids give no bytes, ids outside the vocabulary stand for nothing."""
    ranks = _shared(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = [b""] * part.num_rows
                for i, text in codec.expand([(x.values.drop_null().to_numpy().astype("<i4").tobytes() if x.is_valid else b"") for x in part.column(1)]):
                    out[i] += text
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes, decodes the ids and returns digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes; the ids too if asked for.

    What encode() and decode() do, without shipping the ids between them. Null counts as empty; repeated rows and ids give a row
    each; other columns are ignored.
    """
    ranks = _shared(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for ids, texts in slices(batches, SLICE_CHARS):
            raw = codec.encode_batch(texts)
            digests, sizes = [sha256() for _ in texts], [0] * len(texts)
            for i, part in codec.expand(raw):
                digests[i].update(part)
                sizes[i] += len(part)
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([sha256(x).hexdigest() for x in raw], pa.string())]
            columns += [pa.array([d.hexdigest() for d in digests], pa.string()), pa.array(sizes, pa.int64())]
            if with_ids:
                columns.append(_lists(raw))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids"][: len(columns)])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
