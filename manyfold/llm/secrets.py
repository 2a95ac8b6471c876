"""Secret scans: fixed patterns, and novelty against a dictionary-primed compressor.

A string in a sensitive context is measured by how many bytes it adds to what zstandard
makes of its surroundings, with the surrounding text and a dictionary of common identifiers as prefix.
Identifiers and words that the text already uses cost a few bytes; keys cost about their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from manyfold.llm.common import id_text, slices, table

# The base patterns, and the least length of what they must find.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "novel")

#: Words that make the next CONTEXT code points sensitive, and so many after each candidate that is reported.
SENSITIVE = re.compile(r"(?i:passw|passphrase|pwd|secret|token|api[\s_-]?key|private[\s_-]?key|access[\s_-]?key|credential|bearer|authorization|signature|client[\s_-]?id|connection[\s_-]?string)", re.ASCII)
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "signature", "client", "connection")
CONTEXT, AROUND = 64, 512
#: A candidate is reported if it adds at least this share of its own bytes, and so many bytes.
NOVEL_SHARE, NOVEL_BYTES = 0.7, 16
#: What is measured: every run of these characters that could add NOVEL_BYTES. A string adds its length and OVERHEAD bytes at most.
OVERHEAD = 4
LEAST = NOVEL_BYTES - OVERHEAD
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
IDENTIFIERS = (
    " password passwd passphrase secret token access_token refresh_token session_token api_key apikey private_key public_key access_key_id"
    " secret_access_key client_id client_secret credential credentials authorization Authorization: Bearer signature connection_string"
    " username user_name hostname database localhost environment variable configuration settings example placeholder changeme your_"
    " _example_here default null None true false undefined import export function return const static string get set value ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    " abcdefghijklmnopqrstuvwxyz 0123456789 xxxxxxxxxxxxxxxx ________________ ----------------"
)
SLICE_CHARS = 4_000_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and not overlapping within a kind.

    A run of the right characters that is too short is no match whichever way it is read, so
    access and hex take their least length into the pattern; an assignment whose value is
    too short still uses up its text, so that is dropped afterwards.
    """
    low = text.lower()
    spans = []
    if "secret" in low or "token" in low or "passw" in low or "key" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that the candidate adds to its compressed surroundings."""
    import zstandard

    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + before + after).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False).compress
    near = before[-24:].encode()
    return len(squeeze(near + candidate.encode())) - len(squeeze(near))


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of incompressible strings within CONTEXT code points after a sensitive word or another such string, apart from what is taken."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    busy = sorted((s, e) for s, _, e in taken)
    reach = list(accumulate((e for _, e in busy), max))
    found, upto = [], 0
    for word in SENSITIVE.finditer(text):
        stop = word.end() + CONTEXT
        at = max(word.end(), upto)
        # a candidate begins before stop, so nothing is looked at again and again
        while at < stop and (m := CANDIDATE.search(text, at, stop + LEAST - 1)):
            start, end = m.start(), RUN.match(text, m.start()).end()
            at = upto = end
            before = bisect_left(busy, (end, 0))
            if before and reach[before - 1] > start:
                continue  # overlaps what is taken
            added = marginal_bytes(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND])
            if added >= max(NOVEL_BYTES, NOVEL_SHARE * (end - start)):
                found.append((start, 3, end))
                stop = end + CONTEXT  # a key of many lines is followed to its end
    return found


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row, by start and then kind.

    Positions count code points, ends are exclusive. Null counts as empty and has no spans;
    repeated rows and ids give a row each; other columns are ignored. Whole texts are scanned.
    """

    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SLICE_CHARS):
            spans = []
            for text in texts:
                base = base_spans(text)
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + novel_spans(text, base))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
