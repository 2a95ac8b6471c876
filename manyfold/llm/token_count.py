"""Counts of unigram tokens, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each position of the
text; dynamic programming carries the best score and the number of pieces up to there.
A text is cut only before a space mark that no piece of the vocabulary reaches across from
the character before it, which leaves the result as it is and lets a worker remember parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from manyfold.llm.common import id_text, slices, table

SPACE = "▁"
#: Below the lowest score of a piece: what a character outside the vocabulary costs.
UNKNOWN_PENALTY = 10.0
#: Parts whose counts a worker keeps; the memo starts anew beyond it.
MEMO = 400_000
SLICE_CHARS = 2_000_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter:
    """Pieces of a text under the unigram model.

    Among segmentations of equal score, the one that reaches a position by the longest
    last piece wins. A character that begins no piece of its own may stand as unknown and
    counts as its UTF-8 bytes (byte fallback). Scores are added up from the beginning of a part; where they are whole
    numbers, as here, that is the same as from the beginning of the text.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.reach = max((len(p) for p, _ in pieces), default=1) + 1
        joined = {before for p, _ in pieces for before, mark in zip(p, p[1:], strict=False) if mark == SPACE}
        self.edge = re.compile(f"(?<=[^{re.escape(''.join(sorted(joined)))}])(?={SPACE})" if joined else f"(?<=.)(?={SPACE})", re.S)
        self.memo: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of the best segmentation; only the positions that a piece can reach back to are held."""
        n, ring = len(text), self.reach
        best: list[float | None] = [None] * ring
        count = [0] * ring
        best[0] = 0.0
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        nxt = next(matches, None)
        for end in range(n):
            score, pieces = None, 0
            while nxt is not None and nxt[0] == end:  # the longest first
                size, own = nxt[1]
                start = (end + 1 - size) % ring
                if best[start] is not None and (score is None or best[start] + own > score):
                    score, pieces = best[start] + own, count[start] + 1
                nxt = next(matches, None)
            here = end % ring
            if text[end] not in self.single and best[here] is not None and (score is None or best[here] + self.unknown > score):
                score, pieces = best[here] + self.unknown, count[here] + len(text[end].encode("utf-8", "surrogatepass"))
            best[(end + 1) % ring], count[(end + 1) % ring] = score, pieces
        return count[n % ring]

    def text(self, text: str) -> int:
        """Spaces become space marks, and a text that doesn't begin with one gets one; no text has no pieces."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        memo, total, at = self.memo, 0, 0
        for m in chain(self.edge.finditer(text), (None,)):
            stop = m.start() if m else len(text)
            w = text[at:stop]
            at = stop
            n = memo.get(w)
            if n is None:
                if len(memo) >= MEMO:
                    memo.clear()
                n = self.part(w)
                if len(w) <= 64:
                    memo[w] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) per row under the pieces and scores of the model file at ``path``.

    The whole text is one search, across spaces too; all other white space is ordinary text.
    Null and empty texts have 0 tokens; repeated rows and ids give a row each. The pieces
    are read here and broadcast: their size is the vocabulary's, whatever the corpus holds.
    """
    with open(path, "rb") as f:
        digest = sha256(f.read()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((digest, load_pieces(path)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, pieces = shared.value
        if digest not in _counters:
            _counters.clear()
            _counters[digest] = Counter(pieces)
        counter = _counters[digest]
        for ids, texts in slices(batches, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([counter.text(t) for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
