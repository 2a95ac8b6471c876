"""Line deduplication by a segment-partition edit join.

A line of length L within t edits of another leaves one of its t + 1 segments whole, near
its place. Segments of every line are its index entries; substrings of the lines that are
as long or a little longer, at the places where a whole segment may have moved to, probe them.
Entries and probes meet by a hash of (length, segment number, characters). A 64-bit sketch,
the parity of each kind of character, differs in two bits an edit at most and
sifts the pairs that meet; what is left is verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import cut, id_text, slices, spread_join, table
from manyfold.llm.exact_dedup import bitmap_of, in_bitmap
from manyfold.llm.simhash import GrayIndex, _signed, components, masks

#: Edits of a pair: none below SHORT code points, one below twice that, else MOST. The shorter line decides.
MOST, SHORT = 2, 10
#: Rows of one signature beyond which it is divided by blocks of the sketch, and by chunks if need be.
LARGE = 20_000
#: Sketch bits that MOST edits can flip.
OFF = 2 * MOST
SLICE_CHARS = 2_000_000


def edits(length: int) -> int:
    return min(MOST, length // SHORT)


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """(start, size) of t + 1 segments; the last ones are one longer where it doesn't divide."""
    size, longer = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        n = size + (i >= t + 1 - longer)
        out.append((at, n))
        at += n
    return out


_plans: dict[int, tuple[list, list]] = {}


def plan(length: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(seed, start, stop) of a line's own segments, and of the substrings that probe others.

    Places follow the multi-match-aware bounds: what comes before the i-th segment can hold i
    edits at most, what comes after it the rest.
    """
    if length not in _plans:
        own, probes = [], []
        for short in range(max(SHORT, length - MOST), length + 1):
            t, gap = edits(short), length - short
            if gap > t:
                continue
            for i, (start, size) in enumerate(segments(short, t)):
                seed = short * (MOST + 1) + i
                low = max(start - i, start + gap - (t - i), 0)
                high = min(start + i, start + gap + (t - i), length - size)
                for at in range(low, high + 1):
                    (own if gap == 0 and at == start else probes).append((seed, at, at + size))
        if len(_plans) > 50_000:
            _plans.clear()
        _plans[length] = (own, probes)
    return _plans[length]


#: The bit of a sketch that marks a probe, and what an entry counts among probes.
PROBE, ENTRY = 63, 1 << 32
#: Bits of the bitmaps of signatures that meet another and of lines in question: 4 MB each. Where they fill up, more rows are dealt and the results stay.
MEETING = 1 << 25


#: Characters that are sketched together; a longer line goes through in so many at a time.
BLOCK = 1 << 18


def _runs(lines: list[str]) -> Iterator[list[int]]:
    """Places of neighbouring lines that have BLOCK characters together; a longer line stands alone."""
    held, size = [], 0
    for k, line in enumerate(lines):
        if held and size + len(line) > BLOCK:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(line)
    if held:
        yield held


def _odd(text: str, owner: np.ndarray, n: int) -> np.ndarray:
    """Parities of kinds of character, 64 for each of n owners."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kinds = np.minimum((codes * np.uint32(2654435761)) >> np.uint32(26), PROBE - 1).astype(np.int64)
    return np.bincount(owner * 64 + kinds, minlength=64 * n) & 1


def sketches(lines: list[str]) -> np.ndarray:
    """Parity of how often each of 63 kinds of character occurs, for every line."""
    out = np.empty(len(lines), np.int64)
    for held in _runs(lines):
        size = [len(lines[k]) for k in held]
        if sum(size) <= BLOCK:
            odd = _odd("".join([lines[k] for k in held]), np.repeat(np.arange(len(held)), size), len(held))
        else:
            odd = np.zeros(64, np.int64)
            for at in range(0, size[0], BLOCK):
                part = lines[held[0]][at : at + BLOCK]
                odd ^= _odd(part, np.zeros(len(part), np.int64), 1)
        out[held] = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance is t at most, by bit-parallel steps over a diagonal band of 2t + 1 cells."""
    if abs(len(a) - len(b)) > t:
        return False
    if a == b:
        return True
    # after i characters of a, reach[e] has bit t + d set if e edits make them the first i + d of b
    width = 2 * t + 1
    full, reach = (1 << width) - 1, []
    for e in range(t + 1):
        reach.append(sum(1 << (t + d) for d in range(0, e + 1)))  # inserting from b before anything of a
    n, m = len(a), len(b)
    for i in range(n):
        same = 0
        for d in range(max(-t, -i), min(t, m - 1 - i) + 1):
            if b[i + d] == a[i]:
                same |= 1 << (t + d)
        now, below = [], 0
        for e in range(t + 1):
            cells = reach[e] & same
            if e:
                cells |= reach[e - 1] | (reach[e - 1] >> 1)  # replace, or delete from a
                cells |= below << 1  # insert from b
            cells &= full
            now.append(cells)
            below = cells
        reach = now
        if not any(reach):
            return False
    return bool(reach[t] >> (t + m - n) & 1)


def _line_rows(ids: list, texts: list[str]) -> tuple[list, list, list[str]]:
    docs, numbers, lines = [], [], []
    for i, text in zip(ids, texts, strict=True):
        for n, line in enumerate(text.split("\n")):
            docs.append(i)
            numbers.append(n)
            lines.append(line)
    return docs, numbers, lines


def _digests(lines: list[str]) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(x.encode()) for x in lines]


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(_digests(lines)), "<i8").reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def lines_of(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, h, h2) of each line that isn't empty; h and h2 are a 128-bit hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SLICE_CHARS):
            docs, numbers, lines = _line_rows(ids, texts)
            full = [i for i, x in enumerate(lines) if x]
            h, h2 = _hashes([lines[i] for i in full])
            yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in full], pa.int64()), pa.array([numbers[i] for i in full], pa.int32()), pa.array(h), pa.array(h2)], ["doc_id", "line_no", "h", "h2"])

    return df.mapInArrow(run, "doc_id long, line_no int, h long, h2 long")


def signatures(df: DataFrame, met=None) -> DataFrame:
    """(sig, n) of the lines, each line once a task: n is ENTRY for an entry, 1 for a probe.

    With ``met``, a broadcast bitmap, (sig, h, sk) of those whose bit is set; sk is a probe's if it is negative.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        seen: set[bytes] = set()
        for ids, texts in slices(batches, SLICE_CHARS // 4):
            lines = [x for x in set(_line_rows(ids, texts)[2]) if len(x) >= SHORT]
            names = _digests(lines)
            fresh = [k for k, own in enumerate(names) if own not in seen]
            lines, names = [lines[k] for k in fresh], [names[k] for k in fresh]
            seen.update(names)
            if len(seen) > 200_000:
                seen.clear()  # a line may then come again, which costs a row and changes nothing
            sigs, sizes = [], []
            for x in lines:
                own, others = plan(len(x))
                sigs += [digest(x[a:b].encode(), s) for s, a, b in own]
                sigs += [digest(x[a:b].encode(), s) for s, a, b in others]
                sizes += (len(own), len(others))
            sig = np.array(sigs, np.uint64)
            entry = np.repeat(np.tile([True, False], len(lines)), sizes)
            if met is None:
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.where(entry, ENTRY, 1))], ["sig", "n"])
                continue
            bit = sig % np.uint64(MEETING)
            hit = np.flatnonzero(met.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            which, at = np.unique(np.repeat(np.arange(2 * len(lines)) // 2, sizes)[hit], return_inverse=True)
            sk = sketches([lines[k] for k in which.tolist()])[at]  # of lines that meet another
            hashes = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)[:, 0]
            columns = [sig[hit].view(np.int64), hashes[which][at], np.where(entry[hit], sk, sk | np.int64(-(1 << PROBE)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "h", "sk"])

    return df.mapInArrow(run, "sig long, n long" if met is None else "sig long, h long, sk long")


def _bitmap(met: DataFrame) -> np.ndarray:
    """One bit for each of MEETING remainders of ``sig``: MEETING / 8 bytes come to the driver, whatever the corpus holds."""
    bit = met.select((F.pmod(F.col("sig"), F.lit(MEETING)) + 1).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(MEETING // 8, np.uint8)
    for r in parts:
        out[(r.nth - 1) * 4096 : r.nth * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _near(sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of sketches that OFF bits at most tell apart."""
    n = len(sk)
    if n <= 64:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(sk[i] ^ sk[j]) <= OFF
        return i[near], j[near]
    rank = sk.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    order = np.argsort(rank, kind="stable")
    index, out = GrayIndex(sk[order], OFF), []
    for at in range(0, n, 1024):
        out.append(index.pairs(at, min(n, at + 1024)))
    i, j = (order[np.concatenate(x)] for x in zip(*out, strict=True))
    return np.minimum(i, j), np.maximum(i, j)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, h, sk) sorted by key to pairs (a, b), a < b, of lines to verify."""

    def emit(h: np.ndarray, sk: np.ndarray) -> Iterator[pa.RecordBatch]:
        probe = sk < 0
        if len(h) < 2 or probe.all():
            return
        i, j = _near((sk & np.int64((1 << PROBE) - 1)).view(np.uint64))
        fine = ~(probe[i] & probe[j]) & (h[i] != h[j])
        a, b = h[i[fine]], h[j[fine]]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list[list[np.ndarray]] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, h, sk = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        groups, first = len(bounds) - 1, 0
        if held and held_key == key[0]:
            held.append([x[: bounds[1]].copy() for x in (h, sk)])
            first = 1
        if held and (groups > 1 or not first):
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        sizes = np.diff(bounds)
        for g in (np.flatnonzero(sizes[first : groups - 1] > 1) + first).tolist():
            s = slice(bounds[g], bounds[g + 1])
            yield from emit(h[s], sk[s])
        if groups - 1 >= first:
            held, held_key = [[x[bounds[-2] :].copy() for x in (h, sk)]], key[-1]
    if held:
        yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def meeting(df: DataFrame) -> DataFrame:
    """(sig, rows) of the signatures that an entry and another row have; only sums are shuffled."""
    counts = signatures(df).groupBy("sig").agg(F.sum("n").alias("n"))
    return counts.select("sig", F.expr(f"n div {ENTRY} + n % {ENTRY}").alias("rows"), "n").where(f"n > {ENTRY}").drop("n")


def _split(rows: DataFrame, large: int) -> DataFrame:
    """(key, h, sk) rows in which no key has more than about twice ``large`` rows, and each two rows of a key meet under some key.

    A key of more is dealt to chunks of ``large`` rows by the line, and a chunk meets every other under a key of their own.
    """
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large)
    counts = cut(counts.select(F.col("key").alias("_key"), F.ceil(F.col("_n") / large).cast("int").alias("_chunks")))
    if not counts.take(1):
        return rows
    both = rows.join(counts, rows["key"] == counts["_key"], "left")
    mine = F.pmod(F.xxhash64("h"), F.col("_chunks")).cast("int")
    chunks = both.where("_key is not null").select("key", "h", "sk", mine.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other"))
    dealt = chunks.select(F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("key"), "h", "sk")
    return both.where("_key is null").select("key", "h", "sk").unionByName(dealt)


def candidates(df: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b) of hashes of lines that may be within their edits, each pair once.

    Signatures are counted first; only rows whose signature meets another, as a bitmap tells, are made with hash and sketch and dealt. A signature of more than
    ``large`` rows is divided by pairs of the sketch's six blocks: OFF bits spoil four at
    most, so two lines that belong together still meet; and where even that leaves more, into chunks that meet two by two. No row is left out.
    """
    met = cut(meeting(df))
    rows = signatures(df, df.sparkSession.sparkContext.broadcast(_bitmap(met)))
    rows = cut(rows.select(F.col("sig").alias("key"), "h", "sk"))
    crowded = cut(met.where(F.col("rows") > large).select(F.col("sig").alias("_sig")))
    if crowded.take(1):
        both = rows.join(crowded, rows["key"] == crowded["_sig"], "left")
        blocks = F.array(*(F.xxhash64("key", F.lit(i), F.col("sk").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(list(range(PROBE)), 6, OFF))))
        divided = cut(both.where("_sig is not null").select(F.explode(blocks).alias("key"), "h", "sk"))
        rows = both.where("_sig is null").select("key", "h", "sk").unionByName(_split(divided, large))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_met, "a long, b long").distinct()


def line_text(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line_id, line) of the lines whose h is in ``wanted``, each once; line_id is both halves of its hash."""
    seen = cut(bitmap_of(wanted, ["h"], MEETING))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, SLICE_CHARS):
            lines = [x for x in set(_line_rows(ids, texts)[2]) if len(x) >= SHORT]
            h, h2 = _hashes(lines)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), pa.array(lines, pa.string())], ["h", "h2", "line"])

    found = in_bitmap(df.mapInArrow(run, "h long, h2 long, line string"), [F.col("h")], seen, MEETING).where("_found").drop("_found")
    found = found.join(wanted.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"), "left_semi").dropDuplicates(["h", "h2"])
    return found.select("h", F.struct("h", "h2").alias("line_id"), "line")


def similar_lines(df: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b) of 128-bit hashes of different lines within the edits of the shorter one. Candidates meet by 64 bits; the texts behind them decide."""
    pairs = cut(candidates(df, large))
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    text = cut(line_text(df, cut(wanted)))
    side = lambda name, line: text.select(F.col("h").alias(name), F.col("line_id").alias(f"{name}_id"), F.col("line").alias(line))
    named = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            close = [within(x, y, edits(min(len(x), len(y)))) for x, y in lines]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    node = "struct<h: long, h2: long>"
    return named.select("a_id", "b_id", "left", "right").mapInArrow(run, f"a {node}, b {node}")


def dropped_lines(df: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, line_no) of the lines that go; df: (doc_id, text).

    Equal lines are one class, and lines are linked within the edits of the shorter; of the lines that links connect the first, by
    id and number, stays. Empty lines always stay.
    """
    rows = cut(lines_of(df))
    first = rows.groupBy("h", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    tree = cut(components(similar_lines(df, large)).select(F.col("node.h").alias("_h"), F.col("node.h2").alias("_h2"), "root"))
    grown = first.join(tree, (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2")), "left").where("root is not null or n > 1")
    grown = cut(grown.select("h", "h2", "first", "n", "root"))
    heads = cut(grown.where("root is not null").groupBy("root").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("size")))
    linked = spread_join(cut(grown.where("root is not null")), heads, ["root"], "size", "inner").select("h", "h2", "keep", "n")
    loses = cut(linked.unionByName(grown.where("root is null").select("h", "h2", F.col("first").alias("keep"), "n")))
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    # only lines whose class may lose one are dealt to the join that decides
    doubtful = cut(in_bitmap(rows, [F.col("h")], cut(bitmap_of(loses, ["h"], MEETING)), MEETING).where("_found").drop("_found"))
    return spread_join(doubtful, loses, ["h", "h2"], "n", "inner").where(here != F.col("keep")).select("doc_id", "line_no")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, dropped) per row: the text without its dropped lines.

    Lines end at a newline. A null text counts as empty, which is one empty line. Ids should tell rows apart: rows of
    one id share the numbers that are dropped from any of them, but never lose the first of a class. ``dropped`` lists the
    numbers of dropped lines, from 0. Only documents whose id a bitmap doesn't clear are dealt to the join with what they lose.
    """
    docs = id_text(df, id_col, text_col)
    gone = cut(dropped_lines(docs, large).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")).withColumnRenamed("doc_id", "_id"))
    marked = in_bitmap(docs, [F.col("doc_id")], cut(bitmap_of(gone, ["_id"])))
    whole = marked.where("not _found").select("doc_id", "text", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.array().cast("array<int>").alias("dropped"))

    doubtful = marked.where("_found").select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    # lines are looked up by number, so the work grows with the lines alone; split stands in a projection of its own, since lambdas would repeat it
    parts = doubtful.select("doc_id", "text", F.split("text", "\n").alias("_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("_drop"))
    parts = parts.select("doc_id", "text", "_lines", F.size("_lines").alias("_n"), F.filter("_drop", lambda x: x < F.size("_lines")).alias("dropped"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("dropped"))
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    rest = parts.select("doc_id", text.alias("text"), F.col("_n").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")
    return whole.unionByName(rest)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
