import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from manyfold.llm import bpe, token_count

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "   \n\n  x", "The cat's don't WE'LL 12 345", "naïve Über ß 漢字かな交じり 🙂 é", "a" * 1200, "ab" * 700 + " tail", "tab\t\tnew\r\nline\x1c\x85\xa0end ",
    "²³¼ ªº 12½", "x\x00y", "'s 't're'LL", "—dash…", " " * 900, "The cat's don't WE'LL 12 345",
]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_encode_is_the_library(spark, own):
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcé' \n\t1漢Z.!") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts = TEXTS + noise
    got = {r.doc_id: list(r.ids) for r in bpe.encode(frame(spark, texts), PATH, P.PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}


def test_decode_and_digests(spark, own):
    df = frame(spark, TEXTS + [None])
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS + [None])}
    for r in bpe.round_trip(df, PATH, P.PATTERN).collect():
        text = (TEXTS + [None])[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_long_words_are_the_library(own):
    codec = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdest") for _ in range(rng.randrange(1, 400))) for _ in range(100)]
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "theandig", "漢字éか", "a"):
        words += ["".join(rng.choice(letters) for _ in range(n)) for n in (255, 256, 257, 384, 385, 900, 3000)]
    words += ["-" * 5000, "=-" * 900, "abc" * 1000, "x" * 20_001, "ha" * 4999 + "h"]
    for word, ids in zip(words, codec.contract([w.encode() for w in words]), strict=True):
        assert ids.tolist() == own.encode_ordinary(word), word[:20]


def test_windows_that_share_no_token_become_one(own):
    codec = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    word = b"abc" * 200
    parts = [(a, a + 256, np.array([a], np.uint32)) for a in (0, 128)]  # ids that meet nowhere
    assert [p[:2] for p in codec._join(parts)] == [(0, 384)] and codec._join(parts)[0][2] is None
    assert codec.contract([word])[0].tolist() == own.encode_ordinary(word.decode())


def test_codecs_of_files_that_differ_in_one_rank(spark, tmp_path):
    ranks = bpe.load_ranks(PATH)
    a, b = (t for t, r in ranks.items() if r in (700, 701))
    lines = [f"{base64.b64encode(t).decode()} {({a: ranks[b], b: ranks[a]}).get(t, r)}" for t, r in ranks.items()]
    (tmp_path / "other").write_text("\n".join(lines))
    df = frame(spark, [a.decode()])
    first, second = (bpe.encode(df, p, P.PATTERN).first().ids for p in (PATH, str(tmp_path / "other")))
    assert first == [ranks[a]] and second == [ranks[b]]


def test_long_texts_go_through_in_parts(own, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 1000)
    monkeypatch.setattr(bpe, "WORDS", 70)
    monkeypatch.setattr(bpe, "IDS", 50)
    monkeypatch.setattr(bpe, "MEMO", 200)
    rng = random.Random(9)
    codec = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    texts = [" ".join("".join(rng.choice("étaoin") for _ in range(rng.randrange(9))) for _ in range(n)) for n in (3000, 0, 5, 700)]
    raw = codec.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in raw] == [own.encode_ordinary(t) for t in texts]
    back = [b""] * len(texts)
    for i, part in codec.expand(raw):
        back[i] += part
    assert back == [t.encode() for t in texts]


def test_decode_skips_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(0, [0, None, 99999]), (1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(df, PATH, P.PATTERN).collect()} == {0: b"!", 1: b"", 2: b""}


def test_token_counts_are_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    # control and byte pieces stand where no text reaches them
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    vocab = [(p, -1e30 if special(i) else s) for i, (p, s) in enumerate(pieces)]
    lowest = min(s for i, (_, s) in enumerate(pieces) if not special(i))
    vocab = [(p, lowest if special(i) else s) for i, (p, s) in enumerate(pieces)]
    lib = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    texts = [t for t in TEXTS if "<" not in t]
    rng = random.Random(3)
    texts += ["".join(rng.choice("theandoing é\n ,.12漢") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["    return x", "  a   b ", "x" + " " * 33 + "y", "▁▁ a ▁b"] + ["".join(rng.choice("re the  ▁  ") for _ in range(rng.randrange(120))) for _ in range(300)]
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(frame(spark, texts), path).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_ties_go_to_the_longest_last_piece():
    counter = token_count.Counter([("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert counter.part("▁aaa") == 2  # ▁ and aaa, not a a a
    assert counter.part("▁a漢") == 2 + 3


def test_parts_are_cut_only_where_no_piece_crosses():
    pieces = [("▁", -3.0), ("a", -1.0), ("b▁a", -1.5), ("▁▁▁", -2.0), ("b", -1.0), ("c", -1.0), ("▁a", -3.5)]
    counter, rng = token_count.Counter(pieces), random.Random(8)
    assert [m.start() for m in counter.edge.finditer("▁a▁a▁b▁a▁▁▁c▁c")] == [2, 4, 8, 12]
    for _ in range(300):
        text = "▁" + "".join(rng.choice("abc▁") for _ in range(rng.randrange(40)))
        assert counter.text(text) == counter.part(text)


def test_counts_of_odd_tables(spark):
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b")], "doc_id long, text string")
    rows = [tuple(r) for r in token_count.token_counts(df, path).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2), (1, 0), (1, 2)], key=str)
    assert token_count.token_counts(df.limit(0), path).count() == 0
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
