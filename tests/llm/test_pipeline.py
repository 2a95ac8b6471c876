import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from manyfold.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(60, 200))]
        good = i % 6 != 0
        text = " ".join(words) if good else " ".join(w + "***" for w in words)
        rows.append((i, text, "en", "hot" if i % 3 else "cold"))
        labels.append((i, int(good), 0))
    rows += [(1000, rows[1][1], "en", "hot"), (1001, rows[1][1], "en", "cold")]
    rows += [(1002, rows[2][1] + " x", "en", "hot"), (1003, None, None, None), (1004, "", "en", "hot")]
    return [(*r[:2], *r[2:], len(r[1] or "")) for r in rows], labels


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, each written and read again."""
    base = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    docs, out = spark.read.parquet(f"{base}/documents.parquet"), []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, base).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append((name, docs))
    return base, rows, out


def test_stages_keep_columns(kept):
    _, _, out = kept
    assert len(out) in (4, 5)
    for _, docs in out[:-1]:
        assert docs.dtypes == [tuple(c.split()) if c.split()[1] != "long" else (c.split()[0], "bigint") for c in COLUMNS.split(", ")]


def test_each_stage_against_brute_force(kept):
    from tests.llm.test_simhash import brute_fingerprint, brute_groups

    _, rows, out = kept
    stage = [docs.collect() for _, docs in out]
    good = {r[0] for r in rows if r[1] and "***" not in r[1]}  # what an empty text scores is the model's affair
    after = [[r.doc_id for r in s] for s in stage]
    assert good - set(after[0]) == set() and len(set(after[0]) - good) <= 3  # clean documents stay, junk goes
    last = {}
    for r in stage[0]:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert sorted(after[1]) == sorted(last.values())
    values = {r.doc_id: brute_fingerprint(r.text or "") for r in stage[1]}
    groups, first = brute_groups(sorted(set(values.values()))), {}
    for i, v in values.items():
        first[groups[v]] = min(first.get(groups[v], i), i)
    assert sorted(after[2]) == sorted(first.values())
    assert set(after[3]) <= set(after[2]) and len(after[3]) > len(after[2]) / 2
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(C.TOKENIZER), special_tokens={})
    text = {r.doc_id: r.text or "" for r in stage[3]}
    assert sorted(after[4]) == sorted(after[3])
    for r in stage[4]:
        assert list(r.ids) == own.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, kept):
    base, _, out = kept
    want = sorted((r.doc_id, r.ids_sha256) for r in out[-1][1].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in C.run(spark, base).collect()) == want
