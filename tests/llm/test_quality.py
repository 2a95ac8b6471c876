import math
import random
import tracemalloc
import zlib

import numpy as np

from manyfold.llm import quality as X


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        words, good = [word() for _ in range(rng.randrange(5, 300))], i % 4 != 0
        if not good:
            words = [w + "***" for w in words] if i % 8 else [w for w in words for _ in range(8)]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(600, 1)
    rows += [(10_000, "", None), (10_001, None, None), (10_002, "word " * 50_000, None)]
    spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in X.op6_quality(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, _ in rows}
    held = [(got[i].predicted, q) for i, _, q in rows if q is not None and got[i].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    kept = X.keep_good(docs, X.fit(docs, labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(r.score, 6) for r in X.scores(docs, X.fit(docs, none)).collect()] == [0.5, 0.5]
    assert X.scores(docs.limit(0), X.fit(docs, none)).count() == 0


def encoded(texts):
    """(features, owners) of all passages."""
    parts = list(X.passages(texts))
    return np.concatenate([x for x, _ in parts]), np.concatenate([o for _, o in parts])


def test_passages_cover_whole_texts():
    words = [f"w{i}" for i in range(1000)]
    x, owner = encoded(["", " ".join(words), "a", "   ", "a a a b"])
    assert np.bincount(owner).tolist() == [1, 16, 1, 1, 1]
    assert not x[0].any() and not x[18].any()
    # every byte is in one passage of 64 words, whatever blocks a long text is cut into
    rng = random.Random(4)
    text = " ".join("v" * rng.randrange(1, 30) for _ in range(60_000))
    assert len(text) > 3 * X.BLOCK
    x, _ = encoded([text])
    assert len(x) == -(-60_000 // X.PASSAGE) and b"".join(p[:-1] for p in X.pieces(text)).decode() == text
    for i, part in enumerate(x):
        own = text.split()[X.PASSAGE * i : X.PASSAGE * (i + 1)]
        n = sum(map(len, own)) + len(own)
        n -= i == len(x) - 1
        assert abs(part[1] - sum(map(len, own)) / n) < 1e-2  # the share of small letters


def test_long_words_and_gaps_are_bounded():
    for text in ("x" * 100_000, "a" + " " * 100_000 + "b", "y" * X.LONG, "y" * (X.LONG + 1)):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = X.word_starts(raw)
        assert starts[0] == 0 and np.diff([*starts, len(raw)]).max() <= X.LONG and (np.diff(starts) > 0).all()


def test_memory_does_not_grow_with_the_text():
    model, peaks = X.Attention(X.WIDTH), []
    for n in (2_000_000, 50_000_000):
        text = "lorem ipsum dolor " * (n // 18)
        tracemalloc.start()
        assert 0 <= model.score([text])[0] <= 1
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * len(text))  # the text's own bytes, and those without blanks at its ends
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 10_000_000


def test_neighbours_in_a_batch_change_nothing():
    texts = ["  a b", "", " \n", "é ü!! é", "x" * 500, "a a\n", "\n\nq", "word " * 70_000]
    together, owner = encoded(texts)
    model = X.Attention(X.WIDTH)
    for i, t in enumerate(texts):
        assert np.allclose(encoded([t])[0], together[owner == i])
        assert np.isclose(model.score([t])[0], model.score(texts)[i])


def loop_score(model, x):
    """Gated attention by loops over passages and units."""
    p, xs = model.p, (x - model.mean) / model.scale
    sig = lambda t: 1 / (1 + math.exp(-t))
    hidden = len(p["b"])
    hs, weights = [], []
    for row in xs:
        h = [math.tanh(sum(row[i] * p["W"][i][k] for i in range(len(row))) + p["b"][k]) for k in range(hidden)]
        gate = [math.tanh(sum(h[i] * p["V"][i][k] for i in range(hidden))) * sig(sum(h[i] * p["U"][i][k] for i in range(hidden))) for k in range(hidden)]
        hs.append(h)
        weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
    z = [sum(w * h[k] for w, h in zip(weights, hs, strict=True)) / sum(weights) for k in range(hidden)]
    return sig(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["o"][0])


def test_attention_against_a_loop():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bc!", "D9", "é"]) for _ in range(n)) for n in (0, 3, 64, 65, 400)]
    model = X.Attention(X.WIDTH, 5)
    model.p["o"][:] = 0.3
    for text, score in zip(texts, model.score(texts), strict=True):
        assert abs(loop_score(model, encoded([text])[0]) - score) < 1e-9


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(0)
    model, x, first, y = X.Attention(6, 4), rng.normal(size=(9, 6)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        logit, _ = model.gradient(x, first, y)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    _, grad = model.gradient(x, first, y)
    for k, own in grad.items():
        flat = model.p[k].reshape(-1)
        for i in range(flat.size):
            at, flat[i] = flat[i], flat[i] + 1e-6
            up = loss()
            flat[i] = at - 1e-6
            down = loss()
            flat[i] = at
            assert abs((up - down) / 2e-6 - own.reshape(-1)[i]) < 1e-7
    before = loss()
    model.fit(x, first, y)
    assert loss() < before


def test_sample(spark):
    docs = spark.createDataFrame([(i, "t" * (10 + i)) for i in range(40)] + [(3, "a"), (3, "b"), (5, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, 1), (4, 1), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    learn = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = {r.doc_id: (r.text, r.quality) for r in X.sample(docs, labels).collect()}
    assert sorted(got) == learn
    assert all(got[i][0] == {3: "a", 5: ""}.get(i, "t" * (10 + i)) for i in learn)
    assert all(abs(got[i][1] - (2 / 3 if i == 4 else i % 2)) < 1e-12 for i in learn)
    assert 6 <= X.sample(docs, labels, train_docs=7).count() <= 7  # label 99 has no document
    few = X.sample(docs, labels, train_bytes=200).collect()
    assert 0 < sum(len(r.text) for r in few) <= 200 < sum(len(t) for t, _ in got.values())
    assert X.sample(docs.limit(0), labels).count() == 0 == X.sample(docs, labels.limit(0)).count()
