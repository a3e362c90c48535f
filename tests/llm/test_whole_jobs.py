"""What the reviewer found cut short."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from quern.llm import langid, lines, lm, suffix
from quern.llm.common import CHUNK_SCHEMA, Scratch, arrow
from tests.llm import brute
from tests.llm.test_operators import UNIQUE


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "whole")
    yield s
    s.clear()


def text_of(words, tag):
    return "\n".join(" ".join(f"{tag}{i}w{j}" for j in range(n)) for i, n in enumerate(words))


def test_op3_whole_runs_of_short_lines(spark, scratch):
    shapes = [[3, 3, 3], [4, 3, 4], [6, 1, 6], [1, 2, 2, 2, 1, 2, 2], [10, 1, 1], [2, 2, 2, 1]]
    rows = [(10 * i + j, f"own {i} {j}\n{text_of(s, f's{i}')}\nend {i} {j}") for i, s in enumerate(shapes) for j in range(3)]
    got = {r.doc_id: (r["_n_removed"], r["_n_runs"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == {10 * i + j: (len(s), 1) if j and sum(s) >= 8 else (0, 0) for i, s in enumerate(shapes) for j in range(3)}


@pytest.mark.parametrize("min_words", [3, 5, 8])
def test_op3_whole_runs_equal_brute_force(spark, scratch, min_words):
    r = random.Random(min_words)
    some = [" ".join(f"l{i}" for _ in range(r.choice([1, 1, 1, 2, 3, 6]))) for i in range(12)]
    base = [[r.choice(some) for _ in range(14)] for _ in range(4)]
    rows = list(UNIQUE)
    for i in range(60):
        a, b = r.choice(base), r.choice(base)
        rows.append((1000 + i, "\n".join(a[r.randrange(14) :] + [f"x{i}"] * (i % 2) + b[: r.randrange(14)])))
    x = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r["_n_removed"], r["_n_runs"]) for r in lines.dedup_lines(x, scratch, min_words).collect()}
    assert got == {k: v[1:3] for (k, _), v in zip(rows, brute.lines(rows, min_words), strict=True)}


def test_op9_trigrams_seen_once_count(spark, scratch):
    rows = [*UNIQUE, (2000, "a b c a b d e b c"), (2001, "c b a d b a")]
    x = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm.score_documents(x, scratch, order=3, min_count=1).collect()}
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, t in rows}
    c = Counter(tuple(w[i - n : i]) for w in words.values() for n in (1, 2, 3) for i in range(n, len(w) + 1))
    total = sum(map(len, words.values()))

    def log_of(w, i):
        # In its own document each n-gram is seen, so only a document's beginning steps back.
        n = min(3, i + 1)
        gram = tuple(w[i - n + 1 : i + 1])
        return (3 - n) * math.log(0.4) + math.log(c[gram] / (c[gram[:-1]] if n > 1 else total))

    for k, w in words.items():
        assert got[k][0] == len(w)
        assert got[k][1] == pytest.approx(sum(log_of(w, i) for i in range(len(w))), rel=1e-9, abs=1e-9)


def test_op9_rest_is_the_model_of_all_other_documents(spark, scratch):
    rows = [*UNIQUE[:40], (2000, "a b c a b d e b c"), (2001, "c b a d b a"), (2002, "a b c a b d e b c"), (2003, "only here")]
    x = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score_documents(x, scratch).collect()}
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, t in rows}
    assert got[2003].rest_score < got[2000].rest_score
    for k, w in words.items():
        if not w:
            assert (got[k].log_score, got[k].mean_score, got[k].rest_score) == (0, None, None)
            continue
        others = [v for j, v in words.items() if j != k]
        c = Counter(tuple(v[i - n : i]) for v in others for n in (1, 2, 3) for i in range(n, len(v) + 1))
        total, logs = max(1, sum(map(len, others))), 0.0
        for i in range(len(w)):
            for n in (3, 2, 1):
                gram = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else ()
                if n == 1:
                    logs += math.log(0.16 * max(1, c[gram]) / total)
                elif gram and c[gram]:
                    logs += math.log(0.4 ** (3 - n) * c[gram] / max(1, c[gram[:-1]]))
                    break
        assert got[k].mean_score == pytest.approx(got[k].log_score / len(w)) and got[k].rest_score == pytest.approx(logs / len(w), rel=1e-9)


def test_op10_numerals_are_no_letters(spark):
    model = langid.fit(["the and of to in is that", "der und die das ist nicht ein"] * 3, ["en", "de"] * 3)
    assert langid.predict_batch(model, ["½ ² Ⅳ ① 7 _", "Ⅳ", None, "", "ª"])[0][:4] == ["und"] * 4
    x = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½ ²", "Ⅳ", "①"] * 20)], "doc_id long, text string, lang string")
    assert langid.train(x) is None and langid.keep_identified(x, model).count() == 0
    # The engine's own notion of a letter, by which rows for the fit are found, is the same.
    some = spark.createDataFrame([(c, chr(c)) for c in (0x41, 0xAA, 0xB2, 0xBD, 0x2163, 0x2460, 0x3007, 0x4E00, 0x5D0, 0x1C5, 0x2B0, 0x5F, 0x30)], "c int, s string")
    assert all(r.ours == chr(r.c).isalpha() for r in some.selectExpr("c", r"s rlike '\\p{L}' ours").collect())


def test_op10_is_kernel_ridge_regression():
    """With all texts as landmarks: plain kernel ridge regression on the n-gram sets themselves."""
    r = random.Random(2)
    alphabets = {"aa": "abcde ", "bb": "defgh ", "cc": "aghij "}
    data = [(k, "".join(r.choice(v) for _ in range(r.randint(20, 60)))) for k, v in alphabets.items() for _ in range(12)]
    r.shuffle(data)
    langs, texts = [k for k, _ in data], [t for _, t in data]
    new = ["".join(r.choice(v) for _ in range(50)) for v in alphabets.values() for _ in range(5)]

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])

    a, b = [grams(t) for t in texts], [grams(t) for t in new]
    names, n, ridge = sorted(alphabets), len(texts), 1e-2
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Languages are equally frequent, so all rows weigh 1.
    want = kernel(b, a) @ np.linalg.solve(kernel(a, a) + ridge * n * np.eye(n), y)
    model = langid.fit(texts, langs, n_landmarks=n, ridge=ridge)
    got = model.scores(langid.presence_matrix(new))
    assert (got.argmax(1) == want.argmax(1)).all() and np.abs(got - want).max() < 0.05


def chunk(chunk_id, ids, texts):
    lens = np.array([len(t) for t in texts], "<i8")
    row = {"chunk_id": chunk_id, "n_docs": len(ids), "n_bytes": int(lens.sum()), "ids": np.array(ids, "<i8").tobytes(), "rows": np.array(ids, "<i8").tobytes(), "null_ids": bytes(len(ids)), "lens": lens.tobytes(), "blob": zstandard.ZstdCompressor().compress(b"".join(texts))}
    return pa.RecordBatch.from_pylist([row], schema=arrow(CHUNK_SCHEMA))


def test_op2_contexts_of_one_hash_are_told_apart(monkeypatch):
    was = suffix.contexts
    monkeypatch.setattr(suffix, "contexts", lambda *a: (x := was(*a)) | {"ctx": np.zeros_like(x["ctx"])})
    r = random.Random(0)  # all share their anchor
    s = bytes(r.choices(b"abcdefgh ", k=100))
    texts = [b"x" + s[1:], b"y" + s[1:], s[:99] + b"z", b"x" + s[1:]]
    assert len({int(x) for t in texts[:3] for x in was(suffix.Chunk(*[chunk(0, [0], [t]).to_pylist()[0][k] for k in suffix._CHUNK]))["anchor"]}) == 1
    for chunks in ([chunk(0, [0, 1, 2, 3], texts)], [chunk(i, [i], [t]) for i, t in enumerate(texts)]):
        dealt = pd.concat([b.to_pandas() for b in suffix._deal(1, 100, 48, suffix.SLICE)(iter(chunks))])
        settled = suffix._settle(4000)(dealt)
        assert sum(len(x) for x in settled.gone_many) == 1 and settled.n_open.sum() == 3


def test_op2_second_hash_is_of_the_bytes_alone():
    r = random.Random(5)
    text = bytes(r.choices(b"abcdefgh ", k=3000))
    x, y = (suffix.contexts(suffix.Chunk(*[chunk(0, [0, 1], t).to_pylist()[0][k] for k in suffix._CHUNK])) for t in ([text, text], [b"some other bytes" * 20, text]))
    half = len(x["ctx2"]) // 2
    assert half > 50 and (x["ctx2"][:half] == x["ctx2"][half:]).all() and (y["ctx2"][-half:] == x["ctx2"][half:]).all()
    assert len(set(x["ctx2"].tolist())) == half
