import zlib
from pathlib import Path

import numpy as np
import pytest

from chainloom.llm import language, quality


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 12):
        code = language.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= max(1, code.shape[1] // 4)


def test_single_wrong_bits_are_outvoted():
    code = language.codewords(4)
    model = language.LanguageModel(list("abcd"), code, np.zeros((4, code.shape[1])), np.zeros(code.shape[1]))
    for i in range(4):
        for b in range(code.shape[1]):
            margins = 3 * code[i].copy()
            margins[b] *= -1
            assert model.decode(margins)[0] == "abcd"[i]


@pytest.fixture(scope="module")
def corpus():
    import random

    rng = random.Random(2)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "oi", "que", "é"]}
    return [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), "s", lang) for i, lang in enumerate(list(sounds) * 60)]


def test_language_on_held_out_rows(make, corpus):
    odd = [(900, None), (901, ""), (902, "12 34 !!"), (903, "²³"), (None, "katomi rato"), (904, "katomi rato " * 20_000)]
    rows = corpus + [(d, t, "s", None) for d, t in odd]
    got = {r.doc_id: r for r in language.identify_with_folds(make(rows)).collect()}
    for doc_id, _, _, lang in corpus:
        assert got[doc_id].lang_pred == lang and 0 <= got[doc_id].score <= 1
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4
    assert got[None].lang_pred == got[904].lang_pred == "aa" and got[None].held_out
    model = language.train(make(rows))
    assert language.recognised(make(rows), model).count() == len(rows) - 4
    assert language.identify(make([]), model).count() == 0
    assert {r.lang_pred for r in language.identify(make(rows[:3]), language.train(make([]))).collect()} == {"und"}


def test_texts_far_from_every_language_go(make, corpus):
    model = language.train(make(corpus))
    short = [(900 + i, " ".join(t.split()[:3])) for i, (_, t, _, _) in enumerate(corpus[:30])]
    far = [(950, "все люди рождаются свободными и равными в своём достоинстве " * 5), (951, "qxzjkvwpbm zxqwvk pjbxz " * 20), (952, "12 34"), (953, None)]
    kept = {r.doc_id for r in language.recognised(make(corpus + short + far), model).collect()}
    assert kept == {d for d, *_ in corpus + short}
    unlabelled = language.recognised(make(far), language.train(make([])))
    assert {r.doc_id for r in unlabelled.collect()} == {950, 951}


def test_quality_on_held_out_rows(spark, make, prose):
    rows = [(i, prose(40, i) if i % 4 else " ".join(w.upper() + "!!" for w in prose(40, i).split())) for i in range(200)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(200)] + [(3, 1, None), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_with_folds(make(rows), labels).collect()}
    assert len(got) == len(rows)
    for i in range(200):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(i % 4 > 0) == int(got[i].score >= 0.3)
    assert got[900].score == got[901].score
    empty = quality.train(make([]).selectExpr("doc_id", "text", "1 AS quality"))
    assert {r.score for r in quality.score(make(rows), empty).collect()} == {0.5}


DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_floors_on_the_given_tables(spark):
    """Held-out quality by rank and held-out language by share on the given documents."""
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    labels = spark.read.parquet(str(DATA / "labels.parquet")).where("quality is not null").select("doc_id", "quality")
    scored = quality.score_with_folds(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert good and bad
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.85
    truth = docs.where("lang is not null").select("doc_id", "lang")
    told = language.identify_with_folds(docs).where("held_out").join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert told >= 0.97
