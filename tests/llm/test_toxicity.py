import random
import zlib

from watchgrid.llm.toxicity import FEATURES, HELD_OUT, Scorer, learn_lexicon, likelihood_ratio, train


def test_held_out_accuracy_and_folds(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("th", "er", "lo", "st") for b in ("an", "ing", "ou") for c in ("ed", "or", "", "ly")]
    bad = ["blarg", "snurf", "krankeli", "krankelo", "krankelum"]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) if rng.random() < 0.8 else "bl4rg")
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, 0.0), (5001, "", 0.0), (None, "you blarg", 0.0), (3, rows[3][1], 0.0)], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = train(docs, known)(docs).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == 1204
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == HELD_OUT)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.97
    none = train(docs, known.limit(0))(docs).collect()
    assert len(none) == 1204 and {r.score for r in none} == {0.0}
    assert train(docs, known)(docs.limit(0)).count() == 0


def test_features_undo_obfuscation():
    scorer = Scorer({"moron": 4.0, "krank*": 3.0})
    plain = scorer.features("Nothing to see here, my friend")
    assert len(plain) == FEATURES and plain[0] == plain[12] == 0
    assert scorer.features("you krankelum!")[4] > 0
    for text in ("such a m0r0n", "a mor*on here", "a morrron", "what a M O R O N really", "m.o.r.o.n"):
        assert scorer.features(text)[12] == 4.0
    assert scorer.features("") == [0.0] * FEATURES


def test_a_term_that_no_clean_text_has_is_learned(spark):
    rows = [("gronkel day" if i < 27 else "fine day", True) for i in range(40)] + [("some day here", False)] * 160
    found = learn_lexicon(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert "gronkel" in found and "day" not in found
    assert likelihood_ratio(10, 100, 20, 200) < 1e-9 < likelihood_ratio(27, 40, 0, 160)


def test_a_very_long_text_is_scored_whole():
    scorer = Scorer({"moron": 4.0, "extraordinarymoron": 2.0})
    assert scorer.features("fine words here " * 200_000 + "moron")[1] > 0
    assert scorer.features("fine " + " ".join("extraordinarymoron"))[12] == 4.0
