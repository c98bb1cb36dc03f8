import random
import re
import zlib

import numpy as np
import pytest

from watchgrid.llm import quality_classifier as qc


def words(text):
    """Maximal runs of one kind of byte, white space apart."""
    return [m.group() for m in re.finditer(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+", (text or "").encode())]


def bucket(word):
    total = sum((b + 1) * pow(qc._FACTOR, i, 1 << 64) for i, b in enumerate(word))
    return (total * qc._MIX % (1 << 64)) >> 49


def brute_table(texts):
    places, signs = qc.index_vectors()
    table = np.zeros((qc.BUCKETS, qc.DIMS + 1), np.int64)
    for text in texts:
        found = [bucket(w) for w in words(text)]
        for i, word in enumerate(found):
            table[word, qc.DIMS] += 1
            for j in range(max(0, i - qc.REACH), min(len(found), i + qc.REACH + 1)):
                if j != i:
                    table[word, places[found[j]]] += signs[found[j]].astype(int)
    return table


def make(seed, n=800):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("th", "er", "lo", "st") for b in ("an", "ing", "ou") for c in ("ed", "or", "", "ly")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            text = [w.upper() + "!!" for w in text] if kind == 0 else [w + " |" for w in text] if kind == 1 else [w for w in text[:4] for _ in range(9)]
        rows.append((i, " ".join(text), 0.5, "de"))
        labels.append((i, int(good), 0))
    return rows, labels


SCHEMA, LABELS = "doc_id long, text string, score double, row string", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("stretch,piece", [(1 << 18, 1 << 20), (7, 50)])
def test_context_sums_equal_brute_force_however_split(spark, monkeypatch, stretch, piece):
    monkeypatch.setattr(qc, "STRETCH", stretch)
    monkeypatch.setattr(qc, "PIECE", piece)
    texts = [r[1] for r in make(1, 60)[0]] + [None, "", "one", "a, b... c!", "same same same", "é漢字\tx\x0b\r\n--_9", "long" * 40, " \n "]
    want = brute_table(texts)
    for parts in (1, 5):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        assert (qc.context_sums(docs) == want).all()


def test_pooling_is_whole_and_independent_of_stretches(monkeypatch):
    texts = [t.encode() for t in ("", "one", "a b c, d " * 3000, "word word word", "x y")]
    vectors = qc.word_vectors(brute_table(["a b c, d x y word one"]))
    whole = qc.pooled(texts, vectors)
    assert whole.shape == (5, qc.FEATURES) and (whole[0] == 0).all()
    assert whole[3, qc.DIMS] > 0.6  # neighbours that repeat resemble each other
    monkeypatch.setattr(qc, "STRETCH", 5)
    assert np.allclose(qc.pooled(texts, vectors), whole, atol=1e-5)


def test_held_out_accuracy_folds_and_defined_cases(spark):
    rows, labels = make(6)
    extra = [(5000, None, 0.0, "x"), (5001, "", 0.0, "x"), (None, "some words", 0.0, "x"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows + extra, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels + [(7, None, 1), (None, 0, 1), (5000, 1, 0)], LABELS)
    got = qc.train(docs, known)(docs).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) + 5
    truth = {i: t for i, t, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    none = qc.train(docs, known.limit(0))(docs).collect()
    assert {r.score for r in none} == {0.0}
    assert qc.train(docs.limit(0), known)(docs.limit(0)).count() == 0


def test_held_out_labels_are_never_learned_from(spark):
    rows, labels = make(8, 200)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, t, x in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = ({r.row.doc_id: r.score for r in qc.train(docs, spark.createDataFrame(k, LABELS))(docs).collect()} for k in (labels, flipped))
    assert one == two


def test_temperature_lowers_the_loss_of_sharp_margins():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(0, 1.5, 600) > 0).astype(float)
    network = qc.Network(x[:100], y[:100], epochs=300, decay=0.0)
    loss = lambda: -np.mean(np.log(np.where(y[100:] > 0, p := network.probabilities(x[100:]), 1 - p)))
    before = loss()
    network.calibrate(x[100:], y[100:])
    assert network.temperature > 1 and loss() < before
