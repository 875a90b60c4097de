import random

import numpy as np

from retrievo.llm.quality import classify, fit


def _documents(n=900):
    rng = random.Random(8)
    good = ["river", "stone", "window", "garden", "letter", "summer", "market", "village", "winter", "bridge"]
    rude = ["scumbag", "scumlike", "scums", "idiotic", "idiots"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 200))]
        low, toxic = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(rude)
        text = " ".join(w.upper() + "!!" if low else w for w in words)
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame(labels[:500] + [(None, 0, 0), (5, None, None), (700, None, None)],
                                  "doc_id long, quality int, toxic int")
    model = fit(frame, given)
    got = {r.doc_id: r for r in classify(frame, model).collect()}
    truth = {i: (q, t) for i, q, t in labels}
    held = range(500, 900)
    assert np.mean([(got[i].p_low_quality > 0.5) == (truth[i][0] == 0) for i in held]) > 0.97
    assert np.mean([(got[i].p_toxic > 0.5) == (truth[i][1] == 1) for i in held]) > 0.97
    assert all(r.keep == (r.p_low_quality <= 0.5 and r.p_toxic <= 0.5) for r in got.values())
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s1", 0, 2), (1, "", "en", "s1", 0, 2)],
                                "doc_id long, text string, lang string, source string, n_chars long, keep int")
    out = classify(odd, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "p_low_quality", "p_toxic", "keep"]
    assert out.count() == 3 and classify(odd.where("false"), model).count() == 0
    without = fit(frame, given.where("false"))
    assert {r.keep for r in classify(frame, without).collect()} == {True}


def test_documents_with_columns_named_like_labels(spark):
    docs, labels = _documents(400)
    rows = [(*d, 7, "x") for d in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, "
                                        "toxic string")
    given = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    out = classify(frame, fit(frame, given))
    assert {r.quality for r in out.select("quality").distinct().collect()} == {7} and out.count() == 400
