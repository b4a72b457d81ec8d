"""The network of secret scans is fitted, calibrated and measured on three sets of documents."""

from __future__ import annotations

import random

import numpy as np

from meterlake.llm import secrets


def prose(n: int) -> list[str]:
    rng = random.Random(31)
    syllables = ["ka", "ton", "mer", "schaft", "lin", "gra", "ver", "ein", "dor", "pel", "hus", "wick", "land", "er", "ung", "bro"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    return [f"{k} " + " ".join(word() for _ in range(60)) + f" see www.{word()}.org/archive/{word()}/2021 or {word().upper()}{word().upper()}LANDERSCHAFT." for k in range(n)]


def test_recall_is_measured_on_documents_and_leads_of_its_own(spark):
    docs = spark.createDataFrame(list(enumerate(prose(150))), "doc_id long, text string").repartition(3)
    net = secrets.fit(docs)
    texts = secrets.sample_texts(docs, secrets.SAMPLE, secrets.SAMPLE_CHARS)
    found, y, shapes = secrets.findings(texts[4::5], seed=7, before=secrets._BEFORE_MEASURED)
    hit = net.probability(net.logits(np.stack(found))) >= net.thresholds[shapes]
    assert net.recall == hit[y].mean() >= 0.9 and net.false == hit[~y].mean() <= 0.05
    assert len(net.recalls) == 4 and min(net.recalls) >= 0.8
    known = set(secrets._BEFORE + secrets._BEFORE_ASIDE)
    assert not known & set(secrets._BEFORE_MEASURED)
    # Fresh findings of another seed behind words that no set has.
    rng, hits = random.Random(32), []
    for _ in range(500):
        t = rng.choice(texts)
        at = t.rfind(" ", 0, rng.randrange(40, len(t))) + 1
        made, left = secrets._positive(rng), t[:at] + rng.choice(["it reads ", "now: ", "try "])
        if len(made) >= 16:
            k = secrets.shape(made)
            hits.append(net.score((0, w) for w in secrets.windows(left + made + " " + t[at:], len(left), len(left) + len(made)))[0] >= net.thresholds[k])
    assert np.mean(hits) >= 0.88


def test_few_texts_fit_on_one_set(spark):
    for rows in ([], [(1, None)], [(1, "a b"), (2, "")]):
        net = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
        assert 0 <= net.false <= net.recall <= 1 and (net.thresholds > 0).all()
