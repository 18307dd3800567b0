"""The byte network against a direct convolution, and columns of many labels."""

import numpy as np
from pyspark.sql import functions as F

from thermolith.llm import langid, mixing


def direct(network, text):
    """Probabilities of a whole text: every window is embedded, convolved, rectified, pooled and classified one by one."""
    data = text.encode()
    total = np.zeros(len(network.langs))
    for at in range(0, len(data), langid.WINDOW):
        window = list(data[at : at + langid.WINDOW])
        window += [langid.PAD] * (langid.WINDOW - len(window))
        pooled = []
        for width, filters, bias in zip(langid.WIDTHS, network.filters, network.bias, strict=True):
            answers = []
            for i in range(langid.WINDOW - width + 1):
                seen = np.concatenate([network.embedding[b] for b in window[i : i + width]]).astype(float)
                answers.append(seen @ filters.astype(float))
            pooled.append(np.maximum(np.max(answers, axis=0) + bias, 0))
        z = np.concatenate(pooled) @ network.out.astype(float) + network.out_bias
        z -= z.max()
        total += z - np.log(np.exp(z).sum())
    p = np.exp(total / max(1, -(-len(data) // langid.WINDOW)))
    return p / p.sum()


TEXTS = {"en": "the cat and the dog were in the house when it rained on them ", "de": "der hund und die katze waren im haus als es auf sie regnete ", "fr": "le chien et le chat dans la maison quand il pleuvait sur eux ", "el": "ο σκύλος και η γάτα ήταν στο σπίτι όταν έβρεχε "}


def test_prediction_is_a_direct_convolution(spark):
    rows = [(i, t * (1 + i % 9), lang) for i in range(60) for lang, t in TEXTS.items()]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    network = langid.fit(*langid.sample(docs, F.lit(True)))
    some = ["the house", TEXTS["de"] * 7, TEXTS["el"] * 3, "x", "la maison et le chat " * 40, "été"]
    out = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), network).collect()}
    for i, text in enumerate(some):
        p = direct(network, text)
        assert out[i]["lang_pred"] == network.langs[int(p.argmax())] and abs(out[i]["score"] - p.max()) < 1e-3
    assert [out[i]["lang_pred"] for i in (1, 2, 4)] == ["de", "el", "fr"]


def test_tables_and_labels_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TABLES", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(97, 123, (60, langid.WINDOW)).astype(np.int32)
    y = np.array([k for k in range(6) for _ in range(12 if k < 2 else 6)][:60])
    likely = langid.Likelihood.fit(list("abcdef"), x[: len(y)], y)
    assert len(likely.tables) == 3 and likely.of.tolist() == [0, 1, 2, 2, 2, 2]
    assert (likely.away(np.arange(len(y)), x[: len(y)], likely.of[y]) < 50).all()
    docs = spark.createDataFrame([(i, "some text here", f"label {i % 40:02d}") for i in range(200)] + [(1000 + i, "more", "often") for i in range(50)], "doc_id long, text string, lang string")
    langs, _, _ = langid.sample(docs, F.lit(True), labels=7)
    assert len(langs) == 7 and "often" in langs and langs == sorted(langs)
    assert len(langid.sample(docs, F.lit(True))[0]) == 41


def test_mixes_of_rows_alike_in_id_and_text_agree(spark):
    rows = [(i % 5, "a b c d e", "s", f"x{i}", {"k": i}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other string, m map<string,int>")
    order = lambda df: [(r["doc_id"], r["other"]) for r in mixing.mix(df).collect()]
    assert order(docs) == order(docs.repartition(7)) == order(docs.orderBy(F.desc("other")))
