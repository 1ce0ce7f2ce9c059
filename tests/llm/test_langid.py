import zlib

import numpy as np
import pandas as pd
from common_llm import ROWS, SF, edge_docs, empty_docs

from chorus.llm import langid


def brute_log_prob(counts, order, langs, vocab):
    """Interpolated Kneser-Ney by the textbook recursion over dictionaries, one language."""
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        t = {}
        for g in tables[n + 1]:
            if g[1:] != chr(langid.PAD) * n:
                t[g[1:]] = t.get(g[1:], 0) + 1
        tables[n] = t

    def prob(g):
        if not g:
            return 1 / vocab
        t = tables[len(g)]
        n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = {k: v for k, v in t.items() if k[:-1] == g[:-1]}
        if not same:
            return prob(g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * prob(g[1:])

    return prob


def test_probabilities_equal_the_recursion():
    texts = {"a": "abra cadabra abc bca", "b": "zyx xyz yyx abz"}
    order = 3
    rows = []
    for lang, t in texts.items():
        s = chr(langid.PAD) * (order - 1) + t
        grams = pd.Series([s[i : i + order] for i in range(len(s) - order + 1)]).value_counts()
        rows += [(lang, g, c) for g, c in grams.items()]
    counts = pd.DataFrame(rows, columns=["lang", "gram", "c"])
    model = langid.Model(counts, order)
    vocab = len(set("".join(texts.values()))) + 1
    text = "abc zyq abx"
    sym, _, real = langid.symbols([text], order)
    lp = model.log_prob(sym, real)
    s = chr(langid.PAD) * (order - 1) + text
    for k, lang in enumerate(model.langs):
        prob = brute_log_prob({g: c for x, g, c in rows if x == lang}, order, model.langs, vocab)
        want = [np.log(prob(s[i : i + order])) for i in range(len(text))]
        assert np.allclose(lp[:, k], want, atol=1e-4)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit(docs)).toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id])
    letters = out.text.map(lambda t: any(c.isalpha() for c in t or ""))
    assert (out.lang_pred == out.lang)[held & letters].mean() > 0.97
    assert ((out.score >= 0) & (out.score <= 1)).all()
    assert out.rejected[letters].mean() < 0.02
    strange = spark.createDataFrame([(1, "qxzj kvvw xqqz jjkx wvzq " * 20), (2, "1234 5678")], "doc_id long, text string")
    got = langid.identify(strange, langid.fit(docs)).orderBy("doc_id").collect()
    assert got[0]["rejected"] and got[1]["rejected"] and got[1]["lang_pred"] == "und"


def test_held_out_rows_and_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.langs == b.langs and all((x[1] == y[1]).all() for x, y in zip(a.gram, b.gram))


def test_edges(spark):
    docs = edge_docs(spark)
    out = langid.identify(docs, langid.fit(docs))
    assert set(out.columns) == set(docs.columns) | {"score", "cross_entropy", "rejected"}
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        else:
            assert r["lang_pred"] in ("en", "de")
    empty = empty_docs(spark)
    assert langid.fit(empty) is None
    assert langid.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_spark_gathers_the_same_as_the_whole_counts(spark):
    """Without a bound the model is that of the whole counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where("lang is not null and text is not null and doc_id is not null").where(~langid.held_out())
    grams = train.select("lang", "text").mapInArrow(langid._count(4), "lang string, gram string, c long")
    counts = grams.groupBy("lang", "gram").agg({"c": "sum"}).toDF("lang", "gram", "c").toPandas()
    a, b = langid.Model(counts, 4), langid.fit(docs)
    assert a.langs == b.langs and np.allclose(a.floor, b.floor, atol=1e-6)
    for x, y in zip(a.gram + a.context, b.gram + b.context):
        assert (x[0] == y[0]).all() and np.allclose(x[1], y[1], atol=1e-4)


def test_a_small_language_beside_a_rich_one(spark, monkeypatch):
    """The bound holds for each language alone, and what is dropped stays in the back-off."""
    monkeypatch.setattr(langid, "MAX_GRAMS", 300)
    rng = np.random.default_rng(3)
    rich = ["".join(chr(0x4E00 + i) for i in rng.integers(0, 3000, 200)) for _ in range(60)]
    small = ["the mill by the river turns slowly", "a small boat lies by the old mill"]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = list(zip(ids, small + rich, ["aa"] * len(small) + ["zz"] * len(rich)))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 300 < len(model.gram[3][0]) < 500  # the bound holds for the rich one
    assert langid._hash(["slow", "boat", "rive"])[0] in model.gram[3][0]  # seen once, kept
    assert model.langs == ["aa", "zz"]
    ask = spark.createDataFrame([(1, "the old boat by the river"), (2, rich[0])], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(ask, model).orderBy("doc_id").collect()] == ["aa", "zz"]
    # the probabilities after any context still add up to 1, less one unseen symbol
    for before in ("the", "mil", rich[0][:3], rich[0][5:8]):
        alphabet = sorted(set("".join(small)) | set("".join(rich)))
        texts = [before + c for c in alphabet]
        sym, doc, real = langid.symbols(texts, 4)
        last = np.append(doc[real][1:] != doc[real][:-1], True)
        p = np.exp(model.log_prob(sym, real)[last].astype(float)).sum(axis=0)
        assert (p < 1.0001).all() and (p > 0.9).all(), p


def test_calibration_takes_every_training_text(spark):
    """Mean and spread are those of all training texts, also where there are many."""
    rng = np.random.default_rng(5)
    n_rows = 34_000  # about 22,700 of them teach
    words = ["mill", "river", "boat", "old", "turns", "slowly", "lies", "the"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 6))), "aa" if i % 3 else "bb") for i in range(n_rows)]
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    model = langid.fit(docs)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(train) > 21_000
    h, n = model.entropies([r[1] for r in train])
    lang = np.array([r[2] for r in train])
    for k, name in enumerate(model.langs):
        x, size = h[lang == name, k].astype(float), n[lang == name]
        ok = x <= np.quantile(x, 0.99)
        x, size = x[ok], size[ok]
        assert np.isclose(model.mean[k], np.average(x, weights=size), rtol=1e-9)
        want = np.linalg.lstsq(np.stack([np.ones(len(x)), 1 / size], 1), (x - model.mean[k]) ** 2, rcond=None)[0]
        assert np.allclose(model.spread[k], (max(want[0], 0.01), max(want[1], 1.0)), rtol=1e-6)
