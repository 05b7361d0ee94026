"""Trained operators: held-out accuracy, segment search, licence classes."""

import collections
import math
import random
import textwrap
import time

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txloom.llm import labelled, licenses, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.select("doc_id", label).distinct(), "doc_id")
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def odd(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "the idiot", "x"), (3, "a " * 20_000, "x")], "doc_id long, text string, score string")


@given(st.lists(st.integers(-6, 6), max_size=14))
@settings(max_examples=300, deadline=None)
def test_segments_are_all_maximal(values):
    scores = np.array(values, float) + 0.25 * np.sign(values) if values else np.zeros(0)

    def split(lo, hi):
        """Best segment (shortest, first), then the same on either side."""
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = scores[i:j].sum()
                if s > 1e-9 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) < 1e-9 and j - i < best[1] - best[0])):
                    best = (i, j, s)
        return [] if best is None else split(lo, best[0]) + [best] + split(best[1], hi)

    got = toxicity.segments(scores)
    want = split(0, len(scores))
    assert np.isclose(sorted(s for *_, s in got), sorted(s for *_, s in want)).all() if len(got) == len(want) else sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))


def test_toxicity(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count()
    assert accuracy(scored, labels, "toxic") > 0.9
    assert scored.where((F.col("predicted") == 1) != (F.col("score") >= 0.7)).count() == 0
    flagged = scored.where("predicted = 1").select("doc_id")
    assert flagged.join(toxicity.passages(docs, model).select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
    kept = toxicity.unflagged(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - flagged.count()
    assert toxicity.score(odd(spark), model).where("score between 0 and 1").count() == 5
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0


def test_quality(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model)
    assert scored.count() == docs.count()
    assert accuracy(scored, labels, "quality") > 0.9
    good = quality.good(docs, model)
    assert good.columns == docs.columns and good.count() == scored.where("predicted = 1").count()
    assert quality.score(odd(spark), model).where("score between 0 and 1").count() == 5
    none = quality.fit(docs.limit(0), labels)
    assert quality.score(docs.limit(3), none).select("score").distinct().first()[0] == 0.5


SMALL = "doc_id long, text string, lang string"


def small_tables(spark):
    """120 documents with labels; bad ones are of few words, toxic ones say one of three words."""
    rng = random.Random(31)
    good, bad, rude = ([f"{k}{n}" for n in range(m)] for k, m in (("plain", 90), ("Spam", 6), ("vile", 3)))
    docs, labels = [], []
    for k in range(240):
        toxic, quality = k % 3 == 0, k % 2
        words = [rng.choice(good if quality else bad + good[:5]) for _ in range(rng.randrange(8, 60))]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((k, " ".join(words) + " 12 !!", "en"))
        labels.append((k, quality, int(toxic)))
    docs += [(None, docs[0][1], None), (0, docs[0][1], "en"), (900, None, None), (901, "", None)]
    return spark.createDataFrame(docs, SMALL), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def plain_training(spark, docs, labels, column):
    """(id, text, label, hash of the id) of the labelled rows that aren't held out."""
    import zlib

    known = {row[0]: row[column] for row in labels if zlib.crc32(str(row[0]).encode()) % 3 != 1}
    hashes = {r.id: r.h for r in spark.range(240).select("id", F.xxhash64("id").alias("h")).collect()}
    return [(k, text, known[k], hashes[k]) for k, text, _ in docs if k in known]


def test_toxicity_by_a_plain_version(spark):
    df, label_df, docs, labels = small_tables(spark)
    model = toxicity.fit(df, label_df)
    rows = plain_training(spark, docs, labels, 2)
    aside = [r for r in rows if r[3] % 5 == 0]
    counts = collections.defaultdict(lambda: [0, 0])
    for _, text, label, h in rows:
        if h % 5:
            words = {w.decode() for w in text.lower().encode().split()}
            for token in {t for w in words for t in [w.strip(toxicity.MARKS) or w, *((w.strip(toxicity.MARKS) or w)[:n] + "~" for n in range(4, 10) if n < len(w.strip(toxicity.MARKS) or w))]}:
                counts[token][label] += 1
    n0, n1 = (sum(c[k] for c in counts.values()) for k in (0, 1))
    scores = {}
    for token, (y0, y1) in counts.items():
        if y1 >= 4 and y1 * n0 > y0 * n1 * 3:
            a = n1 * (y1 + y0) / (n1 + n0)
            d = math.log((y1 + a) / (2 * n1 - y1 - a)) - math.log((y0 + a) / (n0 + n1 - y0 - a))
            if d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= 3.5 and d >= 1.5:
                scores[token] = d
    assert scores and model.scores == pytest.approx(scores)
    value = sum(counts[t][0] / n0 * math.exp(model.rate * (d - 0.1)) for t, d in scores.items())
    rest = 1 - sum(counts[t][0] / n0 for t in scores)
    assert value + rest * math.exp(-0.1 * model.rate) == pytest.approx(1, abs=1e-6) or model.rate >= 100

    def word_scores(text):
        out = []
        for w in (text or "").lower().split():
            own = w.strip(toxicity.MARKS) or w
            out.append(max([scores.get(own, 0.0), *(scores.get(own[:n] + "~", 0.0) for n in range(4, 10) if n < len(own))]) - 0.1)
        return out

    def best(text, k):
        s = word_scores(text)
        top = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)
        offset = math.log(max(k * max(len(s), 1), 1e-9))
        return model.rate * top - offset if top > 0 else min(-offset, 0.0)

    clean = [text for _, text, label, _ in aside if label == 0]
    tops = [max((sum(s[i:j]) for s in [word_scores(t)] for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0) for t in clean]
    k = len(clean) / sum(max(len(t.split()), 1) * math.exp(-model.rate * max(x, 0.0)) for t, x in zip(clean, tops, strict=True))
    assert model.k == pytest.approx(k)
    scored = toxicity.score(df, model).collect()
    assert len(scored) == len(docs)
    by_text = collections.defaultdict(set)
    for r, (_, text, _) in zip(sorted(scored, key=lambda r: str(r.doc_id)), sorted(docs, key=lambda d: str(d[0])), strict=True):
        by_text[text or ""].add(r.score)
        b = toxicity.features(model, np.array(word_scores(text)))
        assert b[0] == pytest.approx(best(text, k))
        z = model.weights[0] + model.weights[1] * b[0] + model.weights[2] * b[1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
    assert all(len(v) == 1 for v in by_text.values())
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.unflagged(df.limit(0), model).count() == 0


def test_quality_by_a_plain_version(spark):
    df, label_df, docs, labels = small_tables(spark)
    model = quality.fit(df, label_df)
    pieces = lambda text: regex.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")

    def numbers(text):
        out = []
        for p in pieces(text):
            out.append(1 if p[0].isdigit() else 2 + xxhash.xxh3_64_intdigest(p.lower()) % (quality.BUCKETS - 2))
            if p.isupper() and len(p) > 1 and not p[0].isdigit():
                out.append(0)
        return out

    table = np.zeros((quality.BUCKETS, quality.DIMS))
    for _, text, _ in docs:
        own = numbers(text)
        for i, w in enumerate(own):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    table[w, quality.PLACES[own[j]]] += quality.SIGNS[own[j]]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    assert np.abs(table - model.table).max() < 1e-6
    again = quality.fit(df.repartition(7), label_df.repartition(3))
    assert (again.table == model.table).all() and all(np.array_equal(a, b) for a, b in zip(again.layers, model.layers, strict=True))

    def pooled(text):
        own = numbers(text)
        v = model.table[own] if own else np.zeros((1, quality.DIMS))
        return np.concatenate([v.mean(axis=0), v.std(axis=0)]).astype("<f4").astype(float)

    rows = sorted(plain_training(spark, docs, labels, 1), key=lambda r: (r[2], pooled(r[1]).astype("<f4").tobytes()))
    x, y = np.array([pooled(r[1]) for r in rows]), np.array([r[2] for r in rows], float)
    assert np.allclose(model.shift, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    aside = np.arange(len(y)) % 5 == 0
    w1, b1, w2, b2 = quality.train(((x - model.shift) / model.scale)[~aside], y[~aside])
    logit = lambda v: np.tanh((v - model.shift) / model.scale @ w1 + b1) @ w2 + b2
    losses = {t: np.mean([math.log1p(math.exp(-(2 * b - 1) * logit(a) / t)) for a, b in zip(x[aside], y[aside], strict=True)]) for t in (model.temperature, 0.9 * model.temperature, 1.1 * model.temperature)}
    assert min(losses, key=losses.get) == model.temperature or model.temperature in (0.2, 8.0) or abs(model.temperature - 0.2) < 1e-9
    for r, (_, text, _) in zip(sorted(quality.score(df, model).collect(), key=lambda r: str(r.doc_id)), sorted(docs, key=lambda d: str(d[0])), strict=True):
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, logit(pooled(text)) / model.temperature)))), abs=1e-6)
    assert quality.score(df.limit(0), model).count() == 0


def test_scores_do_not_depend_on_ids(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("?"))
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    b = {r.doc_id - 7: r.score for r in toxicity.score(moved, model).collect()}
    assert a == b


def test_training_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(6, 1), (8, None), (None, 1)], "doc_id long, toxic int"))
    rows = labelled.training_rows(docs, labels, "toxic")
    assert rows.where(labelled.held_out(F.col("doc_id"))).count() == 0
    assert rows.where("doc_id = 6").count() == 0
    assert labelled.training_rows(docs, labels, "toxic", 50).count() == 50


def test_a_labelled_id_counts_once(spark):
    docs = spark.range(300).selectExpr("id % 3 AS doc_id", "concat('text ', id % 2) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    rows = labelled.training_rows(docs, labels, "quality").collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 3 and {r.label for r in rows} <= {0, 1}


def test_long_texts_are_pooled_in_blocks(monkeypatch):
    table = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    texts = [b"a few words of it " * 40, b"", b"one", None]
    whole = quality.pooled(table, texts)
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    assert np.allclose(quality.pooled(table, texts), whole) and not whole[1].any() and whole[0].any()


def plain_scan(text, model):
    """The licence scan of one text in plain Python."""
    out = []
    for n, line in enumerate(regex.sub(licenses.WRAP, " ", text or "").split("\n")):
        words = licenses.words_of(line)
        if not words:
            continue
        z = np.array(model.bias)
        for g in licenses.grams(words):
            z = z + np.array(model.weights.get(g, [0.0] * len(z)))
        p = np.exp(z - z.max())
        p /= p.sum()
        family = model.families[int(p.argmax())] if p.max() >= licenses.SURE else licenses.UNKNOWN
        threes = lambda w: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)}
        like = max((len(threes(words) & threes(licenses.words_of(t))) / len(threes(licenses.words_of(t))) for t in licenses.templates(family)), default=0.0)
        if family != licenses.UNKNOWN or set(words) & set(licenses.ANCHORS):
            out.append((n, family if like >= licenses.LIKE else licenses.UNKNOWN, round(float(p.max()), 6), round(like, 6), like >= licenses.LIKE))
    return out


def test_licenses(spark):
    rng = random.Random(8)
    notices = [(f, t) for f, own in licenses.NOTICES.items() for t in own]
    texts = [None, "", "no notice here", "\n\nthe license plate was lost", *(f"before\n{t.upper()}\nafter {t}" for _, t in notices), *licenses.OTHERS]
    texts += ["\n".join(rng.choice(notices)[1] for _ in range(5)) for _ in range(10)] + ["word " * 30_000 + "released under the MIT license"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, family string")
    model = licenses.fit()
    got = {}
    for r in licenses.scan(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, round(r.probability, 6), round(r.similarity, 6), r.confirmed))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t in enumerate(texts) if (v := plain_scan(t, model))}
    for k, (family, _) in enumerate(notices, 4):
        assert [x[1] for x in sorted(got[k])] == [family, family]
    assert all(x[1] == licenses.UNKNOWN for k in range(4 + len(notices), 4 + len(notices) + len(licenses.OTHERS)) for x in got.get(k, []))
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_licenses_without_an_anchor(spark):
    names = {"Distributed under GPLv3 or later": "GPL-3.0", "LGPL-2.1": "LGPL", "Creative Commons Attribution 4.0 International": "CC-BY", "BSD-3-Clause": "BSD", "Apache-2.0": "Apache-2.0"}
    others = ["AGPLv3", "see https://www.gnu.org/licenses/", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND", "before"]
    docs = spark.createDataFrame([(1, "\n".join([*names, "", *others])), (2, None), (3, " ")], "doc_id long, text string")
    model = licenses.fit()
    found = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(docs, model).collect()}
    assert found == {(1, k): f for k, f in enumerate(names.values())}
    rows = {(r.doc_id, r.paragraph): r.family for r in licenses.score(docs, model).collect()}
    assert rows == found | {(1, len(names) + 1 + k): licenses.UNKNOWN for k in range(len(others))}


#: Public notices in other words and longer forms than those of the training, one to a family (fixed values).
HELD_OUT = {
    "GPL-3.0": "Foo is free software: you may copy, redistribute and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License or any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this data and associated documentation files, to deal in the data without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of it.",
    "BSD": "Redistribution and use in source and compiled forms of this code, with or without modification, are permitted provided that the conditions below are met:",
    "Apache-2.0": "This library is licensed under the Apache License, Version 2.0; you may not use it except in compliance with the License.",
    "ISC": "Permission to use, copy, modify and distribute this library for any purpose with or without fee is hereby granted, provided that this permission notice appears in all copies.",
    "LGPL": "This file is part of Foo, which can be redistributed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1.",
    "AGPL-3.0": "The server is licensed under the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "MPL-2.0": "The Source Code Form of this file is subject to the Mozilla Public License, version 2.0.",
    "CC-BY-SA": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License.",
    "Zlib": "Permission is granted to everyone to use this library for any purpose, including commercial applications, and to alter and redistribute it freely.",
}
EVERYDAY = ("He was granted permission to modify the house without restriction.", "The conditions of the contract were met in the spring.", "Version 3 of the plan was published by the foundation.", "You can distribute the leaflets free of charge to any person.", "The source of the rumour was not named in the documentation.", "Please keep this notice on the wall.")


def test_licences_kept_from_training(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*HELD_OUT.values(), *EVERYDAY])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.score(docs).collect()}
    right = [got[k].likely == f for k, f in enumerate(HELD_OUT)]
    assert sum(right) >= 9, [(f, got[k].likely, got[k].probability) for k, f in enumerate(HELD_OUT)]
    assert all(got[k].family == (got[k].likely if got[k].confirmed else licenses.UNKNOWN) for k in got)
    assert all(got[len(HELD_OUT) + k].family == licenses.UNKNOWN for k in range(len(EVERYDAY)))


PROSE = {
    "de": "Sie kam mit der Zeitung aus der Stadt und sprach mit mir. Mit dem Rad, mit dem Bus: mit allem.",
    "fr": "La version de la pièce est jouée avec la permission du public de la ville.",
    "es": "La licencia del perro fue modificada por el autor de la obra, con permiso.",
    "it": "Il sorgente del fiume è nella città, con la licenza di caccia.",
    "nl": "De man kwam met de trein en met de fiets naar de stad.",
    "sv": "Hon kom mit i natten med licens och tillstånd.",
    "pl": "Kobieta poszła z psem do parku; mit grecki i licencja.",
    "en": "He came with the news that MIT and the Apache had met in the public domain.",
}


def test_no_prose_is_a_licence(spark, sf_dir):
    """Invented sentences of several languages, and all given documents, whose licence lines are the only ones with a family."""
    docs = spark.createDataFrame(list(enumerate(PROSE.values())), "doc_id long, text string")
    assert {r.family for r in licenses.score(docs).collect()} == {licenses.UNKNOWN}
    given = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    named = licenses.score(given).where(f"family <> '{licenses.UNKNOWN}'").collect()
    assert len(named) > 20 and all(r.confirmed and r.anchored for r in named)


def test_the_table_of_grams_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    grams = sorted(licenses.fit().weights)
    rows = spark.createDataFrame([([*grams, "no such gram", "größe"],)], "g array<string>")
    assert rows.select(licenses._known(F.col("g"), grams)).first()[0] == list(range(len(grams)))

@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(spark, mark):
    long = [(f, t) for f, own in licenses.NOTICES.items() for t in own if len(t) > 120]
    texts = ["Some code.\n\n" + "\n".join(mark + line for line in textwrap.wrap(t, 70)) + "\n\nMore of it." for _, t in long]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id].append((r.family, r.confirmed))
    assert len(long) > 10
    assert [(f, True) in got[k] for k, (f, _) in enumerate(long)] == [True] * len(long)


def test_long_paragraphs_take_linear_time(spark):
    model = licenses.fit()
    seconds = []
    for n in (20_000, 80_000):
        text = " ".join(f"w{k}" for k in range(n)) + " released under the MIT License"
        began = time.perf_counter()
        rows = licenses.score(spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string"), model).collect()
        seconds.append(time.perf_counter() - began)
        assert [(r.doc_id, r.paragraph) for r in rows] == [(None, 0)] * 2
    assert max(seconds) < 20
