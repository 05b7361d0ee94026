"""Personal data against plain patterns, and disclosure against counts over all documents."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txloom.llm import privacy
from txloom.llm.workspace import Workspace

KIND = "doc_id long, text string"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(v - 9 if (v := int(d) * (1 + k % 2)) > 9 else v for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    return kind == "email" or (8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits))


def base(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PLAIN.items() for m in pattern.finditer(text or "") if valid(kind, m[0])]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    pieces = ["a@b.c", "x.y%z@mail-1.example.com", "@", "a@b", ".", "..", "%", "-", " ", "  ", "+", "+1 (523) 555-1055", "4785380592391139", "4785 3805-9239 1139", "1.2.3.4", "256.1.1.1", "007.8.9.255", "1", "22", "é", "日本", "𝒳", "\n", "word", "(", ")", "+4", "79927398713", "0000000000000000"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 25))) for _ in range(3000)]
    texts += [None, "", "+" * 50, "1." * 700 + "x", "a@b.c.d%x@y.z", "5.5.5.5.5.5.5.5", "9" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), KIND)
    got = {r.doc_id: r for r in privacy.digests(privacy.scan(df, Workspace(spark, "privacy"))).collect()}
    for k, text in enumerate(texts):
        want = base(text)
        mine = got[k].spans.split(",") if got[k].spans else []
        assert [s for s in mine if s.split(":")[0] in privacy.KINDS] == [f"{a}:{b}:{c}" for a, b, c in want], text
        assert got[k].base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in privacy.KINDS] == [sum(w[0] == x for w in want) for x in privacy.KINDS]


def test_long_texts_take_no_recursion_and_no_squares(spark):
    none = ["7" * 300_000, "a" * 1_000_000, "1 " * 300_000, "+1 " * 200_000, "+1" + "(" * 300_000]  # the plain patterns take squares here
    many = ["a.b@c." * 3000, "1.2.3.4 " * 3000]
    got = privacy.digests(privacy.scan(spark.createDataFrame(list(enumerate(none + many)), KIND), Workspace(spark, "privacy"))).collect()
    want = [""] * len(none) + [shown(base(t)) for t in many]
    assert {r.doc_id: r.base_sha256 for r in got} == {k: hashlib.sha256(w.encode()).hexdigest() for k, w in enumerate(want)}


def test_sums_before(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        numbers = [k % 13 for k in range(n)]
        got = spark.createDataFrame([(numbers,)], "x array<long>").select(privacy.sums_before(F.col("x"))).first()[0]
        assert got == [sum(numbers[:k]) for k in range(n)]


def terms(text):
    return {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "") if len(w) >= privacy.LETTERS}


def disclosed(texts):
    """(row, term, action) from counts over all documents; contexts that reach the gap's ends only."""
    around = []
    for text in texts:
        own = defaultdict(set)
        for kind, pattern in PLAIN.items():
            found = [(m.start(), m.end(), m[0]) for m in pattern.finditer(text or "")]
            edges = [0, *(x for a, b, _ in found for x in (a, b)), len(text or "")]
            for k, (_, _, value) in enumerate(found):
                if valid(kind, value):
                    before, behind = text[edges[2 * k] : edges[2 * k + 1]], text[edges[2 * k + 2] : edges[2 * k + 3]]
                    assert max(len(before), len(behind)) <= privacy.REACH
                    own[kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()] |= terms(before) | terms(behind)
        around.append(own)
    n_term, n_entity, n_both, contexts = (defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set))
    for text, own in zip(texts, around, strict=True):
        for t in terms(text):
            n_term[t] += 1
        for e, ts in own.items():
            n_entity[e] += 1
            for t in ts:
                n_both[e, t] += 1
                contexts[e, t].add(frozenset(ts))
    out = {}
    for k, own in enumerate(around):
        for e, ts in own.items():
            for t in ts:
                if len(contexts[e, t]) >= privacy.CONTEXTS:
                    bits, secret = math.log2(n_both[e, t] * len(texts) / (n_term[t] * n_entity[e])), math.log2(len(texts) / n_entity[e])
                    if bits >= privacy.BITS and bits / secret >= privacy.GENERALISE:
                        out[k, t] = max(out.get((k, t), ""), privacy.REMOVED if bits / secret >= privacy.REMOVE else privacy.GENERALISED)
    return out


def corpus():
    rng = random.Random(7)
    common = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(10)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(3, 15))) for _ in range(400)]
    for k in range(6):  # an entity that some terms give away, and others don't
        texts.append(f"{rng.choice(common)} Zanzibar {rng.choice(common)} ann.lee@Mail.example.com {rng.choice(common)} harbour. Zanzibar")
    texts += ["harbour " + rng.choice(common)] * 2
    texts += [f"copied text Quux {common[3]} 10.1.2.3 end"] * 40  # copies are one witness
    texts += ["café 4785380592391139 café"] * 2 + [None, "", "Zanzibar alone"]
    return texts


def test_terms_that_disclose(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], KIND + ", term string").repartition(4)
    want = disclosed(texts)
    assert {t for _, t in want} == {"zanzibar", "harbour"} and set(want.values()) == {privacy.GENERALISED, privacy.REMOVED} or want
    got = {r.doc_id: r for r in privacy.scan(df, Workspace(spark, "privacy")).collect()}
    for k, text in enumerate(texts):
        spans = sorted((want[k, w], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "") if (k, w := m[0].lower()) in want)
        assert sorted((s.kind, s.start, s.end) for s in got[k].added) == spans
        assert [(s.kind, s.start, s.end) for s in got[k].base] == base(text)
    assert not got[len(texts) - 1].added  # a document without the entity is left alone


def test_sanitised_texts(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), KIND)
    out = {r.doc_id: r.text for r in privacy.sanitised(df, Workspace(spark, "privacy")).collect()}
    assert set(out) == {k for k, t in enumerate(texts) if base(t)}
    want = disclosed(texts)
    for k, text in out.items():
        assert not base(text) and not terms(text) & {t for r, t in want if r == k}
    assert out[len(texts) - 4] == "café [card] café"


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "a@b.co"), (None, "a@b.co")]])
def test_edges(spark, rows):
    got = privacy.digests(privacy.scan(spark.createDataFrame(rows, KIND), Workspace(spark, "privacy"))).collect()
    assert [(r.doc_id, r.spans) for r in got] == [(i, shown(base(t))) for i, t in rows]


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = privacy.digests(privacy.scan(df, Workspace(spark, "privacy"))).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {r.doc_id: hashlib.sha256(shown(base(r.text)).encode()).hexdigest() for r in df.collect()}
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0
