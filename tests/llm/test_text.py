"""Encoding, token store and packing against plain versions."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txloom.llm import packing, token_store
from txloom.llm.encode import default_tokenizer, encoder
from txloom.llm.words import shingle_set, words_of
from txloom.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, ids string, part int"
TEXTS = [None, "", " \n\t", "one", "It's a dog's life.", "Café ÑANDÚ déjà!! 3²½ 日本 <|endoftext|> x<|startoftext|>", "same text " * 400, "same text " * 400, "x" * 5000, "w " * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "clash", 1) for k, t in enumerate(TEXTS)], DOCS)


def plain_ids(text):
    return encoder(default_tokenizer()).whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aZé'sß.,!#1 \n\t\x0b\x1c\xa0<|>İΣ")), max_size=60))
def test_ids_are_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder(default_tokenizer()).ids(text.encode()), "<u4").tolist() == plain_ids(text)


def test_shingles():
    assert words_of("A\x0bB  c D".encode()) == [b"a", b"b", "c d".encode()]
    assert len(shingle_set(None)) == len(shingle_set(b" ")) == 0
    assert len(shingle_set(b"a b c")) == 1
    assert len(shingle_set(b"a b c d e f a b c d e")) == 6


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store(spark, docs):
    ws = Workspace(spark, "t1")
    token_store.write(docs, default_tokenizer(), ws)
    at, got = 0, {r.doc_id: r for r in token_store.verify(spark, ws).collect()}
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read(spark, ws).collect()}
    for k, text in enumerate(TEXTS):
        ids = [*plain_ids(text), token_store.END]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32, got[k].intact) == (at, len(ids), crc(ids), True)
        assert back[k] == ids
        at += len(ids)
    objects = spark.read.parquet(ws.of("objects"))
    assert objects.count() == objects.select("digest").distinct().count()
    assert [r.doc_id for r in spark.read.parquet(ws.of("recipes")).orderBy("start").collect()] == list(range(len(TEXTS)))
    assert spark.read.parquet(ws.of("manifest")).agg(F.sum("n_tokens")).first()[0] == at


def test_store_finds_damage(spark, docs):
    ws = Workspace(spark, "t1b")
    token_store.write(docs, default_tokenizer(), ws)
    lost = spark.read.parquet(ws.of("objects")).orderBy(F.desc("n")).first()["digest"]
    kept = spark.read.parquet(ws.of("objects")).where(F.col("digest") != F.lit(lost))
    kept.write.parquet(ws.of("objects2"))
    ws.of = lambda name, old=ws.of: old("objects2" if name == "objects" else name)
    assert {r.intact for r in token_store.verify(spark, ws).collect()} == {True, False}


def damaged(spark, ws, name, change):
    """The intact rows of the store with one table replaced."""
    change(spark.read.parquet(ws.of(name))).write.parquet(ws.of(f"{name}-bad"))
    bad = Workspace(spark, "t1-bad")
    bad.of = lambda n: ws.of(f"{name}-bad" if n == name else n)
    return token_store.verify(spark, bad).collect()


RECIPES = {
    "reordered": (91, "reverse(digests)", "reverse(lengths)"),
    "replaced": (3, None, None),
    "dropped": (91, "slice(digests, 1, size(digests) - 1)", "slice(lengths, 1, size(lengths) - 1)"),
    "repeated": (91, "concat(digests, slice(digests, 1, 1))", "concat(lengths, slice(lengths, 1, 1))"),
    "emptied": (3, "slice(digests, 1, 0)", "slice(lengths, 1, 0)"),
}


@pytest.mark.parametrize("kind", sorted(RECIPES))
def test_store_finds_changed_recipes(spark, docs, kind):
    ws = Workspace(spark, f"t1-{kind}")
    # a text of as many ids as document 3, and one of several chunks
    more = docs.unionByName(spark.createDataFrame([(k, t, "en", "clash", 1) for k, t in ((90, "two"), (91, " ".join(f"w{n * n}" for n in range(1500))))], DOCS))
    assert len(plain_ids("one")) == len(plain_ids("two"))
    token_store.write(more, default_tokenizer(), ws)
    assert len(set(spark.read.parquet(ws.of("recipes")).where("doc_id = 91").first()["digests"])) > 2
    assert all(r.intact for r in token_store.verify(spark, ws).collect())
    doc, digests, lengths = RECIPES[kind]

    def change(recipes):
        if kind == "replaced":
            other = recipes.where("doc_id = 90").first()["digests"]
            return recipes.withColumn("digests", F.when(F.col("doc_id") == doc, F.array(*map(F.lit, other))).otherwise(F.col("digests")))
        new = {"digests": F.expr(f"if(doc_id = {doc}, {digests}, digests)"), "lengths": F.expr(f"if(doc_id = {doc}, {lengths}, lengths)")}
        return recipes.withColumns(new)

    got = {r.doc_id: r.intact for r in damaged(spark, ws, "recipes", change)}
    assert got == {r.doc_id: r.doc_id != doc for r in more.collect()}


def test_store_finds_lost_recipes(spark, docs):
    ws = Workspace(spark, "t1d")
    token_store.write(docs, default_tokenizer(), ws)
    recipes = spark.read.parquet(ws.of("recipes"))
    part = recipes.where("doc_id = 3").first()["_part"]
    gone = {r.doc_id for r in recipes.where(F.col("_part") == part).collect()}
    rows = damaged(spark, ws, "recipes", lambda t: t.where(F.col("_part") != part))
    assert {r.doc_id for r in rows if r.intact} == set(range(len(TEXTS))) - gone
    lost = [r for r in rows if not r.intact]
    assert [(r.doc_id, r.n_tokens) for r in lost] == [(None, recipes.where(F.col("_part") == part).agg(F.sum("n_tokens")).first()[0])]
    ws.of = lambda n, old=ws.of: old(n.replace("recipes-bad", "recipes-bad2"))
    rows = damaged(spark, ws, "recipes", lambda t: t.where("doc_id <> 3"))
    assert {r.doc_id for r in rows} == set(range(len(TEXTS))) - {3}
    assert {r.doc_id for r in rows if not r.intact} == gone - {3} and gone != {3}


def test_store_finds_a_changed_manifest(spark, docs):
    ws = Workspace(spark, "t1e")
    token_store.write(docs, default_tokenizer(), ws)
    part = spark.read.parquet(ws.of("recipes")).where("doc_id = 3").first()["_part"]
    hit = {r.doc_id for r in spark.read.parquet(ws.of("recipes")).where(F.col("_part") == part).collect()}
    rows = damaged(spark, ws, "manifest", lambda t: t.withColumn("root", F.when(F.col("_part") == part, F.lit("0")).otherwise(F.col("root"))))
    assert {r.doc_id for r in rows if not r.intact} == hit


def test_empty_store(spark, docs):
    ws = Workspace(spark, "t1c")
    token_store.write(docs.limit(0), default_tokenizer(), ws)
    assert token_store.verify(spark, ws).count() == 0


@given(st.lists(st.binary(max_size=40), max_size=6))
@settings(max_examples=50, deadline=None)
def test_crc_of_parts(parts):
    behind = np.array([sum(map(len, parts[k + 1 :])) for k in range(len(parts))], np.int64)
    crcs = np.array([zlib.crc32(p) for p in parts], np.uint64)
    assert int(np.bitwise_xor.reduce(token_store.shifted_crc(crcs, behind), initial=np.uint64(0))) == zlib.crc32(b"".join(parts))


def test_packing(spark, docs):
    pieces = packing.encode_pieces(docs, default_tokenizer(), Workspace(spark, "t5"), with_ids=True)
    placed = packing.place(pieces)
    rows = placed.collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for k, text in enumerate(TEXTS):
        ids = [*plain_ids(text), 0]
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == ids
        assert all(r.start == 2048 * r.piece and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(placed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)
    assert packing.place(packing.encode_pieces(docs.limit(0), default_tokenizer(), Workspace(spark, "t5b"))).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_fullest_is_fullest(counts, room):
    chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in chosen.items())


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_plan_uses_all(lengths):
    steps = packing.plan(collections.Counter(lengths), 64)
    used = collections.Counter()
    for chosen, times in steps:
        assert sum(k * n for k, n in chosen.items()) <= 64
        for k, n in chosen.items():
            used[k] += n * times
    assert used == collections.Counter(lengths)
    assert len(packing.intervals(steps)) == sum(sum(c.values()) for c, _ in steps)


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b"), (5, "x"), (None, None), (5, "x y z"), (5, "x"), (-3, "w " * 3000)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, place string")
    ws = Workspace(spark, "t1f")
    token_store.write(docs, default_tokenizer(), ws)
    got = sorted(token_store.verify(spark, ws).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5] and all(r.intact for r in got)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((k, crc([*plain_ids(t), token_store.END])) for k, t in rows)
    pieces = packing.place(packing.encode_pieces(docs, default_tokenizer(), Workspace(spark, "t5c"))).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(k for k, _ in rows)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_manifest_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 2)
    ws = Workspace(spark, "t1g")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(37)], "doc_id long, text string")
    token_store.write(docs, default_tokenizer(), ws)
    recipes = spark.read.parquet(ws.of("recipes")).collect()
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for m in spark.read.parquet(ws.of("manifest")).collect():
        own = sorted((r for r in recipes if r["_part"] == m["_part"]), key=lambda r: r.place)
        nodes = [sha(f"{r.doc_id}:{r.start}:{r.n_tokens}:{r.root.hex().upper()}") for r in own]
        width = max(r.place for r in recipes) + 1
        while width > 1 or len(nodes) > 1:
            nodes, width = [sha(",".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)], -(-width // 2)
        assert (m.n_docs, m.root) == (len(own), nodes[0])
    assert all(r.intact for r in token_store.verify(spark, ws).collect())
