"""Near duplicates, vectors and benchmark passages against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from txloom.llm import components, decontam, minhash, vector_dedup
from txloom.llm.words import shingle_set
from txloom.llm.workspace import Workspace


def united(ids, links):
    parent = {k: k for k in ids}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    out = [None, "", "  ", "few words", "Few  WORDS", "other words"]
    for size in (12, 60, 200):
        for _ in range(6):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for edits in (0, 1, 2, 4, 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = word()
                out.append(" ".join(copy))
    out += [" ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))]) for _ in range(30)]
    hot = [word() for _ in range(150)]
    for _ in range(260):  # a large bucket whose members link in part
        copy = list(hot)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(150)] = word()
        out.append(" ".join(copy))
    return out


def test_near_duplicates(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(rows)], "doc_id long, text string, n_shingles int, fp string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, Workspace(spark, "t9")).collect()}
    sets = [shingle_set((t or "").encode()) for t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    want = united(range(len(rows)), links)
    assert {k: got[k].component_id for k in got} == want
    assert all(got[k].n_shingles == len(sets[k]) and got[k].kept == (want[k] == k) for k in got)


def test_near_duplicates_edges(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind), Workspace(spark, "t9b")).count() == 0
    same = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, None)], kind)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in minhash.near_duplicates(same, Workspace(spark, "t9c")).collect()) == [("5", "5"), ("5", "5"), ("None", "None")]


ODD = [(3, "X"), (5, "X"), (5, "Y"), (9, "Y"), (None, "X near"), (None, "alone"), (None, "alone"), (8, "Y"), (8, "Y"), (7, None), (7, ""), (None, None)]


def odd_documents(spark):
    rng = random.Random(21)
    base = {k: [f"w{rng.randrange(9000)}" for _ in range(80)] for k in ("X", "Y", "alone")}
    near = [*base["X"]]
    near[-1] = "other"
    texts = {k: " ".join(v) for k, v in base.items()} | {"X near": " ".join(near), None: None, "": ""}
    rows = [(i, texts[k], k or "") for i, k in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), texts


def test_repeated_and_null_ids(spark):
    docs, _ = odd_documents(spark)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, Workspace(spark, "t9d")).collect()), key=str)
    want = [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (None, 3, False), (None, None, True), (None, None, True), (8, 5, False), (8, 5, False), (7, 7, True), (7, 7, True), (None, None, True)]
    assert got == sorted(want, key=str)


def test_no_text_is_lost_and_none_is_left_twice(spark, sf_dir):
    docs, texts = odd_documents(spark)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = [(3, "X"), (5, "Y"), (None, "alone"), (7, ""), (7, ""), (None, "")]
    assert sorted(((r.doc_id, r.label) for r in kept.collect()), key=str) == sorted(want, key=str)
    twice = docs.where("label = 'Y'").unionByName(docs.where("label = 'Y' and doc_id = 5"))
    assert [r.doc_id for r in minhash.deduplicated(twice, Workspace(spark, "t9e")).collect()] == [5]
    assert minhash.deduplicated(docs.limit(0), Workspace(spark, "t9f")).count() == 0


def test_small_and_large_buckets_agree(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").where("doc_id >= 100")
    found = []
    for small, block in ((128, 512), (1, 512), (1, 16), (10_000, 512)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK", block)
        found.append(sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, Workspace(spark, "t9g")).collect()))
    assert found[0] == found[1] == found[2] == found[3]


def test_pairs_at_the_threshold_are_candidates():
    """Sets just over the limit share a key and have near signatures."""
    rng = np.random.default_rng(12)
    for _ in range(1500):
        n = int(rng.integers(20, 600))
        own = -(-2 * n * 75 // 175)  # shared values of two sets of n for a similarity of 0.75
        values = rng.integers(0, 2**64, 2 * n - own, dtype=np.uint64)
        one, two = np.sort(values[:n]), np.sort(values[n - own :])
        assert minhash.linked(one, two)
        same = np.frombuffer(minhash.signature(one), "<u2") == np.frombuffer(minhash.signature(two), "<u2")
        assert (same[: minhash.INDEXED].reshape(-1, minhash.CHUNK).sum(axis=1) >= minhash.CHUNK - 1).any()
        assert minhash.SYMBOLS - same.sum() <= minhash.FAR


def test_components_of_chains_and_hubs(spark, monkeypatch):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 600)
    links = [*zip(ids[:200], ids[1:200], strict=False), *((ids[300], x) for x in ids[301:500]), (ids[550], ids[551]), (ids[551], ids[550]), (ids[560], ids[560])]
    df = spark.createDataFrame(links, "a long, b long")
    want = united(ids, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components.components(df, Workspace(spark, "tc"))
    assert sorted(map(tuple, got.collect())) == sorted((k, v) for k, v in want.items() if k in linked)
    monkeypatch.setattr(components, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="not complete"):
        components.components(df, Workspace(spark, "tc2"))


def test_pigeonhole_finds_every_near_signature():
    rng = np.random.default_rng(1)
    for _ in range(200):
        same = np.ones((1, minhash.SYMBOLS), bool)
        same[0, rng.choice(minhash.INDEXED, 23, replace=False)] = False
        chunks = same[0, : minhash.INDEXED].reshape(-1, minhash.CHUNK).sum(axis=1)
        assert (chunks >= minhash.CHUNK - 1).any()
        slot = int(minhash.first_slot(same)[0])
        assert chunks[slot // minhash.CHUNK] >= minhash.CHUNK - 1


@pytest.mark.parametrize("tile", [6144, 40])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 48))
    x = np.vstack([base, base[:20] + 0.15 * rng.normal(size=(20, 48)), base[:10] * 3, np.repeat(base[:1], 15, axis=0)]).astype("f4")
    odd = [None, [], [0.0] * 48, [float("nan")] * 48, [None] * 48, [1.0] * 47]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(1000 + k, v, 1) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, tile int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, Workspace(spark, "t2")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = united([r[0] for r in rows], list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    assert {k: got[k].component_id for k in got} == want
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()
    assert all(got[1000 + k].n_links == 0 and got[1000 + k].kept for k in range(len(odd)))
    assert vector_dedup.near_vectors(df.limit(0), Workspace(spark, "t2b")).count() == 0


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (None, [1.0, 0.1]), (None, [-1.0, 0.0]), (None, [-2.0, 0.0]), (7, [0.0, 2.0]), (7, None), (3, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, m int, leaf int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df, Workspace(spark, "t2e")).collect()), key=str)
    want = [(5, 2, 3, False), (5, 1, 5, True), (None, 2, 3, False), (None, 1, None, True), (None, 1, None, True), (7, 1, 5, False), (7, 0, 7, True), (3, 2, 3, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_far_tiles_do_not_meet(spark, monkeypatch):
    """Clusters part into leaves that meet no other, and results are those of one tile; a third of the rows are one vector."""
    monkeypatch.setattr(vector_dedup, "TILE", 30)
    rng = np.random.default_rng(8)
    centres = np.eye(24)[:6]
    x = np.vstack([centres.repeat(60, axis=0) + 0.12 * rng.normal(size=(360, 24)), np.tile(centres[0], (180, 1))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(vector_dedup, "layout", lambda *a, old=vector_dedup.layout: seen.extend(old(*a)) or seen)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, Workspace(spark, "t2f")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = united(range(len(x)), list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    assert {k: got[k].component_id for k in got} == want
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()
    tiles = sum(n for _, _, n, _ in seen)
    assert tiles > 6 and sum(n * m for _, _, n, others in seen for _, m in others) < 0.7 * tiles**2


def test_merge_keeps_earlier_links():
    m2, m1, old, x1, x2, y1, y2 = range(7)
    label = vector_dedup._merge(np.arange(7), np.array([old, old]), np.array([x1, x2]))
    label = vector_dedup._merge(label, np.array([x1, m1, x2, m2]), np.array([y1, y1, y2, y2]))
    assert label.tolist() == [0] * 7


def test_chain_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    chain = [np.eye(48)[0]]
    for _ in range(2199):  # each 24 degrees from the one before
        side = rng.normal(size=48)
        side -= (side @ chain[-1]) * chain[-1]
        chain.append(np.cos(np.radians(24)) * chain[-1] + np.sin(np.radians(24)) * side / np.linalg.norm(side))
    x = np.array(chain)[rng.permutation(len(chain))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, Workspace(spark, "t2c")).collect()}
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = united(range(len(x)), list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()
    assert {k: got[k].component_id for k in got} == want and set(want.values()) == {0}


@pytest.mark.parametrize("tile", [6144, 20])
def test_vectors_of_two_lengths(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng = np.random.default_rng(6)
    rows, links = [], []
    for d, n in ((8, 50), (12, 40), (30, 6), (1, 2)):
        x = rng.normal(size=(n, d))
        x[n // 2 :] = x[: n - n // 2] * 2
        at = len(rows)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        links += [(at + a, at + b) for a, b in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if a != b]
        rows += [(at + k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, Workspace(spark, "t2d")).collect()}
    assert {k: got[k].component_id for k in got} == united(range(len(rows)), links)
    assert [got[k].n_links for k in range(len(rows))] == [sum(a == k for a, _ in links) for k in range(len(rows))]


def test_contamination(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(30_000)]
    items = [" ".join(words[k * 100 : k * 100 + n]) for k, n in enumerate((9, 20, 45, 5, 3, 70))]
    edited = items[2].split()
    edited[20] = "changed"
    docs = [None, "", " ".join(words[:12]), " ".join(words[5000:29000]) + " " + items[5], " ".join(edited), items[4].upper(), " ".join(items[1].split()[:17]), " ".join(items[1].split()[:24])]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, " "), (0, items[0])], "item_id long, text string")
    want = set()
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            own, wide = shingle_set(item.encode()), min(5, len(item.split()))
            have = shingle_set((text or "").encode(), wide) if len((text or "").split()) >= wide else np.array([])
            if len(np.intersect1d(own, have)) >= decontam.needed(len(own)):
                want.add((d, k))
    get = lambda: {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert get() == want and want
    monkeypatch.setattr(decontam, "SLICE_WORDS", 30)  # several slices
    assert get() == want
    dirty = {d for d, _ in want}
    rest = lambda f: sorted(((r.doc_id, r.text) for r in decontam.clean(f, bench).collect()), key=str)
    assert rest(frame) == sorted([(k, t) for k, t in enumerate(docs) if k not in dirty], key=str)
    # rows are judged by their texts, whatever their ids
    odd = spark.createDataFrame([(1, docs[2]), (1, "clean"), (None, docs[2]), (None, "clean"), (1, "clean"), (2, None)], "doc_id long, text string")
    assert rest(odd) == sorted([(1, "clean"), (1, "clean"), (None, "clean"), (2, None)], key=str)
    assert sorted(map(str, decontam.contaminated(odd, bench).select("doc_id", "item_id").collect())) == ["Row(doc_id=1, item_id=0)", "Row(doc_id=None, item_id=0)"]
    assert decontam.clean(frame, bench.limit(0)).count() == len(docs)
    assert decontam.contaminated(frame, bench.limit(0)).count() == decontam.contaminated(frame.limit(0), bench).count() == 0


def test_long_items_and_common_phrases(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = " ".join(word() for _ in range(12))
    items = [f"{common} {' '.join(word() for _ in range(20))}" for _ in range(40)] + [" ".join(word() for _ in range(20_000))]
    docs = [f"{word()} {items[k]} {word()}" for k in (0, 7, 40)] + [common, items[40][: len(items[40]) // 2]]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()} == {(0, 0), (1, 7), (2, 40)}
    index = decontam.Index([(k, t.encode()) for k, t in enumerate(items)])
    # a sketch is the least hashes of an item, in the partition of its size
    least = lambda own: own[: len(own) - decontam.needed(len(own)) + 1].tolist()
    want = sorted(h for t in items for h in least(shingle_set(t.encode())))
    assert len(index.parts) == 2 and sorted(np.concatenate([part[2] for part in index.parts]).tolist()) == want


def test_clean_over_several_slices_and_clashing_names(spark, monkeypatch):
    from txloom.llm import decontam, minhash

    items = [f"one{k} two{k} three{k} four{k} five{k} six{k} seven{k}" for k in range(12)]
    docs = [(k, f"before {items[k % 12]} behind" if k % 2 else f"clean text number {k} that holds none of them", "own", b"own") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __id string, __digest binary")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(r.doc_id for r in decontam.clean(df, benchmark).collect())
    monkeypatch.setattr(decontam, "SLICE_WORDS", 20)
    parts = decontam.clean(df, benchmark)
    assert sorted(r.doc_id for r in parts.collect()) == whole == [k for k in range(60) if k % 2 == 0]
    assert parts.columns == df.columns
    kept = minhash.deduplicated(df.union(df), Workspace(spark, "clash"))
    assert kept.columns == df.columns and {(r["__id"], bytes(r["__digest"])) for r in kept.collect()} == {("own", b"own")}


def test_large_tiles_are_bounded_by_bytes(spark, monkeypatch):
    """Tiles cut by the bytes of their sets find the same groups as tiles cut by rows."""
    from txloom.llm import minhash

    rng = random.Random(11)
    common = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(60):
        words = list(common)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    figures = lambda: sorted(map(tuple, minhash.near_duplicates(df, Workspace(spark, "tiles")).collect()))
    monkeypatch.setattr(minhash, "SMALL", 1)
    want = figures()
    monkeypatch.setattr(minhash, "TILE_BYTES", 20_000)
    assert figures() == want and len({r[2] for r in want}) < 60


def test_partitions_by_size_lose_nothing():
    """Held items of all sizes are found in documents of all lengths: recall 1 against whole sets."""
    from txloom.llm import decontam
    from txloom.llm.words import shingle_set, word_hashes, words_of

    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 90, 400]))).encode()) for k in range(150)]
    index = decontam.Index(items)
    assert len(index.parts) > 6
    for _ in range(200):
        words = rng.choices(vocabulary, k=rng.choice([1, 4, 30, 300]))
        for _ in range(rng.randrange(4)):
            held = rng.choice(items)[1].decode().split()
            words[rng.randrange(len(words)) : 0] = held[: max(1, len(held) - rng.randrange(3))]
        text = " ".join(words).encode()
        want = set()
        for k, item in items:
            n, width = len(shingle_set(item)), min(5, len(words_of(item)))
            shared = len(set(shingle_set(item).tolist()) & set(shingle_set(text, width).tolist())) if len(words) >= width else 0
            if n and shared >= decontam.needed(n):
                want.add((k, n, shared))
        assert set(index.held(word_hashes(words_of(text)))) == want
