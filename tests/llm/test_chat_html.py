"""Chat windows, page text and the pipeline."""

import collections
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from txloom.llm import chat, decontam, html_extract, minhash, quality, toxicity
from txloom.llm.encode import default_tokenizer, encoder
from txloom.llm.words import shingle_set
from txloom.llm.workspace import Workspace

piece = st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "<", ">", "s>", "[", "INST]", "\n", " ", "ok"]), st.text(max_size=3))
turn = st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), piece), st.lists(piece, max_size=6).map("".join))


@given(st.lists(turn, max_size=5))
@settings(max_examples=400, deadline=None)
def test_template_is_reversible(turns):
    window = "".join(chat.framed(*t)[0] for t in turns)
    parsed = chat.parse(window)
    assert [(r, t) for r, t, _, _ in parsed] == turns
    assert [chat.unescape(window[a:b]) for _, _, a, b in parsed] == [t for _, t in turns]


def check_windows(windows, budget=chat.BUDGET):
    """The tokens of whole windows, by the tokenizer itself, are those of the sums and within the budget."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    for r in windows.collect():
        turns = chat.parse(r.text)
        assert len(whole.encode(r.text, add_special_tokens=False).ids) == r.n_tokens
        assert r.n_tokens <= budget or len(turns) - r.n_repeated == 1
        if r.n_tokens > budget:
            assert r.n_repeated <= 1


escaped = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x" * 30]), st.lists(st.sampled_from(["</s>", "\\", "\\\\", "[INST]", "word ", "ÀÉ", "\n", "12 ", "don't", "<|endoftext|>"]), max_size=30).map("".join))


@given(st.lists(st.tuples(st.integers(0, 3), escaped), min_size=1, max_size=40), st.sampled_from([40, 90, 200]))
@settings(max_examples=6, deadline=None)
def test_windows_hold_the_budget(spark, rows, budget):
    turns = spark.createDataFrame([(conv, n, role, text) for n, (conv, (role, text)) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns, default_tokenizer(), Workspace(spark, "t7c"), budget, budget // 4).persist()
    check_windows(windows, budget)
    read = {}
    for r in sorted(windows.collect(), key=lambda r: r.window):
        new = chat.parse(r.text)[r.n_repeated :]
        read.setdefault(r.conv_id, []).extend((role, text) for role, text, _, _ in new)
        loss = [chat.unescape(r.text[a:b]) for a, b in zip(r.loss_begin, r.loss_end, strict=True)]
        assert loss == [text for role, text, _, _ in new if role == "assistant"]
    want = {}
    for conv, turn in rows:
        want.setdefault(conv, []).append(turn)
    assert read == want
    windows.unpersist()


def test_one_conversation_in_many_partitions(spark):
    rows = [(5, k, "system" if k == 0 else "user" if k % 2 else "assistant", f"turn {k} " + "w " * (k % 40)) for k in range(900)] + [(k, 0, "system", f"only {k}") for k in (1, 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns.repartition(7), default_tokenizer(), Workspace(spark, "t7d"))
    check_windows(windows)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert got[5].n_turns == 900 and got[1].n_turns == got[9].n_turns == 1 and got[5].n_windows > 10
    assert got[5].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 5).encode()).hexdigest()
    for r in windows.where("conv_id = 5").collect():
        assert chat.parse(r.text)[0][:2] == ("system", "turn 0 ")


def test_windows(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "word " * (k * 37 % 300)) for k in range(40)]
    rows += [(2, 0, "system", "be kind"), *((2, k, "assistant" if k % 2 == 0 else "user", "</s>" * (k * 20)) for k in range(1, 30))]
    rows += [(3, 0, "user", None), (3, None, None, "first"), (None, 1, "user", "no conversation"), (4, 0, "assistant", "x " * 5000), (4, 0, "assistant", "x " * 5000)]
    turns = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(turns, default_tokenizer(), Workspace(spark, "t7"))
    groups = collections.defaultdict(list)
    for conv, n, role, text in rows:
        groups[conv].append((n is not None, n or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert set(got) == set(groups)
    for conv, own in groups.items():
        own.sort()
        loss = "".join(t for *_, role, t in own if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for *_, a, t in own)), len(loss), sha(loss))
    written = sorted((r for r in windows.collect() if r.conv_id == 2), key=lambda r: r.window)
    assert len(written) > 1
    for r in written:
        assert chat.parse(r.text)[0][1] == "be kind"
        assert r.n_tokens <= chat.BUDGET or len(chat.parse(r.text)) == 2
    check_windows(windows)
    assert any(r.n_repeated > 1 for r in windows.collect())
    assert chat.digests(chat.format_windows(turns.limit(0), default_tokenizer(), Workspace(spark, "t7b"))).count() == 0


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=200, deadline=None)
def test_common_is_longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    found = html_extract.common(a, b)
    rest = iter(b)
    assert len(found) == table[-1][-1] and found == sorted(found) and all(a[i] in rest for i in found)


def test_nearest_by_brute_force(spark):
    import os.path

    rng = __import__("random").Random(4)
    pages = sorted({(f"h{rng.randrange(6)}", "/" + "/".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 4)))) for _ in range(90)})
    keys = [(h, p, f"{n:03}") for n, (h, p) in enumerate(pages)] + [("h7", "/x" * 20_000, "long"), ("h7", "/x" * 19_999 + "/y", "longer")]
    got = {r.key: r.other for r in html_extract.nearest(spark.createDataFrame(keys, "host string, path string, key string"), Workspace(spark, "t10c")).collect()}
    keys.sort()
    for n, (host, path, key) in enumerate(keys):
        best, want = -1, None
        for m in (n - 1, n + 1):
            if 0 <= m < len(keys) and keys[m][0] == host and len(os.path.commonprefix([path, keys[m][1]])) > best:
                best, want = len(os.path.commonprefix([path, keys[m][1]])), keys[m][2]
        assert got[key] == want


def test_differencing_decides_beside_an_article(spark):
    page = "<div>Site name</div><div>Posted in {0}</div><article><p>story {0}</p><p>refrain</p></article><p>epilogue {0}</p><div>All rights</div>"
    rows = [(k, f"http://one.example/{k}", page.format(k)) for k in range(4)] + [(9, "http://alone.example/", page.format(9))]
    rows += [(20 + k, f"http://copy.example/{k}", page.format("copied")) for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), Workspace(spark, "t10d")).collect()}
    assert [got[k] for k in range(4)] == [f"Posted in {k} story {k} refrain epilogue {k}" for k in range(4)]
    assert got[9] == "story 9 refrain"  # nothing to compare with
    assert got[20] == got[21] == "story copied refrain"
    lines = html_extract.blocks(page.format(0))
    assert html_extract.main_text(lines, [], True) != got[0]  # without the shared lines, the template stays


PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p><article>no</article>'</script></head><body><nav>menu <a>x</a></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1><p>one<b>two</b> three\n four<br>five<p>six&nbsp;&eacute;<div class='ad'>buy <div>now</div></div><section id=comments><p>silly</p></section></article><footer>f</footer>", "A & B onetwo three four five six é"),
    ("<main><p class=\"x-notice\">cookies<p>text<form><p>in</form>tail</main> outside", "text tail"),
    (None, ""),
    ("", ""),
    ("plain text < 3 &lt;b&gt;", "plain text < 3 <b>"),
    ("<p>open <b attr='x>y'>bold", "open bold"),
    ("<script>never closed <p>x</p>", ""),
]


def test_pages(spark):
    rows = [(k, f"http://h{k}.example/a", h, "t") for k, (h, _) in enumerate(PAGES)]
    body = "<div>Site name</div><div>Menu A</div><p>{}</p><div>All rights</div>"
    rows += [(100 + k, f"https://same.example/en/{10 + k}?q=1", body.format(f"story {k}"), "t") for k in range(6)]
    rows += [(200 + k, f"https://copy.example/{k}", "<p>one</p><p>two</p>", "t") for k in range(2)]
    rows += [(300, None, "<p>no address</p>", "t"), (None, "::", None, "t"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, Workspace(spark, "t10")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for k, (_, want) in enumerate(PAGES):
        assert by_id[k].text == want
    assert [by_id[100 + k].text for k in range(6)] == [f"story {k}" for k in range(6)]
    assert by_id[200].text == by_id[201].text == "one two"
    assert by_id[300].text == "no address" and by_id[None].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.limit(0), Workspace(spark, "t10b")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    ws = Workspace(spark, "tp")
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return [*out, docs]


def test_pipeline(spark, sf_dir, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    counts = [d.count() for d in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    near = minhash.near_duplicates(stages[2], Workspace(spark, "tp9"))
    assert stages[3].join(near.where("not kept"), "doc_id").count() == 0
    assert stages[3].count() == near.where("kept").count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontam.contaminated(stages[3], bench).select("doc_id").distinct()
    assert leaks.count() and stages[4].count() == stages[3].count() - leaks.count()
    assert stages[5].select("doc_id").distinct().count() == stages[4].count()
    again = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(again.select(*key).collect()) == sorted(stages[5].select(*key).collect())


def test_pipeline_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    more = spark.createDataFrame([(1, None, "en", "s", 0), (1, "", "en", "s", 0), (None, None, None, None, None), (None, "word " * 30_000, "en", "s", 1)], docs.schema)
    odd = docs.unionByName(docs.where("doc_id < 5")).unionByName(more).withColumns({"label": F.lit("x"), "score": F.lit(1), "component_id": F.lit(2), "digest": F.lit("d"), "fp": F.lit("f")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        assert out.exceptAll(odd).isEmpty(), name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
    pieces = corpus_pipeline.pack(spark, odd, sf_dir)
    assert pieces.where("piece = 0").count() == odd.count()
    assert corpus_pipeline.pack(spark, odd.limit(0), sf_dir).count() == 0


def test_stages_by_brute_force(spark, sf_dir, stages):
    """Each stage's rows, from scores, links and shingles that are worked out row by row here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [d.select("doc_id", "text").collect() for d in stages[:-1]]
    model = toxicity.fit(stages[0], labels)
    table = toxicity.WordScores(model.scores)
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if toxicity.score_of(model, (r.text or "").encode(), table) < toxicity.THRESHOLD}
    model = quality.fit(stages[1], labels)
    good = model.probabilities(quality.pooled(model.table, [(r.text or "").encode() for r in rows[1]]).astype("<f4").astype(float)) >= quality.THRESHOLD
    assert {r.doc_id for r in rows[2]} == {r.doc_id for r, ok in zip(rows[1], good, strict=True) if ok}
    sets = {r.doc_id: set(shingle_set((r.text or "").encode()).tolist()) for r in rows[2]}
    groups = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for k in groups[b]:
                    groups[k] = groups[a]
    assert {r.doc_id for r in rows[3]} == {min(g) for g in groups.values()}
    items = [set(shingle_set((r.text or "").encode()).tolist()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3] if not any(i and len(i & sets[r.doc_id]) >= decontam.needed(len(i)) for i in items)}
    whole = {r.doc_id: encoder(default_tokenizer()).ids((r.text or "").encode()) + bytes(4) for r in rows[4]}
    for r in stages[5].collect():
        assert zlib.crc32(whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p class="x"">Hello</p><p>World</p></article>', "Hello World"),
        ("<article><p data-x=it's>Hello</p><p>World's end</p></article>", "Hello World's end"),
        ("<nav><ul><li>a</ul><article><p>Body</p></article>", "Body"),
        ('<div class="ad">buy<article><p>Body</p></article><p>after', "Body"),
        ("<aside><article>related</article></aside><main><p>Body</p></main>", "Body"),
        ('<article><div class="social-science">One</div><section id="comments-policy-study">two</section><h1 class="header">three</h1></article>', "One two three"),
        ('<article>Body<div class="ad-slot-2">x</div><ul class="share-buttons"><li>y</ul><div id="site_header">z</div></article>', "Body"),
        ('<article>Body</article><section id="comments"><article>first!</article></section>', "Body"),
        ('<article class = "a>b" title=\'c>d\'>Body <a href="?a=1&b=\'2\'">link</a></article>', "Body link"),
    ],
)
def test_markup_as_it_comes(page, text):
    assert html_extract.main_text(html_extract.blocks(page), [], False) == text


def test_alignment_in_halves(monkeypatch):
    """Halving finds as long a common subsequence, and it is one; equal ends and strange lines cost nothing."""
    rng = random.Random(9)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for bits in (1, 30, 1 << 23):
        monkeypatch.setattr(html_extract, "BITS", bits)
        for _ in range(150):
            a, b = ([rng.randrange(9) for _ in range(rng.randrange(25))] for _ in range(2))
            got = html_extract.common(a, b)
            rest = iter(b)
            assert got == sorted(set(got)) and all(a[k] in rest for k in got) and len(got) == longest(a, b)


def test_many_lines_take_little_memory():
    import tracemalloc

    rng = random.Random(2)
    a, b = ([rng.randrange(20_000) for _ in range(30_000)] for _ in range(2))
    tracemalloc.start()
    got = html_extract.common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rest = iter(b)
    assert all(a[k] in rest for k in got) and len(got) > 100 and peak < 150_000_000
