"""Mixing, embeddings, pages, conversations, archives and BPE: small cases and brute force."""
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest


def test_targets_by_water_filling():
    from revspark.llm.op2_mixing import source_targets
    t = source_targets([10, 1000, 1000], [3, 1, 2], 1.5, 2.0)
    assert t[0] == 20 and abs(sum(t) - 1.5 * 2010) < 1e-6 and abs(t[2] / t[1] - 2) < 1e-9
    assert source_targets([0, 0], [3, 1, 2], 1.5, 2.0) == [0.0, 0.0]


def test_pivotal_keeps_mass():
    from revspark.llm.op2_mixing import pivotal
    rng = np.random.default_rng(0)
    w = sorted(rng.integers(1, 500, 300).tolist(), reverse=True)
    means = np.zeros(300)
    for _ in range(200):
        x = [0.3] * 300
        left = pivotal(w, x, rng)
        assert abs(np.dot(w, x) - 0.3 * sum(w)) < 1e-6 * sum(w)
        assert all(v in (0.0, 1.0) for i, v in enumerate(x) if i != left)
        means += x
    assert abs(means / 200 - 0.3).max() < 0.2


def test_mixing(spark, stage):
    from revspark.llm.op2_mixing import mix_sources, take_copies
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["a", "b", "c", None][i % 4], "x") for i in range(800)]
    rows += [(9000, None, "a", "x"), (9001, "", None, "x"), (None, "one two", "b", "x"), (5, rows[5][1], "b", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    a = mix_sources(d, stage).collect()
    assert sorted(map(str, a)) == sorted(map(str, mix_sources(d, stage).collect()))
    words = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size, r.source) for r in a) == Counter((i, words(t), s) for i, t, s, _ in rows)
    taken = defaultdict(int)
    for r in a:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for r in a:
        assert abs(taken[r.source] - r.target) <= 60
    out = take_copies(d, mix_sources(d, stage), stage)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in a if r.copies > 0)
    # what is taken: as often as decided, with all columns as they were
    want = Counter()
    for r in a:
        want[(r.doc_id, r.source, r.size)] += r.copies
    got = Counter((r.doc_id, r.source, words(r.text)) for r in out.collect())
    assert got == Counter({k: v for k, v in want.items() if v}) and {r.size for r in out.collect()} == {"x"}
    assert mix_sources(d.limit(0), stage).count() == 0


def test_copies_of_repeated_rows(spark, stage):
    """Rows that agree in id, source and size get numbers of copies that add up; columns of any name come back."""
    from pyspark.sql import functions as F

    from revspark.llm.op2_mixing import mix_sources, take_copies
    rows = [(7, f"same {i % 3}", "a", i, i, "c") for i in range(60)] + [(i, "w " * (i % 9), "b", i, i, "c") for i in range(100, 140)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, _k1 long, copies string")
    mixed = stage.save(mix_sources(d, stage, factor=0.7), "mixed")
    out = take_copies(d, mixed, stage).collect()
    assert sum(1 for r in out if r.doc_id == 7) == mixed.filter("doc_id = 7").agg(F.sum("copies")).first()[0] > 0
    assert {tuple(r) for r in out} <= set(rows) and len(out) == mixed.agg(F.sum("copies")).first()[0]


def test_sources_come_near_their_targets(spark, stage):
    """Within the size of the source's median document, on the given documents."""
    from revspark.llm.op2_mixing import mix_sources
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = defaultdict(list)
    for r in mix_sources(d, stage).collect():
        by[r.source].append(r)
    for rows in by.values():
        gap = abs(sum(r.taken for r in rows) - rows[0].target)
        assert gap <= sorted(r.size for r in rows)[len(rows) // 2], (rows[0].source, gap)


def test_mixing_of_blocks_longer_than_a_task_takes(spark, stage, monkeypatch):
    import revspark.llm.op2_mixing as m
    monkeypatch.setattr(m, "MOST", 40)
    d = spark.createDataFrame([(1, "a b c", "s")] * 300 + [(2, "d e", "t")] * 10, "doc_id long, text string, source string")
    rows = m.mix_sources(d, stage).collect()
    assert len(rows) == 310
    for s in "st":
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 24


def test_caps_against_brute_force(spark, stage):
    from revspark.llm.op1_caps import cap_links
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 32)).astype(np.float32)
    for k in range(60):
        x[100 + k] = x[k % 7] + 0.15 * rng.standard_normal(32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i + 1000, x[0].tolist()) for i in range(40)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] * 32), (2005, [float("inf")] * 32), (2006, [1.0, 2.0])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as node")
    got = {r.vec_id: r for r in cap_links(d, stage).collect()}
    m = np.array([v for _, v in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in rows])
    assert sum(got[i].n_links for i in ids) >= 0.98 * link.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, link.sum(axis=1)))
    assert got[1000].component_id == 0 and not got[1000].kept and got[1000].n_links >= 40
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert cap_links(d.limit(0), stage).count() == 0


def test_cap_links_of_any_length(spark, stage):
    from revspark.llm.op1_caps import cap_links
    x = np.random.default_rng(8).standard_normal(16)
    rows = [(i, (x * f).tolist()) for i, f in enumerate([1.0, 1e200, 1e-200, 5e300])] + [(9, (-x).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), stage).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 9: (0, 9)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home with-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, all of them, always.</div>
<div id="content"><h1>Head &amp; line</h1><p>First  <b>bold</b>
text with words.<br>And more &lt;words&gt; here.<p>Second para, long enough to be one.</p><script>var x="</p>";</script>
<div class="ad">Buy now</div><form><input>Sign up</form></div>
<section id="comments"><p>Great article, I liked reading it very much, thanks a lot for this.</p></section>
<aside>Related things</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    from revspark.llm.op4_html import main_text
    assert main_text(PAGE) == "Head & line\n\nFirst bold text with words. And more <words> here.\n\nSecond para, long enough to be one."
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<!-- only") == ""
    assert main_text("plain &am") == "plain &am"
    assert main_text("<p>a<p>b<") in ("a\n\nb<", "a\n\nb")
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>cut <a href='x") == "cut"


def test_main_text_around_icons_and_formulas():
    from revspark.llm.op4_html import main_text
    page = lambda x: main_text(f"<body><article><p>One {x} two.</p><p>Three.</p></article></body>")
    for icon in ('<svg class="i"/>', "<math/>", "<svg><title>t</title><svg><text>a</text></svg><text>b</text></svg>",
                 "<svg-icon></svg-icon>", "<object-card></object-card>", "<title-bar></title-bar>", "<select-box></select-box>"):
        assert page(icon).split() == ["One", "two.", "Three."], icon
    assert page("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>").split() == ["One", "x=2", "two.", "Three."]
    assert page("<object data=a><b>shown</b></object>").split() == ["One", "shown", "two.", "Three."]
    assert page("<script>a</script x>").split() == ["One", "two.", "Three."]
    assert main_text("<article><svg><path d=a><p>Left open.</p><p>Next.</p></article>").split() == ["Left", "open.", "Next."]


def test_main_text_and_names_inside_the_article():
    from revspark.llm.op4_html import main_text
    para = "<p>A paragraph of the article, long enough to be one and to say something.</p>"
    words = lambda n: [f"w{n}{i}" for i in range(30)]
    long = lambda n: f"<p>{' '.join(words(n))}</p>"
    parts = [f'<section id="side-effects">{long(1)}</section>', f'<section id="discussion"><h2>Talk</h2>{long(2)}</section>',
             '<h2 id="Social_structure">Social</h2>', '<p class="notice-period">Three months.</p>', '<p class="notice">Mind this.</p>',
             '<p>See <a href="/hidden-gems" title="a hidden place">gems</a>.</p>', f'<div data-hidden="false" data-id="ad-12">{long(3)}</div>']
    text = main_text(f"<body><main><article>{para * 3}{''.join(parts)}</article></main></body>").split()
    for want in [*words(1), *words(2), "Talk", "Social", "months.", "Mind", "gems.", *words(3)]:
        assert want in text, want
    # boilerplate by name and by links or density
    for part in ('<div class="ad">Buy now</div>', '<ul class="related-list"><li><a href=x>Another long headline of another page</a></li></ul>',
                 '<div hidden>unseen</div>', '<div class=x style="color:red; display : none">unseen</div>', "<p aria-hidden=true>unseen</p>"):
        assert main_text(f"<article>{para}{part}{para}</article>") == main_text(f"<article>{para * 2}</article>"), part


def test_main_text_without_article_and_with_several():
    from revspark.llm.op4_html import main_text
    long = "".join(f"<p>{f'word{i} ' * 30}</p>" for i in range(10))
    got = lambda x: main_text(x).split("\n\n")
    core = [" ".join([f"word{i}"] * 30) for i in range(10)]
    assert got(f"<body><h1>A headline of some thirty chars</h1><div>{long}</div></body>") == ["A headline of some thirty chars", *core]
    assert got(f"<body><div><h1><a href=x>Head</a></h1></div><p>Short.</p><div>{long}</div><p>End.</p></body>") == ["Head", "Short.", *core, "End."]
    assert got(f"<body>Bare <b>text</b> here.<div>{long}</div>more</body>") == ["Bare text here.", *core, "more"]
    assert got(f"<body><a href=a>Home</a> | <a href=b>News</a><div>{long}</div><h3>Read on</h3><ul><li><a href=c>x</a></li></ul></body>") == core
    # articles
    two = f"<article><h2>One</h2>{long}</article><article><h2>Two</h2><p>Short part.</p></article>"
    assert got(f"<body><div>{two}</div></body>") == ["One", *core, "Two", "Short part."]
    assert got(f"<body><main><h1>Head</h1>{two}<article><a href=x>Another page</a></article></main></body>") == ["Head", "One", *core, "Two", "Short part."]
    assert got(f"<body><div><div><article>{long}</article></div><div><article><p>Part.</p></article></div></div></body>") == [*core, "Part."]
    assert got(f"<body><h1>Head</h1><article>{long}</article><div>beside</div></body>") == ["Head", *core]


def test_main_text_drops_comments_inside_the_article():
    from revspark.llm.op4_html import main_text
    long = "".join(f"<p>{f'word{i} ' * 30}</p>" for i in range(6))
    talk = "".join(f"<p>{f'Reader {i} writes a long reply with many words in it. ' * 4}</p>" for i in range(10))
    plain = main_text(f"<body><article>{long}</article></body>")
    for box in ('<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div id="disqus_thread">', '<div id="respond">',
                '<div class="comment-list wide">', '<div class="newsletter-box">', '<div class="cookie-notice">', '<div class="advert">'):
        close = f"</{box[1:].split()[0]}>"
        assert main_text(f"<body><article>{long}{box}{talk}{close}</article></body>") == plain, box
    assert "Reader" in main_text(f'<body><article>{long}<div class="comments-on-the-law">{talk}</div></article></body>')


def test_main_text_of_deep_and_long_pages():
    import time

    from revspark.llm.op4_html import main_text
    t = time.time()
    assert main_text("<div class=a>" * 100_000 + "deep") == "deep"
    assert main_text("<span>" * 20_000 + "<p>x</p>" * 20_000).count("x") == 20_000
    assert main_text("<b>" * 20_000 + "</i>" * 20_000 + "x") == "x"
    assert time.time() - t < 10
    long = "<article>" + "".join(f"<p>{f'w{i} ' * 20}</p>" for i in range(5000)) + "</article>"
    assert len(main_text(long).split("\n\n")) == 5000


def test_all_pages_against_a_plain_reader():
    """The given pages: an independent parser that knows their article element."""
    import html.parser

    import duckdb

    from revspark.llm.op4_html import BLOCK, main_text

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.depth = [[]], 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in BLOCK:
                self.blocks.append([])
            if tag == "br":
                self.blocks[-1].append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag in BLOCK:
                self.blocks.append([])

        def handle_data(self, data):
            if self.depth:
                self.blocks[-1].append(data)
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(pages) == 250
    for (page,) in pages:
        r = Reader()
        r.feed(page or "")
        r.close()
        want = "\n\n".join(x for x in (" ".join("".join(b).split()) for b in r.blocks) if x)
        assert main_text(page) == want


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
def test_caps_recall_at_any_size(n):
    """Partners at cosine 0.951 meet on a filter of the codes that ``n`` vectors get; memory doesn't grow with them."""
    from revspark.llm.op1_caps import PARTS, SUMS, Caps
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    caps = Caps(64, n)
    caps.fit(unit(rng.standard_normal((600, 64))))
    x, y = unit(rng.standard_normal((400, 64))), rng.standard_normal((400, 64))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    assert caps.hit_rate(x, 0.951 * x + np.sqrt(1 - 0.951 ** 2) * y) >= 0.98
    assert caps.step() * caps.t ** (PARTS // 2) <= SUMS and np.mean([len(f) for f in caps.decode(x)]) < 200


def test_caps_find_planted_pairs(spark, stage):
    """1,000 pairs just above the threshold among 4,000 vectors, against all cosines."""
    from revspark.llm.op1_caps import cap_links
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((4000, 64)))
    y = rng.standard_normal((1000, 64))
    y = unit(y - (y * x[:1000]).sum(axis=1, keepdims=True) * x[:1000])
    c = rng.uniform(0.9505, 0.954, (1000, 1))
    x[3000:] = c * x[:1000] + np.sqrt(1 - c * c) * y
    x = x.astype(np.float32).astype(float)
    want = (unit(x) @ unit(x).T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in cap_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), stage).collect()}
    assert all(got[i] <= want[i] for i in range(4000)) and sum(got.values()) >= 0.985 * want.sum() > 1900


def test_pages_keep_rows(spark):
    from revspark.llm.op4_html import extract
    d = spark.createDataFrame([(1, None, None, 3), (1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, "u", "", 3)],
                              "page_id long, url string, html string, text long")
    got = extract(d).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)


def test_chat_events_fold(spark):
    from revspark.llm.op6_chat import as_events, fold_events, parse, render
    log = [(1, 1, "message", 1, "user", "hel"), (1, 2, "delta", 1, "user", "lo"), (1, 3, "message", 2, "assistant", None),
           (1, 4, "delta", 2, "assistant", "bad"), (1, 5, "regenerate", 2, "assistant", None), (1, 6, "delta", 2, "assistant", "go"),
           (1, 7, "delta", 2, "assistant", "od <|end|>\n&lt;[INST]"), (1, 8, "edit", 1, "user", "bye|>\n</s>"), (2, 1, "message", 1, None, None)]
    e = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = {r.conv_id: r for r in render(fold_events(e)).withColumn("read", parse(__import__("pyspark").sql.functions.col("formatted"))).collect()}
    assert [tuple(x) for x in got[1].read] == [("user", "bye|>\n</s>"), ("assistant", "good <|end|>\n&lt;[INST]")]
    assert [tuple(x) for x in got[2].read] == [("", "")]
    assert "</s>" not in got[1].formatted and "[INST]" not in got[1].formatted
    at = 0
    spans = []
    for m in got[1].loss_mask:
        spans.append((got[1].formatted[at + m.markup:at + m.markup + m.length], m.loss))
        at += m.markup + m.length + len("<|end|>\n")
    assert at == len(got[1].formatted) and [x for x, loss in spans if loss] == ["good &lt;|end|>\n&amp;lt;&#91;INST]"]
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None)],
                                 "conv_id long, turn long, role string, text string")
    done = render(fold_events(as_events(rows))).collect()
    assert len(done) == 1 and len(done[0].loss_mask) == 3


def test_warc_round_trip(spark, stage):
    from revspark.llm.op9_warc import assemble, plan_captures, read_warc, write_warc
    big = "é" * 600
    rows = [(1, "http://a", big, 0), (2, "http://b", big, 0), (3, "http://c", "small", 0), (4, "http://d", "small", 0),
            (5, None, None, 0), (6, "u", "tricky\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", 0), (7, "r", "x", 0), (7, "r", "x", 0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 long")
    path = stage.path("warc-test")
    write_warc(plan_captures(d, stage), path)
    got = assemble(read_warc(spark, path)).collect()
    assert len(got) == 8 and all(r.request and r.metadata for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.response.record_id.split(":")[2]].append(r.response)
    assert by["1"][0].type == "revisit" and "capture:2:" in by["1"][0].refers_to and by["2"][0].type == "response"
    assert by["2"][0].payload == big and by["2"][0].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert by["1"][0].payload_bytes == 1200 and by["5"][0].payload_bytes == 0 and by["6"][0].payload == rows[5][2]
    assert {x.type for k in "3457" for x in by[k]} == {"response"} and len(by["7"]) == 2


def test_warc_of_large_payloads(spark, stage, monkeypatch):
    """Payloads above ``LARGE`` go to files of a few captures; both kinds come back whole, as streams."""
    import revspark.llm.op9_warc as m
    monkeypatch.setattr(m, "LARGE", 2000)
    monkeypatch.setattr(m, "FILE_BYTES", 12_000)
    rng, same = np.random.default_rng(2), "x" * 3000
    rows = [(i, f"http://{i}", "".join(rng.choice(list("ab\r\n<é"), int(rng.integers(0, 5000))))) for i in range(60)]
    rows += [(99, "http://99", same), (98, "u", same)]
    path = stage.path("warc-large")
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    m.write_warc(m.plan_captures(d, stage), path)
    got = {r.response.record_id.split(":")[2]: r.response for r in m.assemble(m.read_warc(spark, path)).collect()}
    assert len(got) == 62 and all(got[str(i)].payload == h for i, _, h in rows if i != 98) and got["98"].type == "revisit"
    files = [len(list(m.records(m._opened(pa.py_buffer(f.read_bytes()))))) for f in Path(path, "large").glob("part-*")]
    assert len(files) > 5 and max(files) <= 3 * (12_000 // 2000)


def test_bpe_equals_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from revspark.llm.op10_bpe import Bpe, decode, encode, model_bytes
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rng = np.random.default_rng(1)
    pool = [chr(c) for r in (range(0, 0x250), range(0x370, 0x500), range(0x2000, 0x2100), range(0x3040, 0x3060)) for c in r]
    pool += ["the ", "don't ", "I'LL ", "<|endoftext|>", "<|startoftext|>", "  ", "\U0001f600", "Ᲊ", "Ɤ", "é", "Σ"]
    texts = ["", "  ", "a" * 5000, "Hello, World's 123 thing!"] + ["".join(rng.choice(pool, 30)) for _ in range(400)]
    b = Bpe(model_bytes())
    ids = b.encode_batch(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want
    assert [b.decode(i) for i in ids] == [t.decode(i, skip_special_tokens=False) for i in want]
    d = spark.createDataFrame([(1, None, 2), (2, "x y", 2), (2, "x y", 2)], "doc_id long, text string, ids long")
    coded = encode(d, model_bytes())
    assert [len(r.ids) for r in coded.orderBy("doc_id").collect()][0] == 0
    assert {r.decoded for r in decode(coded, model_bytes()).collect()} == {"", "x</w> y</w>"}


def test_bpe_long_words():
    """Merged by a heap, as by the plain rule; a word of 200,000 letters in seconds."""
    import time
    pytest.importorskip("public_tokenizers")
    from revspark.llm import op10_bpe as m
    b = m.Bpe(m.model_bytes())
    rng = np.random.default_rng(5)
    for n in (2, 3, 50, 400, 3000):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aaab", "thequickbrown"):
            word = "".join(rng.choice(list(letters), n))
            plain = b.symbols(word)
            while True:                                       # the rule itself: leftmost pair of lowest rank
                ranks = [b.rank.get(p, b.none) for p in zip(plain, plain[1:])]
                if not ranks or min(ranks) == b.none:
                    break
                i = ranks.index(min(ranks))
                plain[i:i + 2] = [plain[i] + plain[i + 1]]
            assert b.merge_long(b.symbols(word)) == plain, (n, letters)
    t = time.time()
    b.exact("".join(rng.choice(list("etaoinshrdlu"), 200_000)))
    assert time.time() - t < 20


def test_fit_samples_hold_a_text_an_id(spark, stage):
    """An id that repeats a thousand times comes once to the fit."""
    from revspark.llm.common import one_text_each
    d = spark.createDataFrame([(1, f"text {i % 7}", "x") for i in range(1000)] + [(2, None, "x"), (3, "other", "x")], "doc_id long, text string, grade string")
    pick = spark.createDataFrame([(1, 0), (2, None), (1, 0)], "doc_id long, quality int")
    got = one_text_each(d, pick, ["quality"]).collect()
    assert sorted((r.doc_id, r.quality) for r in got) == [(1, 0), (2, None)] and all(r.text is None or r.text.startswith("text") for r in got)


def test_held_out_accuracy(spark):
    """Labels of sf0.1 that the fit doesn't see: toxic texts found, others left alone; grades in order."""
    from pyspark.sql import functions as F

    from revspark.llm import op3_ordinal, op8_toxicity
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op8_toxicity.op8_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 100 and sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * (len(rows) - len(toxic))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = op3_ordinal.train(docs, labels.filter(~third))
    graded = op3_ordinal.grade_texts(docs, model).join(labels.filter(third), "doc_id").collect()
    pairs = sorted((r.expected_grade, r.quality) for r in graded)
    rank = np.array([i for i, (_, q) in enumerate(pairs) if q == 1])
    n1, n0 = len(rank), len(pairs) - len(rank)
    assert (rank.sum() - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.8         # share of pairs in the right order (measured: 0.845)


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage of the pipeline on its own input, with nulls, repeats and clashing columns, against its plain version."""
    import corpus_pipeline as c
    from test_classes import brute_components

    from revspark.llm import op7_quality, op8_toxicity
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (90001, "", "en", "s", 0)], base.schema)
    docs = base.unionByName(extra).unionByName(base.filter("doc_id < 4")).selectExpr("*", "'n' AS node")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = lambda df: Counter(map(tuple, df.select(*docs.columns).collect()))
    step = dict(c.STAGES)

    one = step["toxicity"](spark, docs, sf)
    scores = {r.doc_id: r.score for r in op8_toxicity.score(docs, op8_toxicity.train(docs, labels)).collect()}
    assert rows(one) == Counter({k: n for k, n in rows(docs).items() if scores[k[0]] < 0.7})
    two = step["quality rules"](spark, one, sf)
    kept = {r.doc_id for r in op7_quality.judge(one, op7_quality.train(one, labels)).collect() if r.kept}
    assert rows(two) == Counter({k: n for k, n in rows(one).items() if k[0] in kept}) and 0 < two.count() < docs.count()
    three = step["n-gram Jaccard join"](spark, two, sf)
    some = [(r.doc_id, r.text) for r in two.collect()]
    worded = {k[2] for k in brute_components(some) if k[1]}
    assert sorted(r.doc_id for r in three.collect()) == sorted(worded)
    four = step["mixing sources"](spark, three, sf).cache()
    assert four.columns == docs.columns and set(rows(four)) <= set(rows(three)) and max(rows(four).values()) <= 2
    five = step["BPE ids"](spark, four, sf).collect()
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want = Counter((r.doc_id, r.source, tuple(t.encode(r.text or "", add_special_tokens=False).ids)) for r in four.collect())
    assert Counter((r.doc_id, r.source, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in five) == want
    for _, f in c.STAGES:                                             # no documents
        assert f(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    out = c.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert 0 < out.count() and out.join(docs, "doc_id", "left_anti").count() == 0
    assert out.groupBy("doc_id").count().filter("count > 2").count() == 0
