"""Small cases (nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns) and
brute-force versions of the operators on texts."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    return Counter((d, len(s), least.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label))


def corpus(seed=5, groups=6, per=9):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for g in range(groups):
        base = list(rng.choice(words, int(rng.integers(40, 160))))
        for _ in range(per):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            rows.append((n, " ".join(t)))
            n += 1
    return rows


EDGE = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two three four five"),
        (905, "one two three four five"), (None, "one two three four five"), (None, "lonely words without any id here"),
        (906, "x y z"), (907, "big " * 30_000 + "end")]


def test_jaccard_brute_force(docs_of, stage):
    from revspark.llm.op5_jaccard import jaccard_components, one_of_each
    rows = corpus() + EDGE
    d = docs_of(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d, stage).collect())
    want = brute_components(rows)
    assert got == want
    kept = one_of_each(d, stage)
    assert kept.columns == d.columns
    blank = sum(not shingles(t) for _, t in rows)
    assert kept.count() == blank + len({k[2] for k in want if k[1] and k[2] is not None}) + 1     # and the group without id


def test_jaccard_blocks_smaller_than_groups(docs_of, stage, monkeypatch):
    import revspark.llm.op5_jaccard as m
    monkeypatch.setattr(m, "BLOCK", 3)
    rows = corpus(seed=8, groups=3, per=14)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in m.jaccard_components(docs_of(rows), stage).collect()) == brute_components(rows)


def near_copies(n=160, seed=2):
    """One group whose members are alike, most pairs just below the threshold, some above."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        t = list(base)
        for j in rng.choice(120, int(rng.integers(1, 4)), replace=False):
            t[int(j)] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block,few,dense", [(256, 2, 2000), (16, 0, 5), (16, 2, 10**9)])
def test_jaccard_of_one_large_group_of_near_copies(docs_of, stage, monkeypatch, block, few, dense):
    import revspark.llm.op5_jaccard as m
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "FEW", few)
    monkeypatch.setattr(m, "DENSE", dense)
    rows = near_copies()
    want = brute_components(rows)
    assert 1 < len({k[2] for k in want}) < 160
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in m.jaccard_components(docs_of(rows), stage).collect()) == want


def test_blocks_put_out_fewer_links_than_sets():
    """However many pairs the trees leave: none where none links, a chain at most where all do."""
    import revspark.llm.op5_jaccard as m
    from revspark.llm.kernel import Words, shingle_sets

    def links(texts):
        sets = shingle_sets(Words(pa.array(texts)), 5)
        n = len(sets)
        b = pa.RecordBatch.from_pydict({"key": [1] * n, "a": [0] * n, "b": [0] * n, "side": [0] * n, "node": list(range(n)),
                                        "label": list(range(n)), "tokens": [x.tobytes() for x in sets]})
        return [(i, j) for out in m._search_dense((80, 100))([b]) for i, j in zip(*out.to_pydict().values())]
    base = [f"b{i}" for i in range(100)]
    apart = [" ".join(f"x{i}-{j}" if j in (10 + i % 20, 40 + i % 20, 70 + i % 20) else w for j, w in enumerate(base)) for i in range(80)]
    sets = shingle_sets(Words(pa.array(apart)), 5)
    assert not any(m.linked(sets[i], sets[j], (80, 100)) for i in range(80) for j in range(i)) and links(apart) == []
    alike = [" ".join([*base, f"x{i}"]) for i in range(80)]
    assert len(links(alike)) == 79


def test_overlaps_by_products():
    from revspark.llm.op5_jaccard import overlaps
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, int(rng.integers(1, 6000))).astype(np.uint64)) for _ in range(12)]
    got = overlaps(sets, np.arange(5), np.arange(5, 12))
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in range(5, 12)] for i in range(5)]


def test_one_of_each_keeps_columns_of_any_name(spark, stage):
    from revspark.llm.op5_jaccard import one_of_each
    names = ["_first", "_row", "_no", "_blank", "n", "comp", "_N"]
    text = "one two three four five six"
    rows = [(1, text, *[f"{n}1" for n in names]), (2, text.upper(), *[f"{n}2" for n in names]), (1, text, *[f"{n}1" for n in names]),
            (3, " ", *[f"{n}3" for n in names]), (None, None, *[f"{n}4" for n in names])]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = one_of_each(d, stage)
    assert got.columns == d.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, d.filter("`_first` != '_first2'").distinct().collect()))


def test_jaccard_no_rows(docs_of, stage):
    from revspark.llm.op5_jaccard import jaccard_components
    assert jaccard_components(docs_of([(1, "a")]).filter("doc_id < 0"), stage).count() == 0


def test_tree_walk_loses_no_link():
    from revspark.llm.op5_jaccard import signature, survivors
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: int(rng.integers(150, 300))], rng.integers(1, 1 << 62, 20).astype(np.uint64)])) for _ in range(60)]
    words, excess = zip(*map(signature, sets))
    size = np.array([len(s) for s in sets])
    got = {tuple(sorted(p)) for p in survivors(np.array(words), size, np.array(excess), np.arange(60), np.arange(0), (80, 100)).tolist()}
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (size[i] + size[j] - both):
                assert (j, i) in got


def test_quality_counts(docs_of):
    from revspark.llm.op7_quality import fit, judge, predict
    rows = [*EDGE, (1, "a b c a b c\nx y\nx y\n\n\n# $ éé"), (2, " ".join(f"w{i}" for i in range(60)))]
    forest = fit(np.zeros((0, 10)), np.zeros(0), np.zeros(10))
    got = judge(docs_of(rows), forest).collect()

    def brute(t):
        t = t or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed
    want = Counter((d, *brute(t), not brute(t)[-1]) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def test_forest_is_monotonic():
    from revspark.llm.op7_quality import fit, predict
    rng = np.random.default_rng(3)
    x = rng.random((800, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * x[:, 1] + 0.2 * rng.standard_normal(800) < 0.6).astype(float)
    forest = fit(x, y, np.array([-1, 0]))
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4)], axis=1)
    p = predict(forest, grid)
    assert (np.diff(p) <= 1e-12).all() and p[0] > 0.8 > 0.3 > p[-1]


def test_toxicity_and_grades(spark, docs_of):
    from revspark.llm import op3_ordinal, op8_toxicity
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = " ".join(rng.choice(words, 40))
        bad = i % 5 == 0
        rows.append((i, t + (" vileness" if bad else "")))
        labels.append((i, 1, int(bad)))
    d = docs_of(rows + [(1000, None), (1001, ""), (None, "word1 word2")])
    lab = spark.createDataFrame(labels + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = op8_toxicity.score(d, op8_toxicity.train(d, lab)).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    none = op8_toxicity.score(d, op8_toxicity.train(d, lab.filter("toxic = 2"))).collect()
    assert all(r.score < 0.01 for r in none)
    grades = op3_ordinal.grade_texts(d, op3_ordinal.train(d, lab)).collect()
    mean = lambda toxic: np.mean([r.expected_grade for r in grades if r.doc_id is not None and r.doc_id < 400 and (r.doc_id % 5 == 0) == toxic])
    assert len(grades) == 403 and mean(False) > mean(True) + 0.3
    assert op3_ordinal.grade_texts(d.limit(0), op3_ordinal.train(d, lab.limit(0))).count() == 0


def test_toxicity_from_confirmed_texts_only(spark, docs_of):
    from revspark.llm import op8_toxicity
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(300)]
    d = docs_of([(i, " ".join(rng.choice(words, 40)) + (" vileness" if i % 5 == 0 else "")) for i in range(800)])
    labels = spark.createDataFrame([(i, 1, 1) for i in range(0, 800, 10)], "doc_id long, quality int, toxic int")   # half of the toxic ones
    for prior in (None, 0.2):
        got = op8_toxicity.score(d, op8_toxicity.train(d, labels, prior)).collect()
        assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in got), prior
    # a text that only the unlabelled side holds takes part
    seen = []
    fit = op8_toxicity.fit_nnpu
    op8_toxicity.fit_nnpu = lambda toxic, other, *a: seen.append((toxic.n, other.n)) or fit(toxic, other, *a)
    try:
        op8_toxicity.train(d, labels)
    finally:
        op8_toxicity.fit_nnpu = fit
    free = d.filter(~op8_toxicity.held_out(d.doc_id))
    assert seen == [(free.filter("doc_id % 10 = 0").count(), free.filter("doc_id % 10 <> 0").count())]


def test_toxic_rows_go_with_all_columns(docs_of):
    from revspark.llm import op8_toxicity
    w = np.zeros(1 << op8_toxicity.BITS)
    d = docs_of(EDGE)
    kept = op8_toxicity.without_toxic(d, (w, 5.0))
    assert kept.count() == 0 and op8_toxicity.without_toxic(d, (w, -5.0)).columns == d.columns


def test_words_do_not_cross_texts():
    from revspark.llm.kernel import Words
    w = Words(pa.array(["ab", "cd e", None, "", "ab"]))
    assert w.n_words().tolist() == [1, 2, 0, 0, 1]
    h = w.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == 3
