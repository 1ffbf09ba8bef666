"""Prefix trie, Grace dedup and product codes against brute force, with small limits that force every path."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = r"[^\x20\x09-\x0D]+"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        cost = (len(members) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += cost
    return Counter((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(m) if paths[c] == p))) for p, m in nodes.items())


def talks(seed=1, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(3)) if t > 2 else t % 2],
                         ["a b", "a  b c", "", None, "x"][int(rng.integers(5)) if t else c % 3], "k"))
    long = [(2001, t, "user", f"turn {t % 7}", "k") for t in range(300)]
    copies = [(c, t, "user", f"hello {t}", "k") for c in range(1000, 1200, 7) for t in range(5)]
    odd = [(3000, None, "user", "null first", "k"), (3000, 0, "user", "zero", "k"), (3000, 0, "user", "zero", "k"), (3000, 0, "bot", "zero", "k"),
           (None, 0, "user", "nobody", "k"), (3001, 1, "1:a", "b", "k"), (3002, 1, "1", "a:b", "k"), (3021, 5, "user", "only", "k")]
    return rows + long + copies + odd


@pytest.mark.parametrize("shards,chunk,sample", [(1, 1 << 16, 16), (6, 20, 16), (40, 8, 100)])
def test_trie_against_brute_force(spark, stage, shards, chunk, sample):
    from revspark.llm import op11_trie as m
    rows = talks()
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    got = m.prefix_trie(m.as_paths(m.rebuild(m.turn_lists(d))), stage, shards, chunk, sample).collect()
    assert Counter(tuple(r) for r in got) == brute_trie(rows)


def test_trie_splits_copies_of_one_conversation(spark, stage):
    """A conversation that most rows repeat lies in several shards, and its ends are hashed in chunks."""
    from revspark.llm import op11_trie as m
    rows = [(c, t, "user", f"same {t}", "k") for c in range(0, 3000) for t in range(3)]
    paths = stage.save(m.as_paths(m.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k string"))), "p")
    cuts = m.splitters(paths, 8, 64)
    assert len(cuts) >= 6 and len({p for p, _ in cuts}) <= 2 and len(m.Skeleton(cuts).kids) == 4
    got = m.prefix_trie(paths, stage, 8, 50, 64).collect()
    want = sha(",".join(map(str, range(3000))))
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.n_children) for r in got) == [(0, 3000, 1, 1), (1, 3000, 1, 1), (2, 3000, 1, 1), (3, 3000, 1, 0)]
    assert [r.ends_sha256 for r in sorted(got, key=lambda r: r.depth)] == [sha("")] * 3 + [want]


def test_trie_no_rows_and_empty_conversations(spark, stage):
    from revspark.llm import op11_trie as m
    d = spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn long, role string, text string")
    assert m.prefix_trie(m.as_paths(m.rebuild(m.turn_lists(d.limit(0)))), stage).count() == 0
    some = [(c, 0, "a", "b", 0) for c in range(1, 9)]
    got = m.prefix_trie(m.as_paths(m.rebuild(m.turn_lists(spark.createDataFrame(some, "conv_id long, turn long, role string, text string, w int")))), stage)
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(some)


def brute_dedup(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == top and left == 1
            left -= kept
            out[(i, top, len(ids), kept, sha(text))] += 1
    return out


@pytest.mark.parametrize("limits", [{}, dict(block_bytes=300, block_rows=7, bucket_bytes=200, table_bytes=100)])
def test_dedup_against_brute_force(docs_of, stage, limits):
    from revspark.llm.op12_grace import dedup
    rng = np.random.default_rng(3)
    rows = [(int(i), f"text {rng.integers(60)}" * int(rng.integers(1, 4))) for i in rng.permutation(500)]
    rows += [(1000 + i, "hot") for i in range(300)] + [(2000, None), (2001, ""), (2001, ""), (2002, " "), (None, "hot"), (None, "alone"), (None, "alone")]
    rows += [(3000, "z" * 50_000), (3001, "z" * 50_000), (3002, "z" * 49_999 + "y"), (3003, "É"), (3004, "é"), (3005, "text\n"), (3005, "hot")]
    got = dedup(docs_of(rows).repartition(5), stage, **limits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_dedup(rows)
    assert dedup(docs_of(rows).limit(0), stage, **limits).count() == 0


def test_dedup_under_a_normalisation(spark, stage):
    from pyspark.sql import functions as F

    from revspark.llm.op12_grace import dedup
    d = spark.createDataFrame([(1, "A b", 1), (2, "a B", 2), (3, "a  b", 3)], "n long, h string, cls int")
    got = dedup(d, stage, content=F.lower("h"), key="n").collect()
    assert sorted((r.n, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_content_table_holds_equal_hashes_apart():
    from revspark.llm.op12_grace import ContentTable
    t = ContentTable()
    texts = [str(i).encode() for i in range(3000)]
    for x in texts:
        assert t.find(7 if len(x) < 3 else hash(x), x) == -1
        t.add(7 if len(x) < 3 else hash(x), x)
    assert [t.find(7 if len(x) < 3 else hash(x), x) for x in texts] == list(range(3000))


def brute_codes(rows, rounds=6, parts=8, entries=16):
    kept = sorted((v, [math.floor(4096 * x) for x in e]) for v, e in rows)
    n = len(kept[0][1]) // parts
    x = np.array([e for _, e in kept], object).reshape(len(kept), parts, n)
    books = np.array([x[i] for i in range(min(entries, len(kept)))], object).transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        own = [[min(range(books.shape[1]), key=lambda k: (row[p][k], k)) for p in range(parts)] for row in d]
        if r < rounds:
            for p in range(parts):
                for k in range(books.shape[1]):
                    mine = [x[i, p] for i in range(len(x)) if own[i][p] == k]
                    if mine:
                        books[p, k] = [sum(c) // len(mine) for c in zip(*mine)]
    text = ",".join(str(c) for c in books.reshape(-1))
    return {v: ("".join(f"{k:02x}" for k in own[i]), sum(d[i, p, own[i][p]] for p in range(parts)), sha(text)) for i, (v, _) in enumerate(kept)}


@pytest.mark.parametrize("first_b", [1, 3, 8, 16])
def test_codes_against_brute_force(spark, stage, first_b):
    from revspark.llm import op13_codes as m
    rng = np.random.default_rng(first_b)
    centers = rng.standard_normal((20, 32))
    x = np.float32(centers[rng.integers(0, 20, 300)] * 0.3 + 0.1 * rng.standard_normal((300, 32)))
    x[50:60] = x[7]                                           # ties and entries that start alike
    x[5] = x[7]
    x[200:230] = np.round(x[200:230])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [float("nan")] * 32), (902, [float("inf")] + [0.0] * 31), (903, [None] + [0.0] * 31), (904, [3e38] * 32)]
    d = spark.createDataFrame([(i, v, i % 3 if i % 5 else None, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, label int, near int")
    coded, books = m.compress(d.repartition(4), stage, first_b=first_b)
    got = {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in coded.collect()}
    assert got == brute_codes(rows)
    assert books[32].shape == (8, 16, 4)


def test_codes_of_few_vectors_lengths_and_no_rows(spark, stage):
    from revspark.llm import op13_codes as m
    schema = "vec_id long, embedding array<float>, label string"
    rows = [(i, [0.1 * i] * 8) for i in range(5)]
    other = [(10 + i, [0.5, -0.25 * i, 1.0]) for i in range(20)]        # extended with zeros to eight
    wide = [(40 + i, [float((i * j) % 5) for j in range(16)]) for i in range(30)]
    none = [(100, []), (101, [])]
    d = spark.createDataFrame([(i, v, None) for i, v in rows + other + wide + none], schema)
    got = {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in m.compress(d, stage)[0].collect()}
    eight = brute_codes(rows + [(i, v + [0.0] * 5) for i, v in other])
    assert got == {**eight, **brute_codes(wide), 100: ("00" * 8, 0, sha("")), 101: ("00" * 8, 0, sha(""))}
    coded, books = m.compress(d.limit(0), stage)
    assert coded.count() == 0 and books == {}


def test_codes_of_null_and_repeated_ids(spark, stage):
    from revspark.llm import op13_codes as m
    rows = [(None, [1.0] * 8, "a")] * 2 + [(1, [2.0] * 8, "a"), (1, [2.0] * 8, None), (0, [3.0] * 8, "b")]
    got, books = m.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), stage)
    assert books[8][0, :, 0].tolist() == [3 * 4096, 2 * 4096, 2 * 4096, 4096, 4096]
    assert Counter((r.vec_id, r.code, r.error) for r in got.collect()) == Counter(
        [(None, "03" * 8, 0)] * 2 + [(1, "01" * 8, 0)] * 2 + [(0, "00" * 8, 0)])


def test_list_length_follows_the_need():
    from revspark.llm.op13_codes import next_b
    assert next_b(8, [100, 990, 10, 0, 0, 0, 0, 0, 0]) == 2
    assert next_b(8, [100, 50, 0, 0, 50, 0, 0, 0, 0]) == 5
    assert next_b(8, [0, 0, 0, 0, 0, 0, 0, 0, 9]) == 8
    assert next_b(8, [9, 0, 0, 0, 0, 0, 0, 0, 0]) == 2 and next_b(1, [3, 4]) == 1
