import collections
import itertools
import random

import numpy as np
import pytest

from axisloom.llm import _shingles, decontaminate, knn_join, line_dedup, ngram_join
from axisloom.llm._components import components
from brute import brute_components, shingles


def corpus(seed, n=120):
    """Copies, near copies of every degree, tiny texts, and a passage and groups that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice([3, 5, 8, 9, 12, 30, 120]))] for _ in range(12)]
    rows = []
    for d in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.3:
            text += passage[: rng.choice([40, 38])]
        if rng.random() < 0.1:
            text = [word() for _ in range(rng.randint(0, 60))]
        rows.append((d * 3 + 1, (" " if rng.random() < 0.8 else "\n\t").join(t.upper() if rng.random() < 0.2 else t for t in text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 6)  # so that long lists, later levels and several blocks are used
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    rows = [*corpus(seed), (500, None), (501, ""), (502, "  \n"), (None, "some text with no id at all"), (503, "A b"), (504, "a B"), (503, "A b")]
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id bigint, text string, n string, rep int")
    got = ngram_join.linked_documents(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_components(rows), key=repr)


@pytest.mark.parametrize("demoted, hold", [(5, 3), (100_000, 1), (400, 10**9)])
def test_hot_keys_and_classes_match_brute_force(spark, monkeypatch, demoted, hold):
    for name, value in (("HOT_ROWS", 4), ("HOT_SAMPLE", 1), ("LONG_LIST", 6), ("BLOCK_DOCS", 7), ("DEMOTED_MOST", demoted), ("SAMPLE_HOLD", hold), ("SAMPLE_SHARE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = [*corpus(3), *((1000 + k, "the very same words in each of these rows") for k in range(20)), (2000, "word " * 300_000 + "end"), (2001, "other " * 300_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.linked_documents(docs).collect())) == sorted(brute_components(rows))


def test_small_sets_link_through_subsets_alone(spark, monkeypatch):
    """Sets of four and five: the cost model takes a boundary at which they list no shingle, and their subsets find the links."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    rows = []
    for k in range(150):
        base = [word() for _ in range(8)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base, word()])), (10 * k + 2, " ".join([word() for _ in range(8)]))]
        if k % 3 == 0:
            rows.append((10 * k + 3, " ".join([*base[:7], word()])))
    histogram = collections.Counter(len(shingles(t)) for _, t in rows)
    most = ngram_join.small_boundary(histogram, ngram_join.LIST_COST, 80)
    assert set(histogram) == {4, 5} and most >= 6
    for _, t in rows:
        keys, listed, *_ = ngram_join._keys(np.arange(len(shingles(t)), dtype=np.uint64), most, 80, np.zeros(0, np.uint64))
        assert listed == 0 and len(keys) in (1, 6)
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows)) and sum(r["component_id"] != r["doc_id"] for r in got) == 150


def test_an_id_has_the_links_of_all_its_texts(spark):
    a, b = "one two three four five six seven", " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b + " x"), (4, b + " y z"), (9, "nothing like the others at all")]
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9} and len(got) == 6


def test_ngram_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.linked_documents(docs).count() == 0


def test_shingle_hashes_tell_shingles_apart(monkeypatch):
    rng = random.Random(17)
    texts = ["", " ", "a", "A a\ta", "a\x1cb c", "\u00a0a b\u3000c", "ÄÖ äö Äö", "x" * 5000, " lead and trail \n"]
    texts += ["".join(rng.choices(["a", "b", "B", "ab", " ", "  ", "\n", "\x0b", "é", "日"], k=rng.randint(1, 400))) for _ in range(300)]
    for segment in (1 << 18, 64):
        monkeypatch.setattr(_shingles, "SEGMENT", segment)
        seen = {}
        for t in texts:
            h, want = _shingles.shingle_hashes(t.encode()), shingles(t)
            assert len(h) == len(want) and (np.diff(h) > 0).all()
            assert seen.setdefault(tuple(h.tolist()), want) == want
        for s, t in itertools.combinations(texts[9:60], 2):
            assert len(np.intersect1d(_shingles.shingle_hashes(s.encode()), _shingles.shingle_hashes(t.encode()))) == len(shingles(s) & shingles(t))


def test_small_sets_share_a_subset():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 14)
        a = rng.sample(range(1000), n)
        b = [x if rng.random() < 0.9 else -x - 1 for x in a][: rng.randint(max(1, n - 2), n)] + [2000 + k for k in range(rng.randint(0, 2))]
        sa, sb = (np.unique(np.array(x, np.int64).astype(np.uint64)) for x in (a, b))
        both = len(np.intersect1d(sa, sb))
        for most in (0, 6, 14):
            if 100 * both >= 80 * (len(sa) + len(sb) - both):
                none = np.zeros(0, np.uint64)
                assert set(ngram_join._keys(sa, most, 80, none)[0].tolist()) & set(ngram_join._keys(sb, most, 80, none)[0].tolist())


def test_block_links_join_all_linked_components():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 2**62, 60).astype(np.uint64), base)) for _ in range(80)]
    sets += [np.unique(rng.integers(0, 2**62, 30).astype(np.uint64)) for _ in range(5)]
    roots, blocks = np.arange(85) // 2, np.arange(85) % 2
    for across in (False, True):
        a, b = ngram_join.component_links(sets, roots, blocks, across, 80)
        want = set()
        for i, j in itertools.combinations(range(85), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if roots[i] != roots[j] and (not across or blocks[i] != blocks[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.add((roots[i], roots[j]))
        assert {(roots[i], roots[j]) for i, j in zip(a, b, strict=True)} == want and len(a) == len(want) > 10


def test_boundary_follows_cost():
    assert ngram_join.small_boundary({4: 1000}, 100.0, 80) >= 4
    assert ngram_join.small_boundary({14: 1000}, 0.001, 80) < 14


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 102), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 7, 12, 30, 60, 100])] + [(90, None), (91, ""), (None, "a b c d e f")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.choice([0, 2, 50, 400]))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1] or ""
            words = part.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if words:
                    words[rng.randrange(len(words))] = word()
            at = rng.randint(0, len(text))
            text[at:at] = words
        docs.append((d, "  ".join(text).upper() if d % 3 else "\n".join(text)))
    docs += [(61, None), (62, items[0][1]), (None, items[4][1]), (63, items[3][1]), (63, "x")]
    docs += [(64, "x y " * 150_000 + items[5][1] + " z" * 100_000), (65, "long " * 400_000)]
    want = set()
    held = collections.defaultdict(set)
    for d, t in docs:
        held[d] |= shingles(t)
    for d, s in held.items():
        for i, t in items:
            m = shingles(t)
            if d is not None and i is not None and m and 100 * len(m & s) >= 80 * len(m):
                want.add((d, i, len(m), len(m & s)))
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    got = decontaminate.contaminated(df, bench).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) and any(r["containment"] < 1 for r in got)
    left = decontaminate.without_items(df, bench)
    assert left.columns == df.columns and left.count() == sum(d is None or d not in {w[0] for w in want} for d, _ in docs)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert {tuple(r)[:4] for r in shuffled(decontaminate, df, bench)} == want


def shuffled(module, df, bench):
    kept, module.BROADCAST_MOST = module.BROADCAST_MOST, 0
    try:
        return module.contaminated(df, bench).collect()
    finally:
        module.BROADCAST_MOST = kept


@pytest.mark.parametrize("most", [200_000, 0])
def test_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_MOST", most)
    rows = [(k, f"own {k}\nfooter \r\n\nalso {k}" if k % 2 else f"own {k}\n  footer", "h1") for k in range(10)]
    rows += [(20 + k, f"footer\nx{k // 2}", "h2") for k in range(4)] + [(30, "one page\nalone", "h3")] + [(40 + k, "null host", None) for k in range(6)] + [(50, None, "h1"), (51, "", "h1"), (50, None, "h1")]
    rows += [(60, "word " * 200_000 + "\n" + "short\n" * 100_000 + "footer", "h1")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, source string, N_lines string")
    cut = line_dedup.drop_boilerplate(docs, ratio=0.5)
    assert cut.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    got = {r["doc_id"]: r for r in cut.collect()}
    assert got[1]["text"] == "own 1\n\nalso 1" and (got[1]["n_lines"], got[1]["n_dropped"]) == (3, 1)
    assert got[2]["text"] == "own 2" and got[20]["text"] == "x0" and got[30]["text"] == "one page\nalone" and got[40]["text"] == "" and got[40]["n_dropped"] == 1
    assert got[50]["text"] is None and got[50]["n_lines"] == 0 and got[51]["text"] == "" and got[51]["n_lines"] == 0
    assert got[60]["n_lines"] == 100_002 and got[60]["n_dropped"] == 1 and got[60]["text"] == rows[-1][1].removesuffix("\nfooter")
    assert line_dedup.drop_boilerplate(docs).count() == len(rows) and line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_knn_join_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(k, (centres[k % 6] + rng.normal(size=8) * 0.3).tolist()) for k in range(300)]
    rows += [(300 + k, [0.5] * 8) for k in range(60)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")]), (404, []), (405, [1.0]), (None, [1.0] * 8), (420, [1e200] * 8), (421, [-1e200] * 8)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in knn_join.top_k(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    valid = {k: [int(np.floor(64 * x)) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    clip = lambda s: max(min(s, (1 << 63) - 1), -(1 << 63) + 1)
    for q, v in valid.items():
        if q % 20 == 0:
            scores = sorted((-clip(sum(a * b for a, b in zip(v, x, strict=False))), k) for k, x in valid.items() if k != q)[:20]
            assert got.pop(q) == [(n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert not got
    assert knn_join.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in knn_join.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]


def expected(rows, k=20, every=20):
    """Brute force: the best score of each other id for each query id, over all rows of both."""
    best = collections.defaultdict(dict)
    for q, u in rows:
        for d, v in rows if q % every == 0 else ():
            if d != q:
                score = sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(u, v, strict=False))
                best[q][d] = max(score, best[q].get(d, score))
    return {q: [(n + 1, d, s) for n, (d, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])] for q, found in best.items()}


@pytest.mark.parametrize("case", ["repeats", "hot id", "one vector", "blocks"])
def test_knn_join_of_odd_tables(spark, monkeypatch, case):
    rng = np.random.default_rng(11)
    if case == "blocks":  # many blocks, slots and query groups from few rows
        for name, value in (("DATA_BLOCK", 16), ("QUERY_BLOCK", 4), ("SLOT_BLOCKS", 2), ("GROUPS_KEPT", 1)):
            monkeypatch.setattr(knn_join, name, value)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(200)]
    if case == "repeats":
        rows += [(k, rng.normal(size=4).tolist()) for k in range(0, 200, 7)] + rows[:40]
    if case == "hot id":
        rows += [(40, rng.normal(size=4).tolist()) for _ in range(60)] + [(41, rng.normal(size=4).tolist()) for _ in range(60)] + [(60, [9.0] * 4)] * 30
    if case == "one vector":
        rows = [(k, [0.25, -0.5]) for k in range(300)] + rows[:20]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in knn_join.top_k(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got == expected(rows)


def summarised(x, pivots, every=20, sure=21):
    d = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
    cell, away, n = d.argmin(axis=1), d.min(axis=1), len(pivots)
    nearest = np.full((n, sure), np.inf)
    for c in range(n):
        few = np.sort(away[cell == c])[:sure]
        nearest[c, : len(few)] = few
    top = lambda v: np.array([v[cell == c].max(initial=0) for c in range(n)])
    counts = np.bincount(cell, minlength=n)
    return cell, knn_join.Summary(pivots, counts, np.bincount(cell[::every], minlength=n), top(away), top(np.sqrt((x * x).sum(axis=1))), nearest)


def test_cells_that_cannot_hold_answers_are_left_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = np.floor(64 * np.concatenate([c * rng.uniform(0.5, 3) + rng.normal(size=(50, 16)) * 0.05 for c in centres]))
    cell, summary = summarised(x, x[rng.choice(len(x), 45, False)])
    q = x[::20]
    needed = summary.needed(q, 21)
    scores = q @ x.T
    for k in range(len(q)):  # every answer lies in a cell that is kept
        order = [j for j in np.argsort(-scores[k], kind="stable") if j != 20 * k][:20]
        assert needed[k, cell[order]].all()
    sent = (needed * summary.rows).sum() / (len(q) * len(x))
    assert sent < 0.5, sent
    assert summary.needed(q, 10_000)[:, summary.rows > 0].all()
    assert summary.needed(np.full((1, 16), 1e200), 21)[:, summary.rows > 0].all()


def test_evenly_spread_directions_are_compared_with_all():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None])
    _, summary = summarised(x, x[:44])
    assert (summary.needed(x[::20], 21) * summary.rows).sum() > 0.99 * 100 * 2000


def test_query_groups_are_bounded():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(30, 3))
    queries = rng.integers(0, 400, 30)
    queries[7] = 5000
    s = knn_join.Summary(p, queries * 20, queries, np.zeros(30), np.zeros(30), np.zeros((30, 0)))
    group, parts = s.groups()
    for g in set(group):
        assert queries[group == g].sum() <= knn_join.QUERY_BLOCK or (group == g).sum() == 1 or queries[group == g].max() > knn_join.QUERY_BLOCK
    assert parts[7] == 10 and s.slots()[7] == 7


def test_knn_join_sends_blocks_to_regions_and_broadcasts_none(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(2000)], "vec_id bigint, embedding array<double>")
    sent = []
    monkeypatch.setattr(knn_join, "_solved", lambda data, asked, members, k, f=knn_join._solved: sent.append((data, asked, members)) or f(data, asked, members, k))
    found = knn_join.top_k(df)
    assert found.count() == 2000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    ((data, asked, members),) = sent
    assert data.select("cell").distinct().count() > 30 and len(members) == 1  # one region holds them, and gets each query block once
    assert [len(r["keys"]) for r in asked.collect()] == [1] * asked.count()
    assert all(len(r["m"]) == 2 * len(r["ids"]) // 8 * 8 for r in data.collect())  # two bytes a component


@pytest.mark.parametrize("case", ["even", "clustered", "large", "repeats"])
def test_knn_join_over_many_regions(spark, monkeypatch, case):
    for name, value in (("DATA_BLOCK", 16), ("QUERY_BLOCK", 4), ("REGIONS", 7), ("REGION_BYTES", 1000)):
        monkeypatch.setattr(knn_join, name, value)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(11, 6)) * 20
    rows = [(k, (rng.normal(size=6) * 0.2 + (centres[k % 11] if case == "clustered" else 0)).tolist()) for k in range(400)]
    if case == "large":  # one, two, four and eight bytes a component, and scores beyond single precision
        rows = [(k, [x * 10.0 ** (k % 5 * 2) for x in v]) for k, v in rows]
    if case == "repeats":
        rows += [(k, rng.normal(size=6).tolist()) for k in range(0, 400, 5)] + [(k, [0.25] * 6) for k in range(300, 500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    needs = []
    monkeypatch.setattr(knn_join, "_solved", lambda data, asked, members, k, f=knn_join._solved: needs.append((len(members), asked.select("keys.needs").collect())) or f(data, asked, members, k))
    got = collections.defaultdict(list)
    for r in knn_join.top_k(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got == expected(rows)
    ((regions, asked),) = needs
    assert regions >= 7
    if case == "clustered":  # some queries need some cells of a region only
        assert any(n is not None for r in asked for n in r["needs"])


def test_regions_are_bounded():
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 3000, 200)
    rows[9] = 500_000
    s = knn_join.Summary(rng.normal(size=(200, 3)), rows, rows // 20, np.zeros(200), np.zeros(200), np.zeros((200, 0)), 72)
    held = collections.Counter()
    for c, found in enumerate(s.regions()):
        assert len(found) == s.slots()[c]
        for r in found:
            held[r] += rows[c] / len(found)
    assert len(held) <= knn_join.REGIONS and max(held.values()) <= rows.sum() / knn_join.REGIONS + knn_join.DATA_BLOCK * knn_join.SLOT_BLOCKS
    s.row_bytes = 1 << 15  # wide vectors: as many bytes as a region may hold
    per = [sum(rows[c] / len(f) for c, f in enumerate(s.regions()) for x in f if x == r) for r in range(30)]
    assert max(per) * s.row_bytes <= knn_join.REGION_BYTES + knn_join.DATA_BLOCK * s.row_bytes


def test_pivots_come_from_a_draw_of_bounded_size(spark, monkeypatch):
    df = spark.range(0, 40_000, 1, 20).selectExpr("id", "array(cast(id as double)) v")
    limits = []
    kind = type(df)
    monkeypatch.setattr(kind, "limit", lambda self, n, f=kind.limit: limits.append((n, self.count())) or f(self, n))
    assert len(knn_join._pivots(df, 50, 40_000)) == 50
    assert limits[0][0] == 100 and limits[0][1] < 400
