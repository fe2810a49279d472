import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from samples import make, prose

from nearkin.llm import decontaminate as dec
from nearkin.llm import line_dedup as lines
from nearkin.llm import near_dedup as near
from nearkin.llm import substring_dedup as sub
from nearkin.llm.components import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows, percent):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            i, j = find(ids[a]), find(ids[b])
            root[max(i, j)] = min(i, j)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, corpus, percent, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)  # so that buckets take several blocks
    rows = [r for r in corpus if r[0] is not None and r[0] not in (300, 301)]
    want, sizes = brute_classes(rows, percent)
    got = near.near_duplicates(make(spark, rows), percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len(set(want.values())) < len(rows)


def test_near_duplicates_of_odd_rows(spark, corpus):
    got = near.near_duplicates(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert [r["component_id"] for r in got if r["doc_id"] == 300] == [300, 300]
    assert near.near_duplicates(make(spark, [])).count() == 0
    assert near.near_duplicates(make(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_classes_of_a_repeated_id_are_one(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = near.near_duplicates(make(spark, [(3, a), (5, a), (5, b), (9, b), (11, "alone in here")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (11, 11, True)]


def test_registers_and_estimates():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    regs = near.registers(h, np.zeros(len(h), np.int64), 1)[0]
    for bucket in range(near.REGISTERS):
        least = int(h[h >> np.uint64(57) == bucket].min()) & (1 << 57) - 1
        zeros = 57 - least.bit_length()
        mantissa = (least << 67 >> (57 - zeros)) & (1 << 67) - 1 if False else (least - (1 << 56 - zeros)) * 1024 >> (56 - zeros)
        assert regs[bucket] == 1 + (zeros << 10) + mantissa
    a, b = set(range(1000)), set(range(80, 1080))
    words = rng.integers(0, 2**64, 1100, dtype=np.uint64)
    sketches = [near.registers(np.sort(words[list(s)]), np.zeros(len(s), np.int64), 1)[0] for s in (a, b)]
    equal = int(((sketches[0] == sketches[1]) & (sketches[0] > 0)).sum())
    assert abs(near.estimated(np.array(equal), np.array(128)) - 920 / 1080) < 0.15
    assert near.estimated(np.array(0), np.array(128)) == 0


def test_exact_links_of_blocks():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50))), np.uint64) for _ in range(40)]
    sets += [sets[0], np.append(sets[1], np.uint64(99))]
    left, right = np.arange(20), np.arange(20, len(sets))
    x, y = near.links(sets, left, right, 60)
    want = {(a, b) for a in left for b in right if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
    assert len(near.forest(4, np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]))) == 3


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500), (700, 600), (600, 800)]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 200)} | {700: 600, 800: 600}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {s + j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < i for j in range(k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("k, copies", [(3, 10_000), (13, 4)])
def test_repeats_equal_brute_force(spark, corpus, k, copies, monkeypatch):
    monkeypatch.setattr(sub, "COPIES", copies)  # so that texts are hot
    rows = [((1 << 62) if r[0] is None else r[0], r[1]) for r in corpus]
    got = sorted(tuple(r) for r in sub.remove_repeats(make(spark, rows), k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_repeats(rows, k)


def test_repeats_of_odd_rows(spark, corpus):
    got = sub.remove_repeats(make(spark, corpus)).collect()
    assert len(got) == len(corpus) and sum(r["doc_id"] is None for r in got) == 2
    assert sub.remove_repeats(make(spark, [])).count() == 0
    texts = sub.remove_repeats(make(spark, [(1, "a  b"), (2, None)]), texts=True).orderBy("doc_id").collect()
    assert [r["text"] for r in texts] == ["a b", ""]


def test_very_many_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    many = spark.range(5, 100_005).selectExpr("id as doc_id", f"if(id % 1000 = 0, concat('{text}', ' and ', id), '{text}') as text")
    got = sub.remove_repeats(many)
    assert got.count() == 100_000
    assert [tuple(r) for r in got.groupBy("n_words", "n_removed").count().orderBy("n_words", "n_removed").collect()] == [(40, 0, 1), (40, 40, 99_899), (42, 40, 1), (42, 41, 99)]  # they share the 41st word too
    assert got.where("n_removed = 0").first()["doc_id"] == 5


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    sizes = sub.Sizes(1000)
    packs = [rng.integers(0, 300, 200, dtype=np.uint64) for _ in range(3)]
    hits = {}
    for w in packs:
        for shard, cells, again in sub._sketch(w, 0, sizes):
            assert (sub._ungap(sub._gaps(cells)) == cells).all()
            for c, more in zip(cells.tolist(), again.tolist(), strict=True):
                hits[shard, c] = hits.get((shard, c), 0) + 1 + more
    truth = {}
    for w in packs:
        for x in set(w.tolist()):
            truth[x] = truth.get(x, 0) + 1
    for x, n in truth.items():
        cell = int(sub._cells(np.array([x], np.uint64), 0, sizes.cells)[0])
        assert hits[cell // sizes.shard_cells, cell % sizes.shard_cells] >= n
    wide = np.array([0, 65534, 65535, 200_000, 1 << 25], np.int64)
    assert (sub._ungap(sub._gaps(wide)) == wide).all()


def test_alignment_is_ordered_and_exact():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = lines.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert lines.align(a, a) == [(i, i) for i in range(len(a))]
    assert lines.align([1, 2, 3, 9, 4], [7, 2, 3, 4, 8]) == [(1, 1), (2, 2), (4, 3)]
    assert lines.increasing([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]


def brute_lines(rows, min_line=4, min_block=20):
    """Partners by shared lines' first holders, each pair aligned, blocks deleted."""
    docs = {i: [x for x in t.split("\n") if x] for i, t in rows if t is not None}
    first = {}
    for i in sorted(docs):
        for x in docs[i]:
            if len(x.split()) >= min_line:
                first.setdefault(x, i)
    gone = {i: set() for i in docs}
    for i in docs:
        for p in {first[x] for x in docs[i] if x in first} - {i}:
            block, last = [], None
            for pair in [*lines.align(docs[i], docs[p]), (-9, -9)]:
                if last is None or pair != (last[0] + 1, last[1] + 1):
                    if sum(len(docs[i][b].split()) for b in block) >= min_block:
                        gone[i].update(block)
                    block = []
                block.append(pair[0])
                last = pair
    return gone


@pytest.mark.parametrize("share", [2, 500])
def test_line_dedup_equals_brute_force(spark, corpus, share, monkeypatch):
    monkeypatch.setattr(lines, "SHARE", share)
    rng = random.Random(6)
    shared = [prose(rng, 12, 10_000) for _ in range(6)]
    rows = [(r[0], r[1]) for r in corpus if r[0] is not None and r[0] not in (300, 301)]
    rows += [(500, "\n".join(shared)), (501, "mine own words here\n" + "\n".join(shared[1:4]) + "\n\nand an end"), (502, "\n".join(shared)), (503, shared[2] + "\nother words"), (504, "\n".join(reversed(shared)))]
    gone = brute_lines(rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(make(spark, rows)).collect()}
    for i, t in rows:
        assert got[i]["n_removed"] == len(gone.get(i, ())), i
        assert got[i]["text"] == (t if t is None else lines.kept_text(t, gone[i]))
        assert got[i]["gone"] == 1 and got[i]["registers"] == b""  # columns of clashing names stay as they were
    assert got[501]["text"] == "mine own words here\n\nand an end"
    assert got[502]["text"] == "" and got[503]["n_removed"] == 0 and got[500]["n_removed"] == 0


def test_line_dedup_of_odd_rows(spark, corpus):
    got = lines.line_digest(lines.dedup_lines(make(spark, corpus)))
    assert got.count() == len(corpus)
    assert lines.dedup_lines(make(spark, [])).count() == 0
    one = lines.dedup_lines(make(spark, [(None, "a b c d\ne"), (None, "a b c d\ne")])).collect()
    assert [r["n_removed"] for r in one] == [0, 0]


def brute_all_lines(rows, min_block=20, size=lambda line: len(line.split())):
    """Every pair of documents aligned, blocks deleted."""
    docs = {i: [x for x in t.split("\n") if x] for i, t in rows}
    gone = {i: set() for i in docs}
    for p, i in combinations(sorted(docs), 2):
        gone[i].update(lines.deleted(docs[i], docs[p], [size(x) for x in docs[i]], min_block))
    return gone


def removed(spark, rows):
    return {r["doc_id"]: set(r["gone"]) for r in lines.repeated_lines(make(spark, rows)).collect()}


def test_line_dedup_equals_brute_force_over_all_pairs(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    assert removed(spark, [(1, a), (2, b), *((i, f"{a}\n{b}") for i in range(3, 9))]) == {i: {0, 1} for i in range(4, 9)}
    rng = random.Random(8)
    pool = [" ".join(f"l{n}x{i}" for i in range(rng.choice([0, 1, 3, 6, 12, 25]))) or " " for n in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows += [(i, "\n".join([c, d] * 2)) for i, (c, d) in enumerate([(a, b), (b, a), (a, b), (b, b), (a, a), (b, a)], 200)]
    want = {i: g for i, g in brute_all_lines(rows).items() if g}
    assert removed(spark, rows) == want and len(want) > 50


def test_rows_that_share_an_id_lose_lines_by_their_own_text(spark):
    rng = random.Random(9)
    pool = [" ".join(f"l{n}x{i}" for i in range(rng.choice([2, 5, 12, 25]))) for n in range(10)]
    rows = [(i // 2, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(80)] * 2
    want = []
    for i, t in rows:
        own = [x for x in t.split("\n") if x]
        gone = set()
        for p, earlier in rows:
            if p < i:
                gone.update(lines.deleted(own, [x for x in earlier.split("\n") if x], [len(x.split()) for x in own]))
        want.append((i, lines.kept_text(t, gone), len(own), len(gone)))
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(make(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and sum(w[3] > 0 for w in want) > 40


def test_line_dedup_of_very_long_texts(spark):
    long = "\n".join(f"line {i} of the long text" for i in range(200_000))
    one = "word " * 500_000
    got = {r["doc_id"]: r for r in lines.dedup_lines(make(spark, [(1, long), (2, "mine\n" + long + "\n\nown"), (3, one), (4, one), (5, "line 7 of the long text")])).collect()}
    assert got[2]["text"] == "mine\n\nown" and got[2]["n_removed"] == 200_000
    assert got[4]["text"] == "" and [got[i]["n_removed"] for i in (1, 3, 5)] == [0, 0, 0]


def test_short_lines_and_lines_without_spaces_are_deduplicated(spark):
    verse = "\n".join(f"one two{i} three" for i in range(100))
    assert removed(spark, [(1, verse), (2, "mine\n" + verse), (3, "a\n" * 19 + "a"), (4, "a\n" * 19 + "a")]) == {2: set(range(1, 101)), 4: set(range(20))}
    han, thai = "漢" * 25 + "かな" * 8, "ก" * 80
    rows = [(1, f"{han}\nA"), (2, f"B\n{han}"), (3, thai), (4, f"C\n{thai}\nD"), (5, "漢" * 39), (6, "漢" * 39 + "\nE")]
    assert removed(spark, rows) == {2: {1}, 4: {1}}
    data = np.frombuffer("é漢字かな😀ñ𠀀𠀁ກx".encode(), np.uint8)
    assert lines.unspaced(data, np.array([0]), np.array([len(data)])).tolist() == [(2 * 6 + 1) // 4]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_contamination(docs, items, k):
    out = []
    windows = {}
    for item, t in items:
        w = re.findall(WORD, lower(t))
        for s in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(item)
    for i, t in docs:
        w = re.findall(WORD, lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s : s + n]))
                if own:
                    hit.update(range(s, s + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((i if i is not None else -1, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("broadcast, share", [(None, 20_000), (0, 20_000), (0, 3)])
def test_contamination_equals_brute_force(spark, corpus, broadcast, share, monkeypatch):
    """The broadcast and the shuffled form, the latter also with hot prefixes dealt to several tasks."""
    monkeypatch.setattr(dec, "SHARE", share)
    monkeypatch.setattr(dec, "CHUNK", 50)
    monkeypatch.setattr(dec, "PART", share)
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(0, 25), 30)) for i in range(12)] + [(50, None), (51, ""), (52, "W1 w2"), (53, "repeat me repeat"), (9, "Again, the same id."), (54, "w7"), (55, "a a a a a a a a a a a a")]
    docs = [(r[0], r[1]) for r in corpus if r[0] is not None] + [(1000 + i, prose(rng, 5) + ", " + (items[i][1] or "").upper() + "! " + prose(rng, 5)) for i in range(12)]
    docs = [d for d in {d[0]: d for d in docs}.values()] + [(2000, "again and again w1 w2"), (2000, "again and again w1 w2"), (2000, "else"), (2001, "a " * 500)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = dec.contamination(make(spark, docs), bench, broadcast_windows=broadcast)
    want = brute_contamination(docs, items, dec.WINDOW)
    assert sorted(tuple(r) for r in got.collect()) == want and sum(w[5] for w in want) > 20


def test_contamination_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (None, "no id at all")], "item_id long, text string")
    for form in (None, -1):
        got = dec.contamination(make(spark, corpus), none, broadcast_windows=form)
        assert got.count() == len(corpus) and got.where("contaminated").count() == 0
        assert dec.contamination(make(spark, []), some, broadcast_windows=form).count() == 0
        hit = dec.contamination(make(spark, corpus), some, broadcast_windows=form).where("contaminated").collect()
        assert [(r["doc_id"], r["n_hit"], r["n_items"]) for r in hit] == [(None, 4, 0)]  # an item without id is hit, but has no name


def test_groups_outlive_batches():
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randint(0, 5), rng.randint(0, 1), 0, 0, i, rng.randint(0, 1)) for i in range(300))
    names = [*near.GROUP, "rep", "block"]
    table = pa.table({**{n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}, "registers": pa.array([bytes([r[4] % 256]) for r in rows], pa.binary())})
    for size in (1, 7, 100, 1000):
        got = []
        for now, values, edges in near._groups(iter(table.to_batches(size)), "registers"):
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                assert values[x:y] == [bytes([i % 256]) for i in now["rep"][x:y].tolist()]
                got.append(((now["key"][x], now["band"][x]), now["rep"][x:y].tolist()))
        assert len(got) == len({g[0] for g in got}) and [i for g in got for i in g[1]] == [r[4] for r in rows]
