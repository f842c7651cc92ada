import random
import re
import string

from pathlib import Path

import numpy as np
import pytest

from lexloom.llm import ngramjoin as J
from lexloom.storage import cut, own_dir

SCHEMA = "doc_id long, text string, n long, fp string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def gram_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num):
    """Row-wise (doc_id, n, component) by all pairs of distinct sets."""
    sets = [gram_set(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            o = len(a & b)
            if a and b and 100 * o >= num * (len(a) + len(b) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "ÀB", "Mixed", "x" * 50]
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    while len(rows) < n:
        w = rng.choices(vocabulary, k=rng.choice((1, 2, 3, 4, 8, 30, 60, 120)))
        rows.append(" ".join(w))
        for _ in range(rng.choice((0, 0, 1, 3, 8))):  # chains of edits
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(rng.choice((" ", "\t", "\n\n")).join(w))
        if rng.random() < 0.2:
            rows.append(shared + " " + " ".join(rng.choices(vocabulary, k=40)))
    return [(i, t, 0, "x") for i, t in enumerate(rows)]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, k, num", [(1, 3, 90), (2, 5, 80), (3, 1, 60), (4, 2, 100)])
def test_brute_force(spark, seed, k, num):
    rows = corpus(seed)
    assert result(J.join(spark.createDataFrame(rows, SCHEMA), k, num, 100)) == brute(rows, k, num)


def test_blocks_and_unfiltered_hubs(spark, monkeypatch):
    """Hubs cut into small blocks, and hubs too large for the bitmap filter."""
    monkeypatch.setattr(J, "BLOCK_GRAMS", 300)
    monkeypatch.setattr(J, "FILTER_SETS", 3)
    rows = corpus(7)
    assert result(J.join(spark.createDataFrame(rows, SCHEMA), 3, 80, 100)) == brute(rows, 3, 80)


@pytest.mark.parametrize("splits, num, k", [(2, 80, 3), (1, 80, 3), (0, 80, 3), (2, 60, 1), (2, 90, 2)])
def test_groups_of_many_blocks_meet_again(spark, monkeypatch, splits, num, k):
    """Texts that share rare passages without being copies, and a few that link across blocks only."""
    monkeypatch.setattr(J, "BLOCK_GRAMS", 120)
    monkeypatch.setattr(J, "FILTER_SETS", 0)
    monkeypatch.setattr(J, "SPLITS", splits)
    rng = random.Random(splits + num)
    shared = [f"s{i}" for i in range(9)]
    rows = []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(rng.randrange(6, 14))]
        rows.append((i, " ".join(shared + own), 0, ""))
        if i % 4 == 0:
            w = shared + own + ([f"e{i}"] if i % 8 else [])
            rows.append((1000 + i, " ".join(w), 0, ""))
    rows += [(2000 + i, w, 0, "") for i, w in enumerate(["s0", "s0 s1", "s0 s1 s2", "s1 s0", "S0"])]
    assert result(J.join(spark.createDataFrame(rows, SCHEMA), k, num, 100)) == brute(rows, k, num)


def test_hot_groups_and_empty_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_GROUPS", 4)
    rows = [(i, "the same text stands here", 0, "") for i in range(100, 160)] + [(i, None if i % 2 else " ", 0, "") for i in range(40)] + [(i, f"text {i // 2} of two words each", 0, "") for i in range(60, 80)]
    rows += [(None, "the same text stands here", 0, ""), (None, "", 0, "")]
    assert result(J.join(spark.createDataFrame(rows, SCHEMA), 3, 90, 100)) == brute(rows, 3, 90)


def test_sizes_grow_with_the_rows():
    assert J.bits_for(0, 23, 25, 32) == 23 == J.bits_for(1 << 18, 23, 25, 32) and J.bits_for(1 << 19, 23, 25, 32) == 24 and J.bits_for(1 << 40, 23, 25, 32) == 25
    grams = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    for bits in (5, 23, 25):
        at = J.bucket(grams, 1 << bits)
        assert at.min() >= 0 and at.max() < 1 << bits and len(np.unique(at)) > min(30, 1 << bits) - 3


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [(5, None, 1, "a"), (4, "", 1, "a"), (3, " \t\n", 1, "a"), (9, "one", 1, "a"), (2, "ONE", 1, "a"), (8, "one two", 1, "a"), (7, long, 1, "a"), (6, long + " end", 1, "a"),
            (None, "lone text here now", 1, "a"), (1, "again and again and", 1, "a"), (1, "again and again and", 1, "a"), (None, "one", 1, "a")]
    assert result(J.join(spark.createDataFrame(rows, SCHEMA), 3, 90, 100)) == brute(rows, 3, 90)
    assert J.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_threshold_is_inclusive(spark):
    base = [f"w{i}" for i in range(21)]  # 19 shingles of 3; a text with one more word has 20: 19 / 20 and 18 / 20
    rows = [(1, " ".join(base), 0, ""), (2, " ".join(base[1:]), 0, ""), (3, " ".join(base + ["z1", "z2"]), 0, "")]
    for num in (90, 91, 95):
        assert result(J.join(spark.createDataFrame(rows, SCHEMA), 3, num, 100)) == brute(rows, 3, num)


def test_large_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(w), 0, ""))
    got = result(J.join(spark.createDataFrame(rows, SCHEMA), 3, 90, 100))
    assert got == brute(rows, 3, 90) and {c for _, _, c in got} == {0}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(J.query(spark, "/root/testdata/sf0.001")) == brute(rows, 3, 90)


def test_keep_one(spark):
    rows = [(3, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (2, "other words stand here today", 3, "z"), (4, None, 4, "n"), (1, "a b c d e f", 2, "y"), (None, "a b c d e f", 5, "k"), (6, "", 6, "e"), (7, "", 7, "e")]
    got = sorted(((r.doc_id, r.n) for r in J.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(1, 2), (2, 3), (4, 4), (6, 6), (7, 7)], key=repr)


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{x}{j}" for j in range(40)) for x in "abcd")
    rows = [
        (0, b, 0, "x"), (1, a, 1, "x"), (1, b, 2, "x"),  # under id 1 a text of its own and a copy of document 0
        (2, c, 3, "x"), (2, d, 4, "x"), (3, d + " more", 5, "x"),  # two components with the smallest id 2
        (None, a + " more", 6, "x"), (None, "q " + " ".join(f"e{j}" for j in range(40)), 7, "x"), (None, " ".join(f"e{j}" for j in range(40)), 8, "x"),
        (None, "lone words of no other row at all", 9, "x"), (None, "", 10, "x"), (None, None, 11, "x"), (5, "", 12, "x"), (5, "", 13, "x"),
    ]
    got = sorted(r.n for r in J.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [n for n in got if n not in (7, 8)] == [0, 1, 3, 4, 9, 10, 11, 12, 13] and len({7, 8} & set(got)) == 1
    assert J.keep_one(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_keep_one_with_large_ids(spark):
    big = 1 << 60
    rows = [(big + i, f"text number {i // 2} stands here for some words more", i, "x") for i in range(40)] + [(None, "lone", 99, "y")]
    got = sorted(r.n for r in J.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [*range(0, 40, 2), 99]


def test_texts_of_copies_are_not_shuffled(spark, request):
    """Copies go where they are, by their ids; the table of prefixes goes after its use."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices(string.ascii_letters, k=12)) for _ in range(2000)) for _ in range(4)]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(160)], "doc_id long, text string")
    docs = cut(docs, "copies")
    folder = Path(own_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    kept = J.keep_one(docs)
    left = {p.name.partition("-")[0] for p in folder.iterdir() if p.name not in before}
    assert "met" in left and "prefixes" not in left
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    at, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with lists of ids too large for it
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold))
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == list(enumerate(texts))
    assert written() - at < 4 * len(texts[0])


def test_ngrams_of_one_set_are_not_shuffled(spark, monkeypatch):
    """Sets meet under n-grams that several rows have; the others, and those of copies, stay where they are."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices(string.ascii_letters, k=8)) for _ in range(1000)) for _ in range(100)]
    texts[1] = texts[0] + " more"
    docs = cut(spark.createDataFrame([(i, texts[i % 100]) for i in range(400)], "doc_id long, text string").repartition(8), "texts")
    store, shuffled = spark.sparkContext._jsc.sc().statusStore(), {}

    def written():
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    def measured(df, name="cut"):
        at = written()
        out = cut(df, name)
        shuffled[name] = written() - at
        return out

    monkeypatch.setattr(J, "cut", measured)
    got = {r.doc_id: r.component_id for r in J.join(docs, 5, 80, 100).collect()}
    assert got == {i: 0 if i % 100 < 2 else i % 100 for i in range(400)}
    # 200 n-grams of each of 99 texts, 16 bytes each, and of up to three copies
    assert shuffled["met"] < 99 * 200 * 16 / 4


def test_repeated_ngrams_all_pass(spark):
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(0, 1 << 48, 3000), np.repeat(rng.integers(0, 1 << 48, 500), 3)])
    rng.shuffle(tokens)
    listed = spark.createDataFrame([(int(t),) for t in tokens], "token long").repartition(7)
    bits = J.repeated(listed, 16)
    value, count = np.unique(tokens, return_counts=True)
    has = J._has(bits, value)
    assert has[count > 1].all() and has[count == 1].mean() < 0.1
    assert not J.repeated(listed.limit(0), 16).any()


def test_trie_finds_all_links():
    rng = np.random.default_rng(5)
    level = np.zeros(1 << J.SKETCH_BITS, np.uint8)
    pool = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(5, 60))) for _ in range(60)]
    sets += [np.setdiff1d(s, s[:1]) for s in sets[:20]]
    sets = [s for i, s in enumerate(sets) if not any(len(s) == len(t) and (s == t).all() for t in sets[:i])]
    trie = J.Trie(sets, level, 80, 100)
    for i, s in enumerate(sets):
        found = {trie.order[j] for j in trie.walk(trie.sets[trie.place[i]], None)}
        want = {j for j, t in enumerate(sets) if 180 * len(np.intersect1d(s, t)) >= 80 * (len(s) + len(t))}
        assert found == want


def test_partners_are_never_missed():
    rng = np.random.default_rng(6)
    sets = []
    for n in (5, 40, 300, 900, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [base, base[: int(len(base) * 0.95)], np.unique(np.r_[base[5:], rng.integers(0, 1 << 63, max(1, n // 40), dtype=np.uint64)])]
    maps = [np.packbits(J.parity(s)).tobytes() for s in sets]
    may = J.partners(np.array([len(s) for s in sets]), maps, 0, 80, 100)
    for i, s in enumerate(sets):
        if any(j != i and 180 * len(np.intersect1d(s, t)) >= 80 * (len(s) + len(t)) for j, t in enumerate(sets)):
            assert may[i]


def test_word_hashes_ignore_chunks(monkeypatch):
    data = " ".join(f"word{i}" for i in range(5000)).encode()
    whole = J.word_hashes(data)
    monkeypatch.setattr(J, "_CHUNK_BYTES", 64)
    assert (J.word_hashes(data) == whole).all() and len(whole) == 5000
    assert J.word_hashes(b"A" * 500).tolist() == J.word_hashes(b"a" * 500).tolist()


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60)] + [("100", "101"), ("103", "101"), ("200", "201")]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"{i:03d}"] == "000" for i in range(1, 61)) and got["101"] == got["103"] == "100" and got["201"] == "200"
    assert J.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_native_node_id(spark):
    fps = [J.fingerprint(np.arange(i, dtype=np.uint64)) for i in range(50)]
    got = spark.createDataFrame([(fp,) for fp in fps], "fp binary").select("fp", J._node("fp").alias("nid")).collect()
    assert all(J.node_id(bytes(r.fp)) == r.nid for r in got)


def test_trie_with_sets_inside_each_other():
    pool = np.sort(np.random.default_rng(8).integers(0, 1 << 63, 40, dtype=np.uint64))
    for level in (np.zeros(1 << J.SKETCH_BITS, np.uint8), np.random.default_rng(9).integers(0, 200, 1 << J.SKETCH_BITS).astype(np.uint8)):
        sets = [pool[:n] for n in range(1, 41)] + [pool[n:] for n in range(1, 40)]
        trie = J.Trie(sets, level, 90, 100)
        for i, s in enumerate(sets):
            found = {trie.order[j] for j in trie.walk(trie.sets[trie.place[i]], None)}
            assert found == {j for j, t in enumerate(sets) if 190 * len(np.intersect1d(s, t)) >= 90 * (len(s) + len(t))}


def test_words_without_common_structure(spark):
    """Thue-Morse words and their complements collide in every polynomial hash modulo 2^64."""
    rows = []
    for n in (10, 11, 12):
        w = "a"
        for _ in range(n):
            w += w.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows), w), (len(rows) + 1, w.translate(str.maketrans("ab", "ba")))]
    hashes = [int(J.word_hashes(t.encode())[0]) for _, t in rows]
    assert len(set(hashes)) == len(rows)
    out = J.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)


def test_word_hashes_follow_words():
    text = "One  two\tone " + "x" * 300 + " two " + "x" * 299 + "y " + "x" * 300
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    hashes = J.word_hashes(text.encode()).tolist()
    assert [words.index(w) for w in words] == [hashes.index(h) for h in hashes]
