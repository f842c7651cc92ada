import hashlib
import random
import re

import numpy as np
import pytest

from lexloom.llm import phrases as P

DOCS = "doc_id long, text string, row string, n string, texts string, spans string"
ITEMS = "item_id long, text string, words string, number string"
LOWER = str.maketrans(P._UPPER, P._LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(ws, size):
    return [ws] if 0 < len(ws) < size else [ws[i : i + size] for i in range(len(ws) - size + 1)]


def brute(docs, items, size=10):
    out = []
    test = [(i, w) for i, t in items for w in windows(words(t), size)]
    for doc, text in docs:
        ws, hit, ids = words(text), set(), set()
        for i, w in test:
            for at in range(len(ws) - len(w) + 1):
                if ws[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    ids.add(i)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "r", "n", "t", "s") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "w", "x") for i, t in items], ITEMS)


def got(out):
    return sorted((tuple(r)[:6] for r in out.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Élan", "日本", "a1b2", "naïve", "x" * 40]
    text = lambda n: "".join(w + rng.choice((" ", ", ", "-", "\n\n", "_")) for w in rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice((0, 1, 2, 5, 9, 10, 11, 30)))) for i in range(25)] + [(3, "again " + text(12)), (None, text(14)), (77, None), (78, ""), (79, " .,- ")]
    items += [(200 + i, items[7][1].upper()) for i in range(3)]  # the same words under other ids
    docs = []
    for i in range(80):
        t = text(rng.choice((0, 3, 40, 200)))
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "") + " " + text(5)
        docs.append((i, t))
    docs += [(None, docs[3][1]), (5, docs[4][1]), (5, docs[4][1]), (90, None), (91, ""), (92, "..."), (93, items[7][1] * 3)]
    docs += [(100 + i, "start " + items[-1][1]) for i in range(60)]  # most documents share one set of items
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert got(P.contaminated(*frames(spark, docs, items), window=5)) == brute(docs, items, 5)


def test_long_texts_lie_in_several_segments(spark, monkeypatch):
    """Pieces, segments and passes far smaller than the texts give the same result."""
    docs, items = corpus(9)
    docs.append((1000, " ".join(t or "" for _, t in docs)))
    items.append((2000, " ".join((t or "")[:400] for _, t in docs[:20])))
    want = brute(docs, items)
    for size, words_at_once in ((64, 50), (700, 1 << 18), (1 << 22, 500)):
        monkeypatch.setattr(P, "PIECE_BYTES", max(64, size // 4))
        monkeypatch.setattr(P, "PASS_WORDS", words_at_once)
        assert got(P.contaminated(*frames(spark, docs, items), segment_bytes=size)) == want


def test_pieces_cover_every_run():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(("a", "bc", "É", "z" * 30, " ", "  ,", "\n")) + rng.choice(("", " ")) for _ in range(rng.randrange(60)))
        size, overlap = rng.choice((1, 5, 20)), rng.choice((0, 1, 4))
        own, runs = [], set()
        for first, n, found in P.pieces(text, size, overlap):
            assert first == len(own)
            own += [w.decode() for w in found[:n]]
            runs |= {(first + i, *found[i : i + overlap + 1]) for i in range(len(found) - overlap)}
        assert own == words(text)
        plain = [w.encode() for w in own]
        assert runs >= {(i, *plain[i : i + overlap + 1]) for i in range(len(plain) - overlap)}


def test_stored_lists(spark):
    """The index holds every position of every word once, whatever the steps between them."""
    rare = "rare " + "common " * 70_000 + "rare"
    docs = [(1, "b a b"), (2, None), (3, rare), (4, "a")]
    index = P.build(frames(spark, docs, [])[0].coalesce(1), 10, 1 << 22).toArrow().to_batches()
    found = {}
    for b in index:
        for about, ids, segment in P.opened(b, 10):
            first = np.concatenate([[0], segment.ends[:-1]])
            for t, lo, hi in zip(segment.terms, first, segment.ends):
                for place in segment.places[lo:hi]:
                    i = np.searchsorted(segment.starts, place, "right") - 1
                    found.setdefault((ids[i].as_py(), t.decode()), []).append(int(place - segment.starts[i]))
    assert found == {(1, "a"): [1], (1, "b"): [0, 2], (3, "rare"): [0, 70_001], (3, "common"): list(range(1, 70_001)), (4, "a"): [0]}


def near(docs, items, size, width):
    """(doc, item) by trying every span."""
    out = set()
    for doc, text in docs:
        ws = words(text)
        for i, t in items:
            if any(set(w) <= set(ws[at : at + width]) for w in windows(words(t), size) for at in range(len(ws))):
                out.add((doc, i))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_proximity(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((0, 4, 20, 60))))) for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 4, 6))))) for i in range(12)]
    frame_docs, frame_items = frames(spark, docs, items)
    texts, names = P.tests(frame_items)
    for width in (4, 7):
        found = P.search(P.build(frame_docs, 7), texts, 4, 7, width).selectExpr("doc_id", "explode(texts) as number").join(names, "number")
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == near(docs, items, 4, width)


def test_proximity_spans(spark):
    docs, items = frames(spark, [(1, "x c y a z b q a b c"), (2, "a b")], [(9, "a b c")])
    texts, _ = P.tests(items)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in P.search(P.build(docs, 6), texts, 3, 6, 5).collect()}
    assert found[2] == [] and found[1] == [(1, 6), (7, 10)]


def test_reach(spark):
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    with pytest.raises(ValueError, match="up to 5 words"):
        P.search(P.build(docs, 5), P.tests(items)[0], 10, 5)


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [])
    assert got(P.contaminated(docs, items)) == brute([(1, "a b")], [])
    docs, items = frames(spark, [], [(1, "a b")])
    assert P.contaminated(docs, items).count() == 0


def test_segments_need_no_shuffle(spark):
    docs, _ = frames(spark, [(1, "a")], [])
    assert "Exchange" not in P.build(docs)._jdf.queryExecution().toString()
