import hashlib
import re

import pytest

import corpus_pipeline as P
from lexloom.llm import bpe, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage, each written and read again."""
    from lexloom.storage import cut

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in P.STAGES:
        after = cut(f(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == list(stages)
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_language(stages):
    before, after = stages["language_id"]
    letterless = {r.doc_id for r in before.collect() if not re.search(r"[^\W\d_]", r.text or "")}
    assert set(ids(before)) - set(ids(after)) <= letterless | {r.doc_id for r in before.collect() if len(r.text) < 100}
    assert len(ids(after)) > 0.98 * len(ids(before))


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert ids(after) == sorted({find(a) for a in sets})


def test_secrets(stages):
    before, after = stages["secret_scans"]
    new = {r.doc_id: r for r in after.collect()}
    assert ids(before) == ids(after)
    for r in before.collect():
        spans = secrets.scan(r.text)[1]
        assert new[r.doc_id].text == secrets.redact(r.text, spans) and (spans or new[r.doc_id].n_chars == r.n_chars)
        assert not secrets.base_spans(new[r.doc_id].text) or not spans


def test_mixing(spark, stages):
    from collections import Counter

    from lexloom.llm import mixing

    before, after = stages["source_mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert Counter(ids(after)) == want


def test_encoding(stages):
    before, after = stages["bpe_encoding"]
    c, texts = bpe.codec(bpe.default_path()), {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r.round_trip and bytes(r.ids) == c.encode(texts[r.doc_id]) and c.decode(bytes(r.ids)) == texts[r.doc_id].encode()


def test_run_equals_its_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages["bpe_encoding"][1])


def test_hard_rows(spark):
    from lexloom.storage import cut

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the of and to in is", "en", "s", 19), (3, "the of and to in is " * 20_000, "en", None, 1), (4, "123", "en", "s", 3), (5, "the of and to in is", "en", "s", 19), (5, "the of and to in is", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, f in P.STAGES:
            some = cut(f(spark, some, SF), name)
    assert some.count() == 0


CLASH = ("lang_pred", "lang_score", "spans", "redacted", "n_assign", "size", "target", "copies", "taken", "source_size", "component_id", "n_shingles", "__n", "__copy", "ids", "__lang")


def test_clashing_columns_keep_their_values(spark):
    from lexloom.storage import cut

    text = "the of and to in is a token = abcdefgh12345 and more words that are not repeated elsewhere "
    rows = [(i, f"{text} number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 1, *(f"mine {c} {i}" for c in CLASH)) for i in range(1, 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema)
    for name, f in P.STAGES[:-1]:
        docs = cut(f(spark, docs, SF), name)
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        got = docs.collect()
        assert got and all(r[c] == f"mine {c} {r.doc_id}" for r in got for c in CLASH), name
    assert P.STAGES[-1][1](spark, docs, SF).count() == len(got)


@pytest.mark.parametrize("stage", [n for n, _ in P.STAGES])
def test_each_stage_on_hard_rows(spark, stage):
    f = dict(P.STAGES)[stage]
    long = "the of and to in is " * 5000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "t", 1), (4, "the of and to in is for", "en", "s", 19), (4, "the of and to in is for", "en", "s", 19), (5, "a to the of and more other words here", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert f(spark, docs.limit(0), SF).count() == 0
    got = sorted(r.doc_id for r in f(spark, docs, SF).collect())
    if stage == "language_id":
        assert 1 not in got and 2 not in got and {3, 4} <= set(got)
    elif stage == "near_duplicates":
        assert got == [1, 2, 3, 4, 5]
    elif stage in ("secret_scans", "bpe_encoding"):
        assert got == [1, 2, 3, 4, 4, 5]
    else:
        assert set(got) <= {1, 2, 3, 4, 5} and got.count(4) % 2 == 0


def test_guard():
    """The entry imports without the subpackage."""
    import subprocess
    import sys

    code = "import sys; sys.modules['lexloom.llm'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=P.__file__.rsplit("/", 1)[0]).returncode == 0
