import random
import re
from collections import Counter

import pytest

from lexloom.llm import quality

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }
    out["base_failed"] = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    counts = out | {"n_exclamations": text.count("!"), "n_lines": len(lines), "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in words)}
    ok = all((r.low is None or counts[r.num] >= r.low * counts[r.den]) and (r.high is None or counts[r.num] <= r.high * counts[r.den]) for r in quality.RULES)
    return out | {"kept": not out["base_failed"] and ok}


def check(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect():
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, repr(texts[r.doc_id])[:100]


def test_edges(spark):
    check(spark, [
        None, "", " \t\n\x0b\x0c\r", "a", "a b", "a a a", "a a a a", "a b c a b c", "a b a b a b", "x\n\nx\n \nx ", "#*$%&|<> é ẞ 漢字 \U0001f600", "the of and\n" * 60,
        "no break space here", "one two three " * 20_000, " ".join(f"w{i}" for i in range(30_000)), "w\x00x y", "end\n", "\nstart", "the " * 30 + "word " * 25,
    ])


def test_random_texts(spark):
    rng = random.Random(4)
    check(spark, ["".join(rng.choice(["a ", "b ", "c ", "the ", "word\n", "\t", "# ", "!", "é "]) for _ in range(rng.randint(0, 200))) for _ in range(300)])


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_stays_and_junk_goes(spark):
    clean = "The report was written for the people who live in this town and it is clear that they like it. " + " ".join(f"Then the w{i} of v{i} is u{i}." for i in range(30))
    shout = " ".join(f"WORD{i}!!" for i in range(80))
    marked = " ".join(f"the word{i}###" for i in range(80))
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame([(1, clean, "", ""), (2, shout, "", ""), (3, marked, "", "")], SCHEMA)).collect()}
    assert got == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_labelled_table(spark, sf):
    """Texts labelled bad are mostly dropped, those labelled good and long enough mostly kept."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    got = quality.query(spark, f"/root/testdata/{sf}").join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and (not bad or sum(bad) / len(bad) < 0.3)


def test_native_plan(spark):
    plan = quality.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
