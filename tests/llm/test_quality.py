"""Base counts against plain Python, and the verdicts."""

import random
import re
from collections import Counter

import pytest

from fieldmark.llm import quality

SCHEMA = "doc_id long, text string, lang string, kept string, n_words int"


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def prose(rng, n, common=0.45):
    return " ".join(rng.choice(quality.COMMON_WORDS["en"][:20]) if rng.random() < common else "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("few", [48, 1])
def test_base_counts(spark, few, monkeypatch):
    monkeypatch.setattr(quality, "FEW", few)
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "x", "a b", "a b c", "a a a a a", "a b c a b c", "\x0b\x0ca\x1cb\x00 c\n\nc\nc \nc", "É ß 漢字 😀 #*$%&|<> ½", "a\r\nb\r\na\r\n"]
    texts += [" ".join(rng.choices("abcdefg", k=rng.randint(0, 200))) for _ in range(30)]
    texts += ["\n".join(" ".join(rng.choices("xyz", k=2)) for _ in range(20)), "z " * 400, prose(rng, 300)]
    rows = [(i, t, rng.choice(["en", None, "xx"]), "x", -1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t
        assert not (r.base_failed and r.kept)


def test_divergence(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(60, 400)) for _ in range(60)]
    odd = [" ".join(w + rng.choice(["%%%", "***", "###"]) for w in prose(rng, 200).split()), prose(rng, 200).upper(), prose(rng, 300, 0.0)]
    rows = [(i, t, "en", None, None) for i, t in enumerate(good + odd)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(len(good)))
    assert not any(kept[len(good) + i] for i in range(len(odd)))


def test_short_documents_are_not_judged_by_histograms(spark):
    rules = quality.QualityRules(min_words=1)
    rows = [(1, "%% ## $$ ^^ && **", "en", None, None), *[(i, prose(random.Random(i), 200), "en", None, None) for i in range(2, 20)]]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got[1].kept and got[1].char_distance is None


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
