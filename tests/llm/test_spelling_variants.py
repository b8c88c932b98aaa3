import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelsight.llm import spelling_variants as sv


def brute_near(words):
    """Word to its set of words at exactly one edit, by comparing all pairs."""
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    return {w: {v for v in words if near(w, v)} for w in words}


def brute(rows):
    """The contract, from the texts, with plain strings."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            n[sv.slipped(doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), run))] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab\xe9", min_size=7, max_size=10), min_size=1, max_size=60))
def test_two_directions_find_every_pair_once(words):
    words = sorted(words)
    got = Counter()
    for first_half in (True, False):
        who, what = sv.near_words(words, words, first_half)
        got.update((words[a], words[b]) for a, b in zip(who, what))
    want = brute_near(words)
    assert max(got.values(), default=1) == 1
    assert set(got) == {(w, v) for w in want for v in want[w]}


def test_long_and_short_words_together():
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abc"), 5000))
    words = sorted({long, long[:-1], long[1:], long[:2500] + "z" + long[2500:], "abcabca", "abcabcab", "abcabc\xfe"})
    got = set()
    for first_half in (True, False):
        who, what = sv.near_words(words, words, first_half)
        got |= {(words[a], words[b]) for a, b in zip(who, what)}
    want = brute_near(words)
    assert got == {(w, v) for w in want for v in want[w]}


def some_texts():
    rng = np.random.default_rng(2)
    stems = ["".join(rng.choice(list("abcde\xe9\xd7"), rng.integers(6, 11))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(stems[:12], 60)) + "; " + stems[i % 40].upper() + " x " + stems[i % 40][1:]) for i in range(300)]
    chain = "abababababab"              # each next spelling ten times as frequent
    rows += [(1000, " ".join([chain] * 4 + [chain + "c"] * 50 + [chain + "cd"] * 600 + [chain + "cde"] * 7000))]
    return rows + [(None, "abababababab nullidword nullidword"), (5, None), (6, ""), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("shard_words", [sv.SHARD_WORDS, 3])
def test_whole_operator_equals_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(sv.best_near, "__defaults__", (shard_words,))
    rows = some_texts()
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    assert sum(x[1] is not None for x in want) > 5 and any(x[2] not in (x[0], x[1]) for x in want)
    assert result(sv.group_variants(docs)) == want


def test_given_documents(spark, some_docs):
    rows = [(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()]
    assert result(sv.group_variants(some_docs)) == brute(rows)


def test_odd_tables(odd_docs, no_docs):
    assert result(sv.group_variants(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert result(sv.group_variants(no_docs)) == []
