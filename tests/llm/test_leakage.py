import random

import pytest

from quillgraph.llm import leakage as L

ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank", "x"), (2, "One two three four", "x"), (3, None, "x"), (4, "", "x"), (5, "The quick brown fox jumps over the lazy dog near the old river bank", "x")]
SCHEMA = "item_id bigint, text string, doc_id string"


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = L.words(text)
        runs = {tuple(w[n : n + 5]) for n in range(len(w) - 4)}
        for i, t in items:
            v = L.words(t)
            hit = {n + k for n in range(len(v) - 4) if tuple(v[n : n + 5]) in runs for k in range(5)}
            near = {n + k for n in range(len(v) - 4) if any(in_order(w[m : m + 8], v[n : n + 5]) >= 4 for m in range(len(w))) for k in range(5)}
            if near:
                out.add((d, i, len(hit), len(v), len(near)))
    return out


def in_order(a, b):
    """The length of the longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for n, x in enumerate(a):
        for m, y in enumerate(b):
            best[n + 1][m + 1] = best[n][m] + 1 if x == y else max(best[n][m + 1], best[n + 1][m])
    return best[-1][-1]


def run(spark, docs, items):
    a = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, term int")
    b = spark.createDataFrame([(i, t, "") for i, t in items], SCHEMA)
    rows = [tuple(r) for r in L.leaked_items(a, b).collect()]
    assert all(r[4] == r[2] / r[3] for r in rows) and len(set(rows)) == len(rows)
    return {(*r[:4], r[5]) for r in rows}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 60)
    random.seed(2)
    vocabulary = [f"w{n}" for n in range(9)]
    items = [(n, " ".join(random.choices(vocabulary, k=random.randint(3, 14)))) for n in range(12)]
    docs = [(n, " ".join(random.choices(vocabulary, k=random.randint(0, 40)) + items[n % 12][1].split()[: n % 9])) for n in range(40)]
    want = brute(docs, items)
    assert len(want) > 20 and any(x[2] < x[4] for x in want) and any(x[2] == 0 for x in want)
    assert run(spark, docs, items) == want


def test_spelling_is_disregarded_and_changes_break_runs(spark):
    items = [x[:2] for x in ITEMS]
    docs = [
        (1, "so THE QUICK, brown\nfox -- jumps over the la-\nzy dog; near the old river bank."),
        (2, "the quick brown fox leaps over the lazy dog near the old river bank"),
        (3, "the quick brown fox jumps"),
        (4, None), (5, ""), (6, "one two three four"),
    ]
    # one changed word leaves every run in proximity
    assert run(spark, docs, items) == {(d, i, n, 14, m) for i in (1, 5) for d, n, m in ((1, 14, 14), (2, 9, 14), (3, 5, 6))}


def test_every_fourth_word_changed_is_found_in_proximity(spark):
    w = ITEMS[0][1].split()
    changed = " ".join(x if n % 4 != 3 else "other" for n, x in enumerate(w))
    inserted = " ".join(f"{x} so" if n % 3 == 2 else x for n, x in enumerate(w))
    apart = " so so so so ".join(w)
    docs = [(1, changed), (2, inserted), (3, apart), (4, w[0] + " " + " ".join(reversed(w)))]
    got = run(spark, docs, [ITEMS[0][:2]])
    assert got == brute(docs, [ITEMS[0][:2]]) and {x[0] for x in got} == {1, 2} and all(x[2] == 0 and x[4] >= 10 for x in got)


def test_rounds_and_empties(spark, monkeypatch):
    items, docs = [x[:2] for x in ITEMS], [(1, ITEMS[0][1]), (1, ITEMS[0][1])]
    monkeypatch.setattr(L, "WORDS_PER_ROUND", 1)
    built = []
    plain = L.build_index
    monkeypatch.setattr(L, "build_index", lambda *a: built.append(1) or plain(*a))
    assert run(spark, docs, items) == {(1, 1, 14, 14, 14), (1, 5, 14, 14, 14)} and built == [1]
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    monkeypatch.setattr(L, "MOST_WORDS", 20)
    with pytest.raises(ValueError, match="more than 20 words"):
        run(spark, docs, items)


def test_very_long_document(spark):
    text = "filler words go here and there " * 30_000 + ITEMS[0][1]
    assert run(spark, [(9, text)], [ITEMS[0][:2]]) == {(9, 1, 14, 14, 14)}
