"""Problem 8: nothing that holds a run is missed."""

import random
from collections import defaultdict

from millrace.llm import leakage

DOCS = "doc_id long, text string, item_id int, passage string"
ITEMS = "item_id long, passage string, question string, answer string, doc_id int"
WORDS = [f"w{k}" for k in range(120)]


def weight(index, d, terms):
    block = d // leakage.BLOCK
    return index.blocks[block][d % leakage.BLOCK, index.column[block, terms]].sum()


def test_search_finds_all_above_the_threshold():
    rng = random.Random(1)
    items = [(k, rng.choices(WORDS, k=rng.randint(5, 60))) for k in range(150)]
    index = leakage.ItemIndex(items, {w: k for k, w in enumerate(WORDS)}, 200)
    assert all(len(w) >= leakage.RUN for _, w in index.items)
    for _ in range(200):
        terms = leakage.np.array(sorted(rng.sample(range(len(index.term)), rng.randint(1, 30))))
        want = [d for d in range(len(index.items)) if weight(index, d, terms) >= leakage.NEED]
        assert index.search(terms) == want


def brute(docs, items):
    runs = defaultdict(set)
    for item, passage, *_ in items:
        w = leakage.words(passage)
        for k in range(len(w) - 11):
            runs[tuple(w[k : k + 12])].add(item)
    out = set()
    for doc, text, *_ in docs:
        w = leakage.words(text)
        for k in range(len(w) - 11):
            out |= {(doc, i) for i in runs.get(tuple(w[k : k + 12]), ())}
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    passages = [rng.choices(WORDS[:40], k=rng.randint(12, 80)) for _ in range(40)]
    items = [(k, " ".join(p), "What is w1 w2?", "w3", 0) for k, p in enumerate(passages)] + [(90, "too short", "q", "a", 0), (91, None, None, None, 0), (92, "", "", "", 0)]
    docs = []
    for k in range(150):
        words = rng.choices(WORDS, k=rng.randint(0, 200))
        if k % 3 == 0:
            p = rng.choice(passages)
            n = rng.choice([11, 12, 13, 30])
            s = rng.randint(0, max(0, len(p) - n))
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + rng.choice([",", ".\n", " -", "!  "]) for w in p[s : s + n]]
        docs.append((k, " ".join(words), 0, ""))
    docs += [(500, None, 0, ""), (501, "", 0, ""), (0, docs[0][1], 0, ""), (502, " ".join(passages[3] * 2000), 0, ""), (None, " ".join(passages[3]), 0, "")]
    got = leakage.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute([d for d in docs if d[0] is not None], [i for i in items if i[1]])
    assert all(r.shared_words >= 12 for r in got)


def test_slices_of_items_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"a{k}b{j}" for j in range(14)), "q", "a", 0) for k in range(7)]
    docs = [(k, "lead in " + items[k][1] + " lead out", 0, "") for k in range(7)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 3)
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect()} == whole == {(k, k) for k in range(7)}


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "x " * 40, 0, "")], DOCS), spark.createDataFrame([(1, "y " * 40, "q", "a", 0)], ITEMS)
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_thousands_of_items_are_one_scan(spark):
    rng = random.Random(5)
    own = [f"v{k}" for k in range(3_000)]
    items = [(k, " ".join(rng.sample(own, 14)), "", "", 0) for k in range(2_500)]
    docs = [(k, "some words before " + items[k * 7][1] + " and after", 0, "") for k in range(200)]
    found = leakage.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k * 7) for k in range(200)}
    # a block holds its own terms only
    index = leakage.ItemIndex([(k, p.split()) for k, p, *_ in items], {}, 10)
    assert sum(held.size for held in index.blocks) < 0.2 * len(index.items) * len(index.term)
