"""Decontamination against a plain greedy tiling of all pairs, with nulls, repeats, long texts and odd columns."""

import random
import re

from courtflow.llm import decontam

DOCS = "doc_id long, text string, item_id long, coverage double, n_tiles long"


def plain_tiling(item, doc, least):
    """The longest common run of unmarked words first; of equal ones the first in the document, then in the item."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []

    def run(i, d):
        n = 0
        while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
            n += 1
        return n

    while True:
        runs = [(run(i, d), d, i) for d in range(len(doc)) for i in range(len(item))]
        top = max((r[0] for r in runs), default=0)
        if top < least:
            return out
        for n, d, i in runs:
            if n == top and all(free_i[i : i + n]) and all(free_d[d : d + n]):
                free_i[i : i + n] = free_d[d : d + n] = [False] * n
                out.append(n)


def plain(texts, items, seed, coverage):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    found = []
    for doc_id, text in texts:
        for item_id, item in items:
            w = words(item)
            got = plain_tiling(w, words(text), min(seed, len(w))) if w else []
            if got and sum(got) >= coverage * len(w):
                found.append((doc_id, item_id, len(w), sum(got), len(got)))
    return sorted(found, key=repr)


def test_contaminated_equals_plain_tiling(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 30)))) for k in range(12)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, len(w))
            parts += [*w[a:], "x" * rng.randint(0, 2), *w[:a]]  # reordered passages
        texts.append((i, " ".join(parts).upper() if i % 3 else ", ".join(parts)))
    texts += [(60, None), (61, ""), (None, items[0][1]), (5, texts[5][1]), (5, texts[5][1]), (62, " ".join(["noise"] * 3000 + items[3][1].split()))]
    docs = spark.createDataFrame([(i, t, 7, 0.5, 1) for i, t in texts], DOCS)
    bench = spark.createDataFrame([(k, t, "x") for k, t in items] + [(None, "a b c d e", "x"), (99, None, "x"), (98, "", "x")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.n_item_words, r.n_covered, r.n_tiles) for r in decontam.contaminated(docs, bench).collect()), key=repr)
    assert got == plain(texts, items, decontam.SEED, decontam.COVERAGE) and len(got) > 50
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 == decontam.contaminated(docs, bench.limit(0)).count()


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices("abcdef", k=9))) for k in range(20)]
    texts = [(i, " ".join(rng.choices("abcdef", k=60))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, 7, 0.5, 1) for i, t in texts], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "ITEMS", 6)
    got = sorted(((r.doc_id, r.item_id, r.n_item_words, r.n_covered, r.n_tiles) for r in decontam.contaminated(docs, bench).collect()), key=repr)
    assert got == plain(texts, items, decontam.SEED, decontam.COVERAGE)
