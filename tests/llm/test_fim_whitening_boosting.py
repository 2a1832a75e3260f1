"""Fill-in-middle, whitening and the quality classifier against plain versions, with nulls, ties, repeats, empty and odd tables."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from courtflow.llm import boosting, fim, whitening
from courtflow.llm import queries as corpus

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, payload string, n int, form string, x string"
TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "p", 1, "f", "x") for i, t in rows], DOCS)


def plain_fim(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def held(rows):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in rows), key=repr)


def test_fill_in_middle_on_whole_tables(spark):
    got = held(corpus.op11_fill_in_middle(spark, SF).collect())
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert got == sorted(((i, *plain_fim(i, t)) for i, t in rows), key=repr)


def test_fill_in_middle_on_odd_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab é\n\t<>PMS世", k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "a b c d e f"), (None, None), (302, " "), (303, "x" * 300_000), (304, "word " * 200_000), (305, "é  b\u0085c" * 50_000), (306, "has <P> in it"), (1, "again"), (1, "again")]
    made = fim.fill_in_middle(docs(spark, rows))
    assert held(fim.digests(made).collect()) == sorted(((i, *plain_fim(i, t)) for i, t in rows), key=repr)
    assert sorted((r.doc_id or 0, r.restored) for r in fim.texts(made).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert fim.digests(fim.fill_in_middle(docs(spark, []))).count() == 0


def test_frames_are_cut_and_sought(monkeypatch):
    monkeypatch.setattr(fim, "FRAME", 7)
    rng, writer = random.Random(1), fim.Writer()
    for _ in range(400):
        text = "".join(rng.choices("ab é\n\t<MPS世", k=rng.randint(0, 60)))
        frames, tokens = fim.stored(text.encode(), writer), TOKENS.findall(text)
        assert frames.units[-1] == len(tokens) and b"".join(frames.stream()).decode() == text
        for k in range(len(tokens) + 1):
            head = "".join(tokens[:k])
            assert frames.after_units(k) == (len(head.encode()), len(head))
        cuts = sorted(frames.after_units(rng.randint(0, len(tokens)))[0] for _ in range(2))
        for form in ("plain", "psm", "spm"):
            out = fim.arranged(frames, form, tuple(cuts), writer)
            assert b"".join(fim.restored(out, form)).decode() == text and out.chars[-1] == len(text) + (0 if form == "plain" else 9)


def test_whole_frames_are_copied_and_only_cut_ones_read(monkeypatch):
    """A cut reads its own frame (and the end of the one before it), and frames that no cut meets are copied compressed."""
    monkeypatch.setattr(fim, "FRAME", 100)
    writer = fim.Writer()
    frames = fim.stored(("word " * 1000).encode(), writer)
    read = []
    plain = fim.Frames.frame
    monkeypatch.setattr(fim.Frames, "frame", lambda self, i: read.append(i) or plain(self, i))
    first, second = frames.after_units(111)[0], frames.after_units(555)[0]
    out = fim.arranged(frames, "psm", (first, second), writer)
    assert len(set(read)) == 2
    kept = {bytes(frames.payload[a:b]) for a, b in zip(frames.offsets, frames.offsets[1:])}
    made = [bytes(out.payload[a:b]) for a, b in zip(out.offsets, out.offsets[1:])]
    assert sum(m in kept for m in made) >= len(frames) - 2


VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], VECTORS)


def plain_whitening(rows, components):
    """By the eigenvectors of the covariance, from numpy."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    d = (x * len(fit) - fit.sum(0)).astype(object)
    return len(fit), [sum(int(c) ** 2 for c in row) for row in d], (x - fit.mean(0)) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(got, rows, components=16):
    n, deviation, want, share = plain_whitening(rows, components)
    k = want.shape[1]
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == len(rows) * k
    have = np.array([[table[i, c + 1].whitened for c in range(k)] for i, _ in rows])
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-8
    for j, (i, _) in enumerate(rows):
        r = table[i, 1]
        assert (r.n, r.deviation) == (n, deviation[j]) and math.isclose(r.explained, share[0], rel_tol=1e-9) and r.identity_error < 1e-9


def test_whitening_on_whole_tables(spark):
    rows = [tuple(r) for r in duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()]
    compare(corpus.op12_whitening(spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(200)]
    good += [(200 + i, good[0][1]) for i in range(90)]  # copies count once in the fit
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, [1.0]), (905, []), (906, [3e38, 0.0, 0.0, 0.0, 0.0])]
    compare(whitening.whitening(vectors(spark, good + bad).repartition(7)).collect(), good)
    compare(whitening.whitening(vectors(spark, good), 3).collect(), good, 3)
    twice = whitening.whitening(vectors(spark, [*good, good[0], (None, good[1][1])])).collect()
    assert sum(r.vec_id == 0 for r in twice) == 10 and sum(r.vec_id is None for r in twice) == 5


def test_whitening_of_few_or_flat_vectors(spark):
    flat = [(i, [float(i), float(2 * i), 7.0]) for i in range(9)]
    compare(whitening.whitening(vectors(spark, flat)).collect(), flat)
    for rows in ([], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whitening(vectors(spark, rows)).count() == 0


def test_sums_stay_exact_beyond_64_bits():
    x = np.array([[1 << 45, 3], [-(1 << 45), 5], [7, 1 << 50]])
    about = whitening.Sums(1 << 30, (12345, 678), 1 << 50)
    exact = [[int(c) * about.n - s for c, s in zip(row, about.s)] for row in x]
    assert about.deviations(x).tolist() == exact
    assert about.squares(x) == [None, None, None]


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40, 90])
def test_qd_solver(d):
    rng = np.random.default_rng(d)
    equal = np.linalg.qr(rng.standard_normal((d, d)))[0]
    graded = np.triu(rng.standard_normal((d, d))) * np.logspace(0, -8, d)
    short = np.triu(rng.standard_normal((d, d)))
    short[:, d // 2 :] = 0
    near = equal @ np.diag(1 + 1e-13 * np.arange(d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    for r in (rng.standard_normal((d, d)) + 4 * np.eye(d), equal, graded, short, near):
        a, b, v = whitening.bidiagonal(r)
        s = np.linalg.svd(r, compute_uv=False) ** 2
        assert np.abs(whitening.dqds(a, b) - s).max() <= 1e-13 * s.max(initial=1e-300)
        e, z = whitening.solve(r, 16)
        w = r @ z / np.sqrt(e)
        assert np.abs(z.T @ z - np.eye(len(e))).max(initial=0) < 1e-10 and np.abs(w.T @ w - np.eye(len(e))).max(initial=0) < 1e-7


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal: values far under the largest one have all digits, which those of the product don't."""
    a, b = np.array([1.0, 1e-5, 1e-10]), np.array([1.0, 1e-5])
    from fractions import Fraction

    det = Fraction(1)
    for x in a:
        det *= Fraction(float(x)) ** 2
    got = whitening.dqds(a, b)
    assert math.isclose(float(det), math.prod(got.tolist()), rel_tol=1e-14)


def plain_margin(trees, row):
    total = trees.base
    for t in range(len(trees.leaf)):
        place = 0
        while place < trees.feature.shape[1]:
            place = 2 * place + (2 if row[trees.feature[t, place]] > trees.limit[t, place] else 1)
        total += trees.leaf[t, place - trees.feature.shape[1]]
    return total


def test_trees_learn_and_are_walked():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 6)).astype(np.float32)
    y = ((x[:, 1] > 0.2) ^ (x[:, 4] > -0.3)).astype(float)
    trees = boosting.grow(x[:2000], y[:2000])
    scores = trees.scores(x[2000:])
    assert ((scores > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(trees.margin(x[:50]), [plain_margin(trees, r) for r in x[:50]])


def test_first_split_is_the_best_one():
    """The root's split has the largest gain among all statistics and limits, told by a plain loop."""
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((120, 3)), 1).astype(np.float32)
    y = (x[:, 2] + 0.3 * rng.standard_normal(120) > 0.4).astype(float)
    trees = boosting.grow(x, y, trees=1, depth=1, bins=256)
    p = (y.sum() + 0.5) / 121
    g, h = p - y, np.full(120, p * (1 - p))

    def gain(f, v):
        left = x[:, f] <= v
        parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
        return sum(a * a / (b + boosting.PULL) for a, b in parts) if min(b for _, b in parts) >= boosting.LEAST else 0.0

    assert gain(trees.feature[0, 0], trees.limit[0, 0]) == pytest.approx(max(gain(f, v) for f in range(3) for v in np.unique(x[:, f])))


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = corpus.op13_quality_classifier(spark, d).toPandas()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    test = got[got.held_out & got.doc_id.isin(list(labels))]
    truth = test.doc_id.map(labels)
    assert (test.predicted == truth).mean() > 0.95 and (test.predicted[truth == 0] == 0).mean() > 0.8


def test_held_out_labels_are_never_read(spark):
    d, label = docs(spark, [(i, f"text {i} " * (i % 7 + 1)) for i in range(200)]), "doc_id long, quality int, x string"
    told = [(i, int(i % 7 > 2), "") for i in range(200)]
    turned = [(i, 1 - q if held else q, "") for (i, q, _), held in zip(told, [r[0] for r in spark.createDataFrame(told, label).orderBy("doc_id").select(boosting.fold() == 0).collect()])]
    a, b = (sorted(map(tuple, boosting.score_quality(d, spark.createDataFrame(t, label)).collect())) for t in (told, turned))
    assert told != turned and a == b


def test_classifier_on_odd_rows(spark):
    label = "doc_id long, quality int, text string"
    rows = [(i, "good plain words here. " * 9 if i % 2 else "## || %% " * 30) for i in range(60)] + [(None, "x"), (3, "good plain words here. " * 9), (70, None), (71, ""), (72, "long " * 300_000)]
    labels = spark.createDataFrame([(i, i % 2, "") for i in range(60)] + [(None, 1, ""), (4, None, ""), (5, 7, ""), (6, 1, ""), (999, 0, "")], label)
    got = boosting.score_quality(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True] and len({r.score for r in got if r.doc_id in (70, 71)}) == 1
    none = spark.createDataFrame([], label)
    assert {r.score for r in boosting.score_quality(docs(spark, rows), none).collect()} == {0.5}
    assert boosting.score_quality(docs(spark, []), labels).count() == 0
    some = boosting.train(boosting.statistics(docs(spark, rows)), labels, max_rows=10)
    assert 0 < some.scores(np.zeros((1, len(boosting.NAMES)), np.float32))[0] < 1
