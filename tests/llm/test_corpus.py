"""The corpus operators against brute force, round trips and held-out rows, with nulls, ties, empty tables and odd columns."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflow.llm import decontam, lines, minhash, mixing, quality, sharding, suffix, tokens, toxicity, urls
from courtflow.llm.common import components, numbered
from courtflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, v int, h string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_suffix(texts, n):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = True
            seen.add(b[p : p + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[:-1] & ~np.roll(gone, 1)[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 60))) for _ in range(20)]
    texts = ["".join(rng.choice(base) for _ in range(rng.randint(0, 4))) for _ in range(50)] + [None, "", "ab" * 40, "ab" * 40]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_substrings(docs(spark, texts), 12, 4).collect()}
    assert got == brute_suffix(texts, 12)
    assert suffix.dedup_substrings(empty(spark), 12, 4).count() == 0


def test_suffix_at_production_lengths(spark):
    """Passages of all lengths around 100 bytes, at the setting of the query."""
    rng = random.Random(11)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(60, 260))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            i = rng.randint(0, 40)
            parts += ["".join(rng.choices("xyz", k=rng.randint(0, 50))), p[i : len(p) - rng.randint(0, 40)]]
        texts.append("".join(parts))
    texts += ["ab" * 300, "ba" * 290, "a" * 99, "a" * 100, "a" * 101, "q" * 5000, None, "", texts[0]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_substrings(docs(spark, texts)).collect()}
    assert got == brute_suffix(texts, 100)


def test_suffix_with_null_and_repeated_ids(spark):
    long = "the quick brown fox jumps"
    rows = [(None, long), (2, long), (2, long), (1, "x" + long), (3, long[:5])]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).select("doc_id", "n_bytes", "n_removed", "n_spans").collect())
    assert got == [(-1, 25, 0, 0), (1, 26, 0, 0), (2, 25, 25, 1), (2, 25, 25, 1), (3, 5, 0, 0)]


def test_suffix_pieces_of_long_texts(monkeypatch):
    data = bytes(random.Random(5).choices(b"ab", k=400))
    whole = sorted(p for s, n, *_ in zip(*suffix.runs_of(data, 12, 4)) for p in range(s, s + n))
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    parts = sorted(at + p for at, piece in suffix.segments(data, 12) for s, n, *_ in zip(*suffix.runs_of(piece, 12, 4)) for p in range(s, s + n))
    assert whole == parts == list(range(389))


def brute_near(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_duplicates(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "One two", "one TWO", "one"]
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.randint(30, 80))
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                del copy[rng.randrange(len(copy))]
            texts.append(" ".join(copy))
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), words, percent).collect()}
        assert got == brute_near(texts, words, percent)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    """Mutated copies of one text, far from its central one in part, with copies of copies, by way of long lists."""
    monkeypatch.setattr(minhash, "SHORT_LIST", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    texts, pool = [" ".join(base)], [base]
    for _ in range(260):
        w = list(rng.choice(pool) if rng.random() < 0.3 else base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
        w = w[: rng.randint(140, 160)]
        if len(pool) < 8:
            pool.append(w)
        texts.append(" ".join(w))
    want = brute_near(texts, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 5


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f g"), (7, "a b c d e f g"), (5, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    got = sorted((r.doc_id or -1, r.n_shingles or -1, r.component_id or -1, r.kept) for r in out)
    assert got == [(-1, -1, -1, True), (4, 7, 4, True), (4, 7, 4, True), (5, -1, 5, True), (7, 7, 4, False)]


def test_near_duplicates_on_one_boilerplate(spark):
    # pairs of 85 and 84 words on a hub of 100, of which they have 77: the second is too short to be held against the hub
    rng = random.Random(8)
    hub = [f"h{i}" for i in range(100)]
    texts = [" ".join(hub)]
    for i in range(250):
        y = rng.sample(hub, 77) + [f"n{i}_{j}" for j in range(8)]
        texts += [" ".join(y), " ".join(rng.sample(y, 84))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), 1, 85).collect()}
    assert got == brute_near(texts, 1, 85)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (7, 3), (None, 4)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8}
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}


def test_numbering_has_no_gaps(spark):
    rows = spark.createDataFrame([("a", i % 5) for i in range(50)] + [("b", None)], "k string, o long")
    got = numbered(rows, ["k"], "o", "n", buckets=3).collect()
    assert sorted(r.n for r in got if r.k == "a") == list(range(50)) and [r.n for r in got if r.k == "b"] == [0]


def brute_stats(t):
    w = (t or "").encode().split()
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(three) if three.count(x) > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_quality(spark):
    rng = random.Random(2)
    words = ["der", "die", "das", "über", "#x", "a*"]
    texts = [None, "", "a b c a b c", "x\n x\nx\n\n\nx"] + [" ".join(rng.choices(words, k=rng.randint(1, 30))).replace("das", "\n") for _ in range(40)]
    for t in texts:
        assert quality.text_stats(t) == brute_stats(t), t
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(80, 200))) for _ in range(300)]
    junk = [" ".join("".join(rng.choices("abcdefgh", k=6)) + "###" for _ in range(100)) for _ in range(6)]
    got = {r.doc_id: r.kept for r in quality.quality(docs(spark, clean + junk)).collect()}
    assert sum(got[i] for i in range(300)) >= 298 and not any(got[i] for i in range(300, 306))
    nulls = spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.kept, r.base_failed) for r in quality.quality(nulls).collect()] == [(False, True)]
    assert quality.quality(empty(spark)).count() == 0


def test_models_against_all_halves(spark):
    """The least determinant over all subsets of a small group's rows, and the same outliers."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (12, 5)) * [2, 0.3, 0.5, 0.2, 0.3] + 4
    x[9:] += [9, 2, 3, 1, 2]
    rows = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = quality._models(rows, 12).first()

    def model(pick):
        cov = np.cov(x[list(pick)].T, bias=True) * 2 + np.diag(np.square(quality.FLOORS))
        return np.linalg.slogdet(cov)[1], x[list(pick)].mean(0), np.linalg.inv(cov)

    size = int(np.ceil(quality.HALF * 12))
    _, mean, inv = min((model(p) for p in combinations(range(12), size)), key=lambda m: m[0])
    far = lambda m, i: [float((r - m) @ i @ (r - m)) for r in x]
    want, have = far(mean, inv), far(np.array(got.mean), np.array(got.inv).reshape(5, 5))
    assert got.n == 12 and np.allclose(want, have, rtol=0.25, atol=0.5)
    assert sorted(np.argsort(have)[-3:]) == sorted(np.argsort(want)[-3:]) == [9, 10, 11]
    assert rows.select(F.count("*")).first()[0] == 12


def test_quality_judges_small_groups(spark):
    rng = random.Random(7)

    def text(tail=""):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8) if not tail else 6)) + tail for _ in range(rng.randint(80, 200)))

    # sources of 10 rows; a language of 60 rows, and one of 5, with junk in each
    rows = [(i, text(), "en", f"s{i // 10}") for i in range(60)] + [(100 + i, text("###"), "en", f"s{i}") for i in range(3)]
    rows += [(200 + i, text(), "xx", "t") for i in range(4)] + [(300, text("###"), "xx", "t")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 68 and all(r.distance2 is not None for r in got.values())
    assert not any(got[i].kept for i in (100, 101, 102, 300)) and sum(r.kept for r in got.values()) >= 63


def test_resharding(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 5000), 0 if i % 3 else rng.randrange(6)) for i in range(300)]
    got = sharding.reshard(spark.createDataFrame(rows, "doc_id long, size long, old_shard int"), 6).collect()
    assert len(got) == 300
    for j in range(6):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(50))
    # staying rows are as many as can stay, and the least bytes move: each shard's surplus, smallest rows first
    stay = sum(not r.moved for r in got)
    assert stay == sum(min(50, sum(o == j for _, _, o in rows)) for j in range(6))
    least = sum(sum(sorted(s for _, s, o in rows if o == j)[: max(0, sum(o == j for _, _, o in rows) - 50)]) for j in range(6))
    assert sum(r.size for r in got if r.moved) == least
    assert sharding.reshard(spark.createDataFrame([], "doc_id long, size long, old_shard int"), 6).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_resharding_moves_the_least_bytes(spark, seed):
    """Extra places, ties, drained and null old shards, against all choices of the shards that get an extra place."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([5, 5, 9, 40, 700]), rng.choice([0, 0, 0, 1, 1, 2, 7, None])) for i in range(43 + seed)]
    got = sharding.reshard(spark.createDataFrame(rows, "doc_id long, size long, old_shard int"), 4).collect()
    base, extras = divmod(len(rows), 4)
    by = {j: sorted(s for _, s, o in rows if o == j) for j in range(4)}
    gone = sum(s for _, s, o in rows if o is None or o > 3)
    best = min(gone + sum(sum(by[j][: max(0, len(by[j]) - base - (j in more))]) for j in range(4)) for more in combinations(range(4), extras))
    counts = sorted(sum(r.shard == j for r in got) for j in range(4))
    assert counts == [base] * (4 - extras) + [base + 1] * extras and len(got) == len(rows)
    assert sum(r.size for r in got if r.moved) == best


def test_resharding_query_keeps_null_and_repeated_ids(spark, tmp_path):
    from courtflow.llm.queries import op5_resharding

    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(40)] + [(None, "n", "s0"), (None, "m", None), (7, "again", "s1"), (7, "t7", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_resharding(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text_crc32) for r in got) == sorted((str(i), zlib.crc32(t.encode())) for i, t, _ in rows)
    assert len({(r.shard, r.slot) for r in got}) == 44


def test_shards_are_rewritten(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"text {i}" * rng.randint(1, 9), 9 if i > 54 else 0 if i % 2 else i % 3) for i in range(60)]
    path = str(tmp_path / "shards")
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    before = spark.read.parquet(path)
    sizes = before.selectExpr("doc_id", "octet_length(text) as size", "shard as old_shard")
    placed = sharding.reshard(sizes, 4)
    assert sharding.rewrite_shards(placed, before.select("doc_id", "text"), path) == [9]
    after = spark.read.parquet(path).where("shard <> 9")
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t, _ in rows} and after.count() == 60
    counts = [r.n for r in after.groupBy("shard").agg(F.count("doc_id").alias("n")).collect()]
    assert counts == [15] * 4
    for bad in ([(None, 1, 0)], [(1, 1, 0), (1, 2, 0)]):
        with pytest.raises(ValueError):
            sharding.rewrite_shards(sharding.reshard(spark.createDataFrame(bad, "doc_id long, size long, old_shard int"), 4), before, path)


def test_min_cost_flow_takes_the_cheap_way():
    arcs = [(0, 1, 5, 1), (0, 2, 5, 3), (1, 3, 3, 1), (2, 3, 9, 1), (1, 2, 9, 0)]
    assert sharding.min_cost_flow(4, arcs, 0, 3) == [5, 5, 3, 7, 2]


def test_lines(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", None, "", "z\nz\nz\nz\nz", "b\nc\nd"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: (4, 0, "a\nb\nc\nd"), 1: (6, 4, "x\ny"), 2: (1, 0, ""), 3: (1, 0, ""), 4: (5, 4, "z"), 5: (3, 3, "")}
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_lines_with_null_and_repeated_ids(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\ne"), (2, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (3, "q\nr\ns"), (3, "q\nr\ns"), (4, "q\nr\ns")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.text) for r in got) == sorted(
        [("1", 0, "a\nb\nc\nd"), ("2", 3, "e"), ("2", 3, "e"), ("None", 0, "a\nb\nc"), ("None", 0, ""), ("3", 0, "q\nr\ns"), ("3", 0, "q\nr\ns"), ("4", 3, "")]
    )


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"line {i % 4_000}" for i in range(9_000))
    got = lines.dedup_lines(docs(spark, [long, "line 0\nline 1"])).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed) for r in got] == [(9_000, 5_000), (2, 0)]


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {str(i): 1.0 / (i + 1) for i in range(40)}])
def test_schedule_lags_under_a_block(weights):
    quota = mixing.quotas(weights, 500)
    plan = mixing.schedule(quota)
    assert len(plan) == 500 == sum(quota.values())
    got = dict.fromkeys(quota, 0)
    for slot, s, j, release, due in plan:
        assert release <= slot < due and j == got[s]
        got[s] += 1
        for x, p in quota.items():
            assert abs(got[x] - p * (slot + 1) / 500) < 1


def test_mix_is_whole(spark):
    texts = ["t"] * 200
    rows = mixing.mix(docs(spark, texts), {"s0": 3.0, "s1": 1.0}, block=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    inside = [r for r in rows if r.in_mix]
    assert abs(sum(r.source == "s0" for r in inside) - 0.75 * len(inside)) <= 8
    assert mixing.mix(empty(spark), mixing.tempered(empty(spark))).count() == 0


def test_mix_places_all_blocks_at_exact_weights(spark):
    # a small source runs dry early, weights of 1/3000 are under a slot of a thousand, and there are more sources than such slots
    rows = [(i, "big") for i in range(3000)] + [(10_000 + i, "half") for i in range(1500)] + [(20_000 + i, f"s{i}") for i in range(1200)]
    weights = {"big": 2.0, "half": 1.0} | {f"s{i}": 0.001 for i in range(1200)}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1, stretch=500).collect()
    assert sorted(r.slot for r in got) == list(range(5700)) and all(r.release <= r.slot < r.deadline for r in got)
    # until the first two are dry (at the same time) they have 2 and 1 of 4.2 slots
    for n in (1000, 4000):
        assert abs(sum(r.slot < n and r.source == "big" for r in got) - n * 2 / 4.2) < 1
        assert abs(sum(r.slot < n and r.source == "half" for r in got) - n / 4.2) < 1
    small = mixing.mix(spark.createDataFrame([(i, "a") for i in range(100)] + [(100, "b")], "doc_id long, source string"), {"a": 1.0, "b": 1.0}, block=4).collect()
    assert sorted({r.slot for r in small}) == list(range(26))


def test_pipeline_mixes_all_documents(spark):
    import corpus_pipeline as p

    rows = [(i, f"t{i}", "en", "a", 2) for i in range(40)] + [(99, "b", "en", "b", 1), (None, "n", "en", "a", 1), (3, "again", "en", "a", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, p.mixed(spark, frame, "").collect())) == sorted(map(str, frame.collect()))
    slots = {r.doc_id: r.slot for r in p.placed(frame).collect()}
    files = p.packed(spark, frame, "").orderBy("start").collect()
    order = [slots[r.doc_id] for r in files if r.doc_id is not None]
    assert len(files) == 43 and order == sorted(order)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 24, 31])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokens.unpack(data, bits, 1001) == ids).all() and (tokens.unpack(data, bits, 10, 333) == ids[333:343]).all()
    assert tokens.random_access(data, bits, 777) == ids[777]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["Hello world, it's 3 o'clock.", None, "", " lead", "trail ", "two  spaces", "a\n b \nc\n\nd", "ünï\u00a0cødé\u2028x", "tab\there", "é" * 50, "x\u0085 y \u180ez"] + ["word " * 30] * 3
    tokens.write_tokens(docs(spark, texts).repartition(3), str(tmp_path / "t"), tokenizer_path(), block_ids=40)
    got = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    for r, t in zip(got, texts, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokens.write_tokens(empty(spark), str(tmp_path / "e"), tokenizer_path())
    assert tokens.token_digest(spark, str(tmp_path / "e")).count() == 0


def test_token_files_keep_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["some text <|endoftext|> more", "a<|endoftext|>b", "<|endoftext|>", "half <|endof text|>", "after it"]
    tokens.write_tokens(docs(spark, texts), str(tmp_path / "t"), tokenizer_path())
    got = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    plain = Tokenizer.from_file(tokenizer_path())
    assert [r.ids for r in got] == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert got[0].ids == [11246, 2420, 220, 50256, 517, 0]


def test_urls(spark):
    rows = ["https://A.Example.ORG/es/1?x#y", "http://example.org/en/19", "http://b.org", "ftp://x.org/", None, "nonsense", "http://m.site.com/fr/2", "http://porno-tube.example.com/en/7", "http://daily-gazette.example.com/en/7", "http://?q", "x://y://z/p"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.fit(urls.labelled_urls(spark))).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][:3] == ("b.org", "", None) and got[3][2:] == ("org/", "allow")
    assert got[4][:3] == got[5][:3] == ("", "", None) and got[6][2:] == ("com/fr/", "allow")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "allow")
    assert got[9][:2] == ("", "") and got[10][:2] == ("y:", "//z/p")


def test_tiles_catch_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    texts = [f"x y {item} z", " ".join(["q", *w[6:], "and", *w[:6], "r"]), " ".join(w[:5]) + " no", None, "", item.upper()]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "one two three four five six seven")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_tiles) for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 1): (12, 1), (1, 1): (12, 2), (5, 1): (12, 1)}
    assert decontam.contaminated(docs(spark, texts), bench.limit(0)).count() == 0 == decontam.contaminated(empty(spark), bench).count()


def test_tiles_do_not_overlap():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ([rng.randint(1, 3) for _ in range(rng.randint(0, 20))] for _ in range(2))
        got = decontam.tiles(a, b, 3)
        assert [t[2] for t in got] == sorted((t[2] for t in got), reverse=True)
        for k in (0, 1):
            places = [p for t in got for p in range(t[k], t[k] + t[2])]
            assert len(places) == len(set(places))
        assert all(a[i : i + n] == b[d : d + n] for i, d, n in got)


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["river", "stone", "window", "garden", "letter", "silver", "market", "summer", "idea", "motor"]
    rows = []
    for i in range(900):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            words[5:7] = ["grumblefink", "snarkwad"]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(2001, "river gr0mblef1nk stone sn@rkw@d garden"[:0] + "river grumb1ef1nk stone sn@rkw@d", 1), (2002, None, 0), (2003, "", 0), (2004, "river s n a r k w a d and grumbleeefink", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.where("doc_id < 2000").select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table.drop("toxic"), labels).collect()}
    for i, _, toxic in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == toxic, (i, got[i])
    none = toxicity.score_toxicity(table.drop("toxic").limit(3), labels.limit(0)).collect()
    assert len(none) == 3 and not any(r.predicted for r in none)
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    # rows of null and repeated doc_ids are judged by their own texts
    odd = [(None, "river snarkwad stone grumblefink", 5), (None, None, 5), (7, "river stone", 5), (7, "snarkwad grumblefink stone", 5), (7, "river stone", 5)]
    frame = table.drop("toxic").withColumn("strength", F.lit(5)).unionByName(spark.createDataFrame(odd, "doc_id long, text string, strength int"))
    clean = toxicity.keep_clean(frame, labels, ["strength", "doc_id", "text"])
    assert clean.columns == ["strength", "doc_id", "text"]
    left = sorted((str(r.doc_id), str(r.text)) for r in clean.collect())
    assert left == sorted([(str(i), str(t)) for i, t, toxic in rows if not toxic] + [("None", "None"), ("7", "river stone"), ("7", "river stone")])
    assert toxicity.keep_clean(empty(spark), labels, ["doc_id"]).count() == 0


def brute_decode(word, model):
    """The best of all readings of a short word, one by one."""
    from itertools import product

    options = []
    for i, c in enumerate(word):
        o = [(x, toxicity._SWAP) for x in toxicity.LOOKALIKES.get(c, "")]
        if c.isalpha():
            o.append((c, 0.0))
        elif c in toxicity.SEPARATORS or not o:
            o.append(("", toxicity._SKIP))
        if i and c == word[i - 1]:
            o.append(("", toxicity._SQUEEZE))
        options.append(o)
    best = {}
    for pick in product(*options):
        text = "".join(x for x, _ in pick)
        score, a, b = sum(p for _, p in pick), 0, 0
        for c in text:
            k = toxicity._CODE.get(c, 1)
            score += float(model[a, b, k])
            a, b = b, k
        best[text] = max(score + float(model[a, b, 0]), best.get(text, -1e9))
    return best


def test_decoding_equals_the_best_of_all_readings(spark):
    model = toxicity.character_model(docs(spark, ["hello world, the silly letters roll along", "all is well in the tall hall"] * 3))
    for word in ("h3ll0", "w.o.r.d", "t4lll", "5!lly", "the||e", "ааб3", "x", "11a"):
        every = brute_decode(word, model)
        got = toxicity.decode(word, model)
        assert every[got] >= max(every.values()) - 1e-4, (word, got)


def test_words_of_any_length_are_decoded(spark):
    model = toxicity.character_model(docs(spark, ["please grumble and mumble all day"] * 5))
    assert toxicity.disguised("grumble" + "e" * 100) and toxicity.decode("grumble" + "e" * 100, model) == "grumble"
    assert toxicity.disguised("5h1p") and toxicity.features("ab") and toxicity.features("a" * 5000)
    assert toxicity.raw_words("a b") == ["a", "b", "ab"]


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, frame, d)
        assert out.columns == frame.columns, name
    assert p.run(spark, d).count() > 0


def test_linked_sets_have_equal_parts():
    rng = np.random.default_rng(0)
    linked = 0
    for percent in (80, 85, 95):
        for _ in range(1500):
            n = int(rng.integers(1, 300))
            pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            both, a, b = int(rng.integers(1, n + 1)), int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
            if both + a + b > len(pool) or 100 * both < percent * (both + a + b):
                continue
            p = rng.permutation(len(pool))
            x, y = np.sort(pool[p[: both + a]]), np.sort(np.concatenate((pool[p[:both]], pool[p[both + a : both + a + b]])))
            for keys in (minhash.part_keys, minhash.band_keys) if linked % 20 == 0 else (minhash.part_keys,):
                assert len(np.intersect1d(keys(x, percent), keys(y, percent)))
            linked += 1
    assert linked > 500


def excerpts(n, seed):
    """A text of 120 sentences and ``n`` texts of a random half of them, of which some have near copies."""
    rng = random.Random(seed)
    said = [" ".join(f"w{rng.randrange(3000)}" for _ in range(12)) for _ in range(120)]
    texts = [" ".join(said)]
    for i in range(n):
        some = [s for s in said if rng.random() < 0.5]
        texts.append(" ".join(some))
        if i % 20 == 0:
            texts.append(" ".join(some[:-2]))
    return texts


def test_excerpts_of_one_text_are_not_all_compared(spark, monkeypatch):
    counts, rates = [], []
    plain = minhash._links

    def counted(pairs, *more):
        counts.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(minhash, "_links", counted)
    monkeypatch.setattr(minhash, "SHORT_LIST", 6)
    for n, exact in ((60, True), (250, False)):
        texts = excerpts(n, n)
        sets = [set(minhash.shingle_hashes(t, 3).tolist()) for t in texts]
        want = list(range(len(texts)))
        for i, j in combinations(range(len(texts)), 2):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if c == b else c for c in want]
        counts.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts), 3, 85, exact=exact).collect()}
        assert got == dict(enumerate(want)) and len(set(want)) < len(texts)
        rates.append(sum(counts) / len(texts))
    print(rates)
    assert max(rates) < 45


def test_url_model_on_words_it_was_not_given(spark):
    """Held-out words: few allowed urls are blocked at the threshold, and part of the unwanted ones is found by what words share."""
    weights = urls.fit(urls.labelled_urls(spark, held_out=False))
    p = urls.score(urls.host_of(F.col("url")), urls.path_of(F.col("url")), weights)
    for held_out, found, false in ((False, 0.99, 0.001), (True, 0.4, 0.02)):
        rows = urls.labelled_urls(spark, held_out).select("label", (p >= 0.9).cast("double").alias("b")).groupBy("label").agg(F.avg("b").alias("b")).collect()
        share = {r.label: r.b for r in rows}
        assert share[1] > found and share[0] < false


def test_url_filter_on_odd_tables(spark):
    kind = "page_id long, url string, host string, verdict string"
    rows = [(1, "http://free-casino.example.net/x", "h", "v"), (1, "http://free-casino.example.net/x", "h", "v"), (None, None, "h", "v"), (2, "", None, None), (3, "http://" + "a" * 30_000 + ".net/" + "b" * 30_000, "h", "v")]
    table = spark.createDataFrame([("http://casino.net/", 1), ("http://garden.net/", 0), (None, 1), ("x", None), ("http://casino.net/", 1)], "url string, label int")
    weights = urls.fit(table)
    got = urls.judge_urls(spark.createDataFrame(rows, kind), weights, threshold=0.5).collect()
    assert len(got) == 5 and [r.verdict for r in got if r.page_id == 1] == ["block"] * 2 and {r.host for r in got if r.page_id in (None, 2)} == {""}
    assert urls.judge_urls(spark.createDataFrame([], kind), weights).count() == 0
    for given, told in (([], "allow"), ([("http://a.net/", 1)], "block"), ([("http://a.net/", 0)], "allow")):
        some = urls.fit(spark.createDataFrame(given, "url string, label int"))
        assert {r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, kind), some).collect()} == {told}
