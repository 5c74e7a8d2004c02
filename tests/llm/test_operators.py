"""Every corpus operator against brute force, on rows with nulls, empty and very long texts, repeats and clashing columns."""

import collections
import glob
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import licences, mixing, neardup, neighbours, packing, quality, rangecoder, scoring, sharding, tokenfile, toxicity
from sparkloom.llm.common import SHORT_SHUFFLES, materialize
from sparkloom.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"kept": 1, "size": "x", "rep": 2, "component": 3, "shard": 4, "score": 0.5, "part": 9, "path": "p", "word": "w", "n_words": 7, "topic": "t", "uid": 1, "key": 5, "chunk": 2}


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def edge_rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base = prose(120)
    near = " ".join(["changed", *base.split()[1:]])
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, " \t\n ", "de", "b"), (7, "one two three", "fr", "b"),
            (8, "One Two Three", "fr", "b"), (9, "é" * 30 + "   x\n\ny  z", "fr", "c"), (10, prose(30_000), "en", "a"), (None, prose(60), "en", "a"), (None, None, None, None),
            (11, "\n".join(["same line here"] * 40), "en", "a"), (12, prose(90) + "\nReleased under the MIT License.", "en", "a"), (13, "Released under the MIT License.", "en", "lib"), (14, prose(70), "en", "lib")]
    rows += [(20 + i, prose(60 + i), "en" if i % 3 else "es", "hot") for i in range(60)]
    rows += [(90, rows[-1][1], "en", "hot"), (90, rows[-1][1], "en", "hot")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    for name, value in CLASHES.items():
        df = df.withColumn(name, F.lit(value))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows):
    return collections.Counter(r[0] for r in rows)


def test_quality_counts_and_verdict(docs, empty):
    rows = quality.judge(docs, columns=["doc_id", "text", "kept", "size"]).collect()
    texts = {r[0]: r[1] for r in edge_rows() if r[0] is not None}
    assert len(rows) == len(edge_rows())
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]] or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        places = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(places) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert {r["doc_id"] for r in rows if r["kept"]} >= {1, 2, 3, 14}
    assert quality.judge(empty).count() == 0


def test_quality_em_separates_failure_modes(spark):
    good, junk = [-1] * 8, [-1, 1, 1, -1, -1, -1, -1, -1]
    df = spark.createDataFrame([(*good, 900), (*junk, 60)], ", ".join(f"v_{r} int" for r in quality.RULES) + ", n long")
    rates, prior = quality.fit(df)
    out = df.select("n", quality.posterior_good(rates, prior).alias("p")).collect()
    assert {r["n"]: r["p"] > 0.5 for r in out} == {900: True, 60: False}


def test_near_duplicates_match_brute_force(docs, empty):
    rows = neardup.near_duplicates(docs).collect()
    sets = {}
    for i, t, *_ in edge_rows():
        w = words(lower(t))
        sets.setdefault(i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(rows) == len(edge_rows())
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), r["doc_id"] == find(r["doc_id"]))
    assert neardup.near_duplicates(empty).count() == 0


def test_unsettled_buckets_find_links_that_miss_the_leader(spark):
    """A middle document links two that are too far apart; whichever leads a bucket, all three are one component."""
    base = [f"t{i}" for i in range(100)]
    left, right = ["l", *base[1:]], [*base[:-1], "r"]
    far = ["l", "m", *base[2:-2], "n", "r"]
    texts = [" ".join(x) for x in (left, base, right, far)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got[0] == got[1] == got[2] == 0


def test_fast_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    items = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    a, b = items[:1000], items[200:1200]
    out = neardup.fast_sketch(np.array([len(a), len(b), 1]), np.concatenate([a, b, a[:1]]), 512)
    assert (out != np.uint64(2**64 - 1)).all()
    assert abs((out[0] == out[1]).mean() - 800 / 1200) < 0.08


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(99, 98)], "a long, b long")
    got = dict(connected_components(chain).collect())
    assert {got[i] for i in range(10, 41)} == {10} and got[99] == got[98] == 98


def test_sharding_is_even_and_keeps_groups(docs, empty):
    rows = sharding.assign(docs, 5).collect()
    texts = {r[0]: r[1] for r in edge_rows()}
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(edge_rows()) and max(sizes.values()) - min(sizes[s] for s in range(5)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert sharding.assign(empty).count() == 0


def test_sharding_spreads_a_hot_group(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}", None, None, 0) for i in range(240)], SCHEMA)
    rows = sharding.assign(df, 24).collect()
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {10}


def encoded(name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], np.uint32)


def test_propagation_cuts_few_groups(spark):
    """Groups of 2 to 8 and single texts: all but a few groups lie in one shard, and shards stay even."""
    rng = np.random.default_rng(1)
    texts = [t for g in range(300) for t in [f"group {g}"] * int(rng.integers(2, 9))] + [f"single {i}" for i in range(300)]
    placed = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    sizes = collections.Counter(r["shard"] for r in placed.collect())
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    found = sharding.cut_links(placed).first()
    assert found["groups"] == 300 and found["split_groups"] <= 30 and found["cut"] <= 60


def test_packing_covers_every_id_once(docs, empty):
    encode, rows = encoded("word_bpe_49k.json", 2), packing.pack(docs).collect()
    pieces, sequences = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] not in (None, 90):
            pieces[r["doc_id"]].add((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, t, *_ in edge_rows():
        if i in (None, 90):
            continue
        ids, at = encode(t), 0
        for start, n, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start:start + n].tobytes())
            at += n
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    total = sum(len(encode(t)) for _, t, *_ in edge_rows())
    assert sum(r["length"] for r in rows) == total and len(sequences) <= math.ceil(total / packing.LENGTH) + 1
    assert packing.pack(empty).count() == 0


def test_cutting_stock_meets_demand():
    demand, sizes = np.array([0, 7, 13, 0, 5, 40]), np.array([10, 22, 35, 40, 51, 64])
    found = packing.cutting_stock(demand, sizes, 128)
    assert all((p * sizes).sum() <= 128 for p, _ in found)
    assert (sum(p * n for p, n in found) >= demand).all()
    assert sum(n for _, n in found) <= math.ceil((demand * sizes).sum() / 128) + 4
    assert packing.cutting_stock(np.zeros(6, int), sizes, 128) == []


def test_token_files_round_trip(docs, empty, spark, tmp_path):
    folder = str(tmp_path / "ids")
    tokenfile.write_ids(docs, folder)
    rows = tokenfile.read_ids(spark, folder).orderBy("start").collect()
    encode = encoded("byte_bpe_50k.json", 0)
    texts = {r[0]: r[1] for r in edge_rows()}
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert [r["doc_id"] for r in rows][:2] == [None, None] and known == sorted(known)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = encode(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    tokenfile.write_ids(empty, str(tmp_path / "none"))
    assert tokenfile.read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000, 40_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.zipf(1.5, n) % 50_257, np.zeros(n, int)):
        ids = ids.astype(np.uint32)
        assert np.array_equal(rangecoder.decode(rangecoder.encode(ids)), ids)


def test_range_coder_sees_damage():
    block = bytearray(rangecoder.encode(np.arange(3000, dtype=np.uint32) % 700))
    block[len(block) // 2] ^= 4
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(block))
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(block[:-2]))


def test_toxicity_learns_from_positive_and_unlabelled(spark, docs, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 40))
        bad = i % 8 == 0
        if bad:
            w[int(rng.integers(40))] = str(rng.choice(["nasty", "vileness", "vilest"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(spark.createDataFrame(rows, SCHEMA), labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    edge = toxicity.score(docs, labels).collect()
    assert len(edge) == len(edge_rows())
    assert len({r["score"] for r in edge if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity.score(docs, labels.filter("false")).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, labels).count() == 0


def test_pu_risk_and_its_gradient():
    """The gradients against differences of the risks, the risks against their definition, and learning against its start."""
    rng = np.random.default_rng(7)
    p, u = ([sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)] for n in (30, 80))
    theta, prior = np.append(rng.random(6) * 2, -1.0), 0.2
    plus, minus, g_plus, g_minus = toxicity.risks(theta, toxicity.flat(p), toxicity.flat(u), prior)
    z = lambda lists: np.array([theta[-1] + toxicity.evidence(sum(theta[i] for i in d)) for d in lists])
    assert plus == pytest.approx(prior * np.log1p(np.exp(-z(p))).mean())
    assert minus == pytest.approx(np.log1p(np.exp(z(u))).mean() - prior * np.log1p(np.exp(z(p))).mean())
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        up, down = (toxicity.risks(theta + s, toxicity.flat(p), toxicity.flat(u), prior) for s in (step, -step))
        assert g_plus[i] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6) and g_minus[i] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-6)
    # Input 0 marks positives, input 1 comes with all texts alike: learning separates held-out rows, which the start cannot.
    draw = lambda bad, n: [([0] if bad and rng.random() < 0.9 else []) + ([1] if rng.random() < 0.5 else []) for _ in range(n)]
    weights, bias = toxicity.fit(draw(True, 200), draw(True, 80) + draw(False, 320), 2, prior)
    score = lambda lists: toxicity.sigmoid(bias + toxicity.evidence(np.array([sum(weights[i] for i in d) for d in lists])))
    assert weights[0] > 2 and weights[1] < 0.5
    assert (score(draw(True, 100)) >= 0.7).mean() > 0.8 and not (score(draw(False, 100)) >= 0.7).any()


def test_toxicity_counts_documents_and_copies_once(spark):
    """A fixed phrase of ordinary neighbours is learnt from many documents; a word of one document's copies is not."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        w, bad = list(rng.choice([f"v{k}" for k in range(300)], 40)), i % 8 == 0
        if bad:
            at = int(rng.integers(40))
            w[at:at + 1] = ["go", "rotten", "vermin"]
        elif i % 2:
            w[0] = "go"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    copied = "copyword " + " ".join(f"c{k}" for k in range(60))
    for i in range(2000, 2060):
        rows.append((i, copied + f" z{i}"))
        labels.append((i, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, weights, bias = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"w:rotten", "w:vermin"} <= set(names) and "w:copyword" not in names and "w:go" not in names


def test_scores_and_base(docs, empty):
    rows = scoring.score(docs, chunk_bytes=100_000).collect()
    counts, ends = collections.Counter(), 0
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    for i, t, *_ in edge_rows():
        if trains(i):
            counts.update(words(lower(t)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    texts = {r[0]: r[1] for r in edge_rows()}
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r["train_tokens"] == n and r["held_out"] != trains(r["doc_id"]) and r["score"] < 0
        if r["doc_id"] is not None:
            w = words(lower(texts[r["doc_id"]]))
            assert (r["n_tokens"], r["n_known"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1)
            assert r["base_score"] == pytest.approx(sum(base(counts[x]) for x in w) + base(ends))
    assert scoring.score(empty).count() == 0


def test_long_unseen_words_cost_all_their_bits(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(["some", "words", "of", "a", "short", "list"], n))
    long = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, prose(80), "en", "a", 0) for i in range(60) if i not in held] + [(held[0], long(1_000), "en", "a", 0), (held[1], long(100_000), "en", "a", 0)]
    got = {r["doc_id"]: r["score"] for r in scoring.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[held[1]] < -50_000 and 60 < got[held[1]] / got[held[0]] < 140


def repeated_corpus():
    """Texts of a small language with fixed phrases; half of the held-out ones also occur among the training texts."""
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(800)]
    weights = 1 / np.arange(1, 801)
    phrases = [list(rng.choice(words, 6)) for _ in range(30)]
    rows = []
    for i in range(300):
        text = []
        while len(text) < 120:
            text += phrases[rng.integers(30)] if rng.random() < 0.3 else [rng.choice(words, p=weights / weights.sum())]
        rows.append((i, " ".join(text), "en", "a", 0))
    texts = dict((r[0], r[1]) for r in rows)
    return rows + [(1000 + i, texts[i], "en", "a", 0) for i in range(0, 300, 10)], {*range(0, 300, 10), *range(1000, 1300, 10)}


def test_mixing_beats_the_base_and_tells_copies_apart(spark):
    rows, twice = repeated_corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in scoring.score(df, chunk_bytes=50_000).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] not in twice]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
    once = sorted(r["bits_per_byte"] for i, r in got.items() if i not in twice)
    known = [r["bits_per_byte"] for i, r in got.items() if i in twice and zlib.crc32(str(i % 1000).encode()) % 7 != 2 and zlib.crc32(str(i % 1000 + 1000).encode()) % 7 != 2]
    assert len(known) > 20 and sorted(known)[len(known) // 2] < once[len(once) // 20]
    fixed = {r["doc_id"]: r["score"] for r in scoring.score(df, chunk_bytes=50_000, fixed=0.5).collect()}
    assert sum(fixed[r["doc_id"]] for r in held) < sum(r["score"] for r in held) - 0.02 * sum(r["n_tokens"] for r in held)
    again = {r["doc_id"]: r["base_score"] for r in scoring.score(df.repartition(2)).collect()}
    assert all(abs(again[i] - r["base_score"]) < 1e-6 for i, r in got.items())


def test_shuffle_files_go_with_the_table_that_needed_them(spark):
    kept = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/blockmgr-*/*/shuffle_*.data"))
    before = kept()
    table = materialize(spark.range(1000).repartition(3, "id"), "short", True)
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before and table.count() == 1000 and spark.conf.get(SHORT_SHUFFLES) == "false"


def test_texts_with_and_without_their_own_counts_share_their_places():
    rng = np.random.default_rng(5)
    counts, cost = rng.integers(0, 50, (40, 2)).astype(np.uint32), np.log10(rng.uniform(1e-6, 1e-2, 40)).astype(np.float32)
    cost[3] = -400.0  # below the least float
    totals = scoring.Totals([4, 3], counts.sum(axis=0).tolist(), (counts > 0).sum(axis=0).tolist(), 40)
    lengths, tokens = np.array([30, 1, 50]), rng.integers(0, 41, 81)
    tokens[[29, 30, 80]] = 40
    c = rng.integers(0, 5, 81).astype(np.uint32)
    given = lengths, tokens, 40, counts, cost, c, c + rng.integers(0, 5, 81).astype(np.uint32), np.array([0, -1, 1]), totals
    mixer = scoring.Mixer()
    mixer.vector[:] = rng.gamma(1.0, 3.0, len(mixer.vector))
    own = scoring.Texts(*given, True)
    for texts, alike in ((scoring.Texts(*given, False), scoring.Texts(*given, False, None, own)), (own, scoring.Texts(*given, True, scoring.Words(counts, cost, totals)))):
        assert mixer.run(texts) == pytest.approx(mixer.run(alike), rel=1e-12)


def test_probabilities_of_the_next_token_sum_to_one():
    rng = np.random.default_rng(4)
    cost = np.log10(np.array([0.1, 0.02, 0.003, 0.2, 0.05]))
    cost = np.append(cost, np.log10(1 - (10**cost).sum())).astype(np.float32)  # the last stands for all words not seen in training
    counts = np.array([[5, 1], [3, 0], [0, 4], [2, 2], [1, 0], [0, 0]], np.uint32)
    totals = scoring.Totals([4, 3], counts.sum(axis=0).tolist(), (counts > 0).sum(axis=0).tolist(), 5)
    mixer = scoring.Mixer()
    mixer.vector[:] = rng.gamma(1.0, 3.0, len(mixer.vector))
    end, history = 6, [0, 2, 0, 1, 0, 2, 5]
    followers = {0: 3, 2: 1, end: 2}
    for n in (0, 6):
        total = 0.0
        for last in range(7):
            tokens = np.array([*history, last])
            zero = np.zeros(len(tokens), np.uint32)
            c, seen = zero.copy(), zero.copy()
            c[-1], seen[-1] = followers.get(last, 0) * (n > 0), n
            texts = scoring.Texts(np.array([len(tokens)]), tokens, end, counts, cost, c, seen, np.array([-1]), totals, False)
            total += np.exp(mixer.run(texts)[-1])
        # The word that stands for all unseen ones occurs in the text, so the text's own words may hold it as well.
        assert abs(total - 1) < 1e-6


def test_byte_codes_are_prefix_free():
    lengths, codes = scoring.byte_codes({97: 1000, 98: 10, 32: 500})
    assert sum(2.0 ** -n for n in lengths) == pytest.approx(1.0) and lengths[97] < lengths[200]
    assert len({format(c, f"0{n}b") for n, c in zip(lengths, codes)}) == 256


def test_neighbours_are_exact_on_small_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [1.0, None]), (None, rows[1][1]), (350, [1.0, 2.0]), (351, [2.0, 4.1]), (352, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)).withColumn("score", F.lit("x"))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = [(i, np.array(v)) for i, v in rows[:302]]
    for q in range(0, 301, 50):
        a = dict(usable)[q]
        near = sorted((-float(a @ v / np.sqrt(a @ a) / np.sqrt(v @ v)), i) for i, v in usable if i != q)[:5]
        assert len(set(i for i, _ in got[q]) & {i for _, i in near}) >= 4
    assert [i for i, _ in got[0]][:2] == [300, 301]
    assert [i for i, _ in got[350]] == [351] and got[350][0][1] == pytest.approx((2 + 8.2) / math.sqrt(5) / math.sqrt(4 + 4.1**2))
    assert not set(got) - set(range(0, 351, 50))
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_copies_and_extreme_vectors(spark):
    """A third of the rows are one vector; huge and tiny vectors have a cosine."""
    rng = np.random.default_rng(8)
    hot = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.standard_normal(8)]) for i in range(600)]
    rows += [(700, [1e200] * 8), (701, [1e-200] * 8), (702, [1e200] * 4 + [-1e200] * 4)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert got[0] == [(3, 1.0), (6, 1.0), (9, 1.0), (12, 1.0), (15, 1.0)] and got[150] == [(0, 1.0), *got[0][:4]]
    assert got[700][0] == (701, 1.0) and all(math.isfinite(s) for x in got.values() for _, s in x)


def test_neighbours_recall(spark):
    """Recall on the real table, and on 20,000 isotropic vectors."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng = np.random.default_rng(12)
    wide = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((20_000, 32)))], "vec_id long, embedding array<double>")
    for table, step in ((df, 50), (wide, 500)):
        rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect() if r["embedding"] is not None]
        rows = [(i, v) for i, v in rows if i is not None and np.isfinite(v).all() and v.any()]
        ids, units = np.array([i for i, _ in rows]), neighbours.unit_rows(np.stack([v for _, v in rows]))
        got = collections.defaultdict(set)
        for r in neighbours.nearest(table, F.col("vec_id") % step == 0).collect():
            got[r["query_id"]].add(r["vec_id"])
        hits = total = 0
        for q in np.flatnonzero(ids % step == 0).tolist():
            score = units @ units[q]
            score[ids == ids[q]] = -2
            near = set(ids[np.lexsort((ids, -score))[:5]].tolist())
            hits, total = hits + len(near & got[int(ids[q])]), total + len(near)
        assert hits >= 0.9 * total


def test_licences_and_inheritance(spark, docs, empty):
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = {r["doc_id"]: r for r in licences.scan(docs, path).collect()}
    assert (rows[12]["licence"], rows[12]["basis"]) == ("MIT", "header") and rows[13]["licence_file"]
    assert (rows[14]["licence"], rows[14]["basis"], rows[14]["inherited_from"]) == ("MIT", "inherited", "lib/en/13")
    assert rows[1]["basis"] == "none" and rows[4]["licence"] is None
    assert licences.scan(empty, path).count() == 0
    tree = spark.createDataFrame([("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/x", "nothing here"), ("a/d/y", "nor here"), ("e/z", "or here")], "p string, text string").withColumn("doc_id", F.col("p"))
    got = {r["path"]: r["licence"] for r in licences.scan(tree, F.col("p")).collect()}
    assert (got["a/b/c/x"], got["a/d/y"], got["e/z"]) == ("MIT", "Apache-2.0", None)


def test_a_common_licence_hides_none(spark):
    """A third of the rows carry one licence; its terms and those of rare licences still make candidates."""
    filler = lambda i: " ".join(f"x{i}y{k}" for k in range(30))
    hot, rare = "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY 4.0."
    rows = [(f"d{i}/f", filler(i) + (f"\n{hot}\n" if i % 3 == 0 else f"\n{rare}\n" if i == 1 else "\nnothing\n") + filler(-i)) for i in range(300)]
    df = spark.createDataFrame(rows, "p string, text string").withColumn("doc_id", F.col("p"))
    got = {r["path"]: (r["licence"], r["basis"]) for r in licences.scan(df, F.col("p")).collect()}
    assert got == {f"d{i}/f": ("GPL-3.0", "header") if i % 3 == 0 else ("CC-BY-4.0", "header") if i == 1 else (None, "none") for i in range(300)}


def test_licences_pass_from_the_root_and_over_wrapped_lines(spark):
    mit = "\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this software".split())
    df = spark.createDataFrame([("LICENSE", mit), ("a/b/x", "nothing here"), ("y", "nor here")], "p string, text string").withColumn("doc_id", F.col("p"))
    got = {r["path"]: (r["licence"], r["inherited_from"], r["licence_file"]) for r in licences.scan(df, F.col("p")).collect()}
    assert got == {"LICENSE": ("MIT", "LICENSE", True), "a/b/x": ("MIT", "LICENSE", False), "y": ("MIT", "LICENSE", False)}


def test_mixing_meets_targets(docs, empty):
    rows = mixing.mix(docs, keep=0.4).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["probability"] <= 1 for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.4 * total, rel=1e-3)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
    assert mixing.mix(empty).count() == 0


def test_sample_margins_are_raked_with_the_bound(spark):
    """A small source and a rare language ask for more than they have: they give all, and every other margin is met."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{rng.integers(99)}" for _ in range(rng.integers(55, 200))), str(rng.choice(["en", "de", "is"], p=[0.7, 0.29, 0.01])),
             str(rng.choice(["big", "mid", "tiny"], p=[0.8, 0.19, 0.01])), 0) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.margins(df, keep=0.4).collect()
    assert any(r["wanted"] > r["feasible"] + 1e-4 for r in found)
    assert all(abs(r["reached"] - r["feasible"]) < 1e-3 for r in found)
    out = mixing.mix(df, keep=0.4).collect()
    total = sum(r["n_tokens"] * r["probability"] for r in out)
    for m in ("source", "lang"):
        for r in (x for x in found if x["margin"] == m):
            mine = [x for x in out if x[m] == r["category"]]
            assert sum(x["n_tokens"] * x["probability"] for x in mine) / total == pytest.approx(r["reached"], abs=1e-6)
            assert sum(x["n_tokens"] for x in mine if x["selected"]) / sum(x["n_tokens"] for x in out if x["selected"]) == pytest.approx(r["reached"], abs=0.04)
    told = {m: spark.createDataFrame(v, f"_{m} string, share double") for m, v in (("source", [("big", 0.5), ("mid", 0.5)]), ("lang", [("en", 1.0)]), ("topic", [("prose", 1.0)]))}
    shares = {(r["margin"], r["category"]): r["wanted"] for r in mixing.margins(df, 0.3, targets=told).collect()}
    tokens = collections.Counter()
    for r in out:
        tokens[r["source"]] += r["n_tokens"]
    assert shares["source", "tiny"] == pytest.approx(tokens["tiny"] / tokens.total()) and shares["source", "big"] == pytest.approx(shares["source", "mid"])


def test_raking_on_spark_agrees_with_the_driver(spark):
    tokens, codes = np.array([500.0, 300, 20, 80, 40, 400]), [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])]
    goals = [mixing.feasible(np.array([0.3, 0.3, 0.4]), np.bincount(codes[0], tokens), 500.0), mixing.feasible(np.array([0.5, 0.5]), np.bincount(codes[1], tokens), 500.0)]
    assert goals[0][1] == 100 and sum(goals[0]) == pytest.approx(500)
    own = np.minimum(1, mixing.rake(tokens, codes, goals, np.full(6, 0.5)))
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(t)) for i, j, t in zip(*codes, tokens)], "source string, lang string, tokens double")
    targets = {m: spark.createDataFrame([(f"{k}{i}", float(x)) for i, x in enumerate(g)], f"_{m} string, share double")
               for m, k, g in (("source", "r", goals[0]), ("lang", "c", goals[1]))}
    for r in mixing.raked(cells, targets).collect():
        i = [f"r{a}c{b}" for a, b in zip(*codes)].index(r["source"] + r["lang"])
        assert min(1.0, r["factor"]) == pytest.approx(own[i], abs=1e-3)


def test_raking_matches_iterative_fitting(spark):
    seed = np.array([[40.0, 30, 20], [35, 50, 100], [10, 5, 60]])
    rows, cols = np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.3, 0.5])
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(seed[i, j])) for i in range(3) for j in range(3)], "source string, lang string, tokens double")
    targets = {"source": spark.createDataFrame([(f"r{i}", float(x)) for i, x in enumerate(rows)], "_source string, share double"),
               "lang": spark.createDataFrame([(f"c{i}", float(x)) for i, x in enumerate(cols)], "_lang string, share double")}
    x = seed.copy()
    for _ in range(200):
        x *= (rows / x.sum(axis=1))[:, None]
        x *= cols / x.sum(axis=0)
    for r in mixing.raked(cells, targets).collect():
        assert r["tokens"] * r["factor"] == pytest.approx(x[int(r["source"][1]), int(r["lang"][1])], abs=1e-4)


def test_equal_vectors_have_equal_scores_in_any_block(spark):
    rng = np.random.default_rng(4)
    hot, asked = rng.standard_normal(64), rng.standard_normal(64)
    for n in (7, 64, 599, 600, 601):
        rows = np.where((np.arange(n) % 3 == 0)[:, None], hot, rng.standard_normal((n, 64)))
        unit = neighbours.unit_rows(rows)
        ids, scores = neighbours.best_of(np.arange(n), rows, unit, np.arange(n), hot, neighbours.unit_rows(hot[None])[0], 5)
        same = np.arange(0, n, 3)[:5]
        assert ids[:len(same)].tolist() == same.tolist() and set(scores[:len(same)]) == {1.0}
        assert len(set(neighbours.cosines(rows[::3], asked).tolist())) == 1
    table = spark.createDataFrame([(i, [float(x) for x in (hot if i % 3 == 0 else rng.standard_normal(64))]) for i in range(599)] + [(900, [float(2 * x) for x in hot])], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0, shard_rows=97).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(3, 1.0), (6, 1.0), (9, 1.0), (12, 1.0), (15, 1.0)] and got[900][0] == (0, 1.0)


def test_each_run_of_letters_or_marks_is_spelled_once(monkeypatch):
    """Pieces share their words, marks and ends of lines; the ids are the tokenizer's own."""
    from sparkloom.llm import tokens

    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"), True)
    asked, spelled = [], encoder.spelled
    monkeypatch.setattr(encoder, "spelled", lambda run: asked.append(run) or spelled(run))
    pieces = [" Word", " Word,", "Word", " Word,\nWord,", " mañana", " mañana!!", " mañana\nWord", " Word.\nmañana,", "x1 y"]
    counts, ids = encoder.encoded(pieces)
    assert len(asked) == len(set(asked)) and encoder.encoded(pieces[:-1])[0].tolist() == counts[:-1].tolist() and len(asked) == len(set(asked))
    for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == encoder.tokenizer.encode(piece, add_special_tokens=False).ids
    # Places are found in the order of hashes and given back in that of the pieces.
    for some in (pieces[:4], pieces[::-1]):
        for piece, start, length in zip(some, *encoder.places(some)):
            assert encoder.ids[start:start + length].tolist() == encoder.tokenizer.encode(piece, add_special_tokens=False).ids


def test_range_coder_keeps_its_format():
    ids = (np.arange(60_000, dtype=np.uint64) ** 2 % 9973 % 611).astype(np.uint32)
    assert zlib.crc32(rangecoder.encode(ids)) == 2699400063


def test_a_chunk_reads_its_answers_once(monkeypatch):
    """Rows of answers grow with the buckets, so reading all of them for each of them would grow with the square."""
    lengths, tokens, hashes = np.array([9], np.uint32), np.arange(9, dtype=np.uint32) % 9, np.arange(1, 9, dtype=np.uint64) << np.uint64(60)
    blobs = [scoring.packed(x) for x in (lengths, tokens, hashes)]
    keys, _, inverse = scoring.gathered_contexts(lengths.astype(np.int64), tokens, hashes)
    seen = np.arange(len(keys), dtype=np.uint32) + 5
    rows = [[scoring.packed(np.array([3 * b, b], np.uint32)[:2 * (b < 8)]), scoring.packed(np.array([-b], np.float32)[:b < 8]), scoring.packed(seen[b:b + 1]), scoring.packed(seen[b:b + 1] * 2)] for b in range(9)]
    order = [4, 0, 8, 2, 1, 3, 7, 6, 5]
    found = pa.table({"chunk": pa.array([7] * 9), "bucket": pa.array(order, pa.int32()), "blobs": pa.array([rows[b] for b in order], pa.list_(pa.binary()))})
    chunks = pa.table({"chunk": pa.array([7]), "blobs": pa.array([blobs], pa.list_(pa.binary()))})
    calls, read = [], scoring.blobs_of
    monkeypatch.setattr(scoring, "blobs_of", lambda table: calls.append(table.num_rows) or read(table))
    out = scoring.joined(chunks, found)["blobs"].to_pylist()[0]
    assert sorted(calls) == [1, 9]
    assert scoring.unpacked(out[4], np.uint32).tolist() == seen[inverse].tolist() and scoring.unpacked(out[5], np.uint32).tolist() == (seen[inverse] * 2).tolist()
    assert scoring.unpacked(out[2], np.uint32).tolist() == [x for b in range(8) for x in (3 * b, b)] and scoring.unpacked(out[3], np.float32).tolist() == [-b for b in range(8)]


def test_bits_of_words_are_counted_whole(monkeypatch):
    """Counts of slots do not depend on how many bits are counted at once, nor on where a slice of words begins."""
    code = scoring.byte_codes({97: 5, 98: 2})
    words = pa.array([b"", b"ab", b"abba" * 40, b"b", "ñandú".encode(), b"zz"] * 7)
    want = collections.Counter()
    slots, bits, *_ = scoring.spelled(words.slice(3), code)
    for k, own in enumerate(slots.tolist()):
        want.update((k, slot, bit) for slot, bit in zip(own, bits.tolist()))
    for at_once in (1, 100, 10**6):
        monkeypatch.setattr(scoring, "COUNTED_BITS", at_once)
        monkeypatch.setattr(scoring, "BATCH", 4)
        total = np.zeros((len(scoring.ORDERS) * (2 << scoring.SLOT_BITS) // scoring.PIECE, scoring.PIECE), np.int64)
        for batch in scoring.gather_counts(code)(iter([pa.RecordBatch.from_arrays([words.slice(3)], ["word"])])):
            for i, x in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist()):
                total[i] += np.frombuffer(x, np.int64)
        total = total.reshape(len(scoring.ORDERS), -1)
        assert {(int(k), int(i) // 2, int(i) % 2): int(total[k, i]) for k, i in zip(*np.nonzero(total))} == want
