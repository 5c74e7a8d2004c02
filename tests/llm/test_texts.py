"""Fill-in-middle, SentencePiece spans and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fillmiddle, pieces, spelling
from sparkloom.llm.tokens import tokenizer_path

from test_operators import CLASHES, SCHEMA, edge_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    odd = [(200, "x" * 200_000 + " tail", "en", "a", 1), (201, "a <P> b " * 30, "en", "a", 1), (202, "<S", "en", "a", 1), (203, "é☃😀 " * 40_000, "en", "a", 1), (204, " \n", "en", "a", 1),
           (205, "▁ ▁▁ a▁b", "en", "a", 1), (206, "\0 a\x00b", "en", "a", 1), (207, "été Été ÉTÉ ×÷ ſ", "fr", "a", 1)]
    odd += [(300 + i, "".join(rng.choice("ab <PSM>\n\té😀") for _ in range(rng.randint(0, 40))), "en", "a", 1) for i in range(200)]
    return [*edge_rows(), *odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, value in {**CLASHES, "n": 3, "form": "f", "units": 1, "frames": 2, "ids": 1, "low": 2}.items():
        df = df.withColumn(name, F.lit(value))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def arranged(doc_id, text):
    """(n, form, prefix characters, middle characters, output) straight from the definition."""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [4, 64, fillmiddle.FRAME])
def test_fill_in_middle_matches_the_definition(docs, rows, frame):
    some = docs if frame > 4 else docs.filter("length(text) < 2000 or text is null")
    out = fillmiddle.fill_in_middle(fillmiddle.archive(some, frame_bytes=frame)).cache()
    texts = {r["doc_id"]: r["output"] for r in fillmiddle.texts(out).collect()}
    want = collections.Counter()
    for i, t, *_ in rows:
        if frame > 4 or len(t or "") < 2000:
            n, form, p, m, output = arranged(i, t or "")
            want[i, n, form, p, m, sha(output), sha(t or "")] += 1
            assert i is None or texts[i] == output
    assert collections.Counter(map(tuple, fillmiddle.digests(out).collect())) == want
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}


def test_only_frames_with_a_cut_are_compressed_anew(spark):
    text = "".join(f"word{i} " for i in range(60_000))
    doc = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    stored = fillmiddle.archive(doc).cache()
    kept = {bytes(f) for r in stored.select("frames").collect() for f in r["frames"]}
    for r in fillmiddle.fill_in_middle(stored, rate=100).collect():
        assert r["form"] != "plain" and sum(bytes(f) not in kept for f in r["frames"]) <= 3 + 4


def test_fill_in_middle_of_nothing(empty):
    assert fillmiddle.digests(fillmiddle.fill_in_middle(fillmiddle.archive(empty))).count() == 0


def test_pieces_and_spans_match_the_library(docs, rows, empty, spark):
    library = pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model")).processor
    got = collections.Counter((r["doc_id"], tuple(zip(r["ids"], r["begins"], r["ends"]))) for r in pieces.encode(docs).collect())
    want = collections.Counter((i, tuple((p.id, p.begin, p.end) for p in library.encode(t or "", return_type="proto").pieces)) for i, t, *_ in rows)
    assert got == want
    digests = collections.Counter(map(tuple, docs.select("doc_id", "text").mapInArrow(pieces.digested(tokenizer_path("piece_bpe_32k.model")), pieces.DIGESTS).collect()))
    expected = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids)), len((t or "").encode())] += 1
    assert digests == expected
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t, *_ in rows if i not in (None, 205))
    assert pieces.encode(empty).count() == 0


def test_long_texts_are_decoded_in_parts(monkeypatch):
    monkeypatch.setattr(pieces, "DECODED_IDS", 7)
    encoder = pieces.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    for text in ("one two  three ☃☃☃ four\n\n five six seven eight " * 5, "☃" * 40, "a"):
        _, ids, _, _, bounds = encoder.spans(pa.array([text]))
        assert "".join(encoder.decoded(ids, bounds)) == text


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("bytes_for_unknown", [False, True])
def test_spans_through_a_character_map(squeeze, bytes_for_unknown):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model, rules = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.remove_extra_whitespaces = rules.normalizer_spec.precompiled_charsmap, squeeze
    if not bytes_for_unknown:
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            p.type = p.CONTROL if p.type == p.BYTE else p.type
    encoder, rng = pieces.PieceEncoder("", model.SerializeToString()), random.Random(5)
    texts = ["", " ", "ﬁ ", *("".join(rng.choice("  \t\nabé▁日☃😀 ̈xﬁ①Å　­.") for _ in range(rng.randint(1, 50))) for _ in range(400))]
    counts, ids, begins, ends, _ = encoder.spans(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        want = [(p.id, p.begin, p.end) for p in encoder.processor.encode(text, return_type="proto").pieces]
        assert list(zip(ids[at:at + n].tolist(), begins[at:at + n].tolist(), ends[at:at + n].tolist())) == want
        at += n


def grouped(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word[:h % len(word)] + word[h % len(word) + 1:] if h % 97 == 0 else word] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def one_apart(a, b):
        a, b = sorted((a, b), key=len)
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:])

    near = {w: [v for v in counts if abs(len(w) - len(v)) < 2 and one_apart(w, v)] for w in counts}
    form = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if counts[v] >= 2 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_variants_match_brute_force(spark, docs, rows, empty):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "abababa", "bababab"]
    long = "".join(rng.choice("abc") for _ in range(5_000))
    hot = [long, long[:2_000] + "x" + long[2_000:], long[:-1], "y" + long[1:]]
    made = [(1000 + i, " ".join(rng.choice(base) for _ in range(60)) + " ÀÖØ×÷ straße STRASSE") for i in range(60)] + [(2000 + i, " ".join(hot[:1 + i % 4])) for i in range(16)]
    made += [(None, "Wordy wordy WORDY"), (None, None), (5000, ""), (5001, "1 2 3")]
    made += [(3000 + i, "stone " * 8 + "stine " * 2 + "stina" * (i < 4)) for i in range(10)]
    both = made + [(i, t) for i, t, *_ in rows]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string")).withColumns({"word": F.lit("x"), "n": F.lit(1), "form": F.lit("q")})
    got = spelling.variants(spelling.vocabulary(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = grouped(both)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r["n_near"] > 0 for r in got) > 50 and any(r["form"] != r["root"] for r in got if r["form"])
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
