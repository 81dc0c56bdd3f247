"""Personal data, quality, toxicity and BPE against plain versions, and their defined cases."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from dosecast.llm import bpe, catalog, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, ids string, n_words long, _text string"

EDGES = [None, "", " \t\n", "a", "word " * 5000, "x" * 70_000, "é" * 300 + " " + "字" * 40, "same text", "same text"]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", "s", 1, 0.5, "x", "y", 3, "z") for i, t in enumerate(EDGES)]
    rows += [(7, "same text", "en", "s", 1, 0.5, "x", "y", 3, "z"), (None, "no key", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_spans(text):
    """The contract's patterns, tried as they stand."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@x.de", ".", "-", "1", "25", "256", "300.1", "1.2.3.4", ".5.6.7.8.9", " ", "\n", "+", "+1 (5", "55) 777-1234", "4111111111111111", "4111-1111 1111 1111", "é", "00012", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_is_linear_in_long_runs():
    for run in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a.b@" * 50_000, "+1" * 100_000, "1 " * 100_000):
        pii.find_spans(run)


def test_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s[0] for s in pii.find_spans("account GB82 WEST 1234 5698 7654 32 here")] == ["iban"]
    assert pii.find_spans("account GB82 WEST 1234 5698 7654 33 here") == []
    assert [s[0] for s in pii.find_spans("call me at 555-123-4567 today")] == ["tel"]
    assert pii.find_spans("part 555-123-4567 today") == []
    assert [s[0] for s in pii.find_spans("social security 123-45-6789")] == ["ssn"]
    near, far = pii.find_spans("mail a@b.de")[0], pii.find_spans("a@b.de")[0]
    assert near[:1] == far[:1] and near[3] > far[3]
    assert pii.redact("mail a@b.de, ip 1.2.3.4") == "mail [EMAIL], ip [IP]"


def test_pii_query_columns(spark, edges):
    rows = {(r["doc_id"], r["spans"]): r for r in pii.pii_digest(edges).collect()}
    assert pii.pii_digest(edges).count() == edges.count()
    assert rows[(0, "")]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    one = spark.createDataFrame([(1, "é a@b.de +1 (555) 123-4567")], "doc_id long, text string")
    row = pii.pii_digest(one).first()
    assert (row["n_email"], row["n_phone"], row["spans"]) == (1, 1, "email:2:8,phone:9:26")
    assert row["base_sha256"] == hashlib.sha256(b"email:2:8,phone:9:26").hexdigest()
    assert pii.pii_digest(edges.limit(0)).collect() == []
    redacted = pii.redact_column(edges)
    assert redacted.columns == edges.columns and redacted.filter("text IS NULL").count() == 1


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_equals_plain():
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(["a ", "b ", "é", "\n", "c c c ", "#", "|", "\t", "\x0b", " ", "\x1c", "x"]) for _ in range(rng.randint(0, 40)))
        assert quality.measure(text)[:5] == plain_quality(text), repr(text)
    assert quality.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_js_distance():
    assert quality.js_distance(np.array([1, 0]), np.array([0, 1]))[0] == 1
    assert quality.js_distance(np.array([2, 2]), np.array([1, 1]))[0] == pytest.approx(0)
    assert quality.js_distance(np.array([0, 0]), np.array([1, 1]))[0] == 1


def test_quality_drops_odd_texts_and_keeps_plain_ones(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "to", "in"] + ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    plain = lambda n: " ".join(rng.choice(vocabulary[:5]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, plain(200), "en") for i in range(80)]
    rows += [(100, re.sub(" ", "### ", plain(200)), "en"), (101, plain(200).upper(), "en"), (102, "too short", "en"), (103, None, "xx"), (104, plain(200), "xx"), (105, "".join(rng.choice("0123456789|") for _ in range(3000)) + plain(60), None)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(80)) and got[104]["kept"]
    assert not any(got[i]["kept"] for i in (100, 101, 102, 103, 105)) and got[102]["base_failed"] and not got[100]["base_failed"]


def test_quality_does_not_depend_on_the_number_of_languages(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(6):
        vocabulary = ["the", "of"] + [word("aeioulnrst" if i % 2 else "BCDFG789") for _ in range(200)]
        rows += [(100 * i + j, f"l{i}", " ".join(rng.choice(vocabulary) for _ in range(60 + 10 * i))) for j in range(4)]
    rows += [(900, None, rows[0][2]), (901, "none passes", "few words"), (902, "l0", rows[-1][2])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    columns = ["doc_id", "class_distance", "word_distance", "kept"]
    read = lambda: {r["doc_id"]: tuple(r) for r in quality.quality(df).select(*columns).collect()}
    want = read()
    for most in (1, 3):
        monkeypatch.setattr(quality, "MAX_LANGUAGES", most)
        got = read()
        assert {i: v for i, v in got.items() if i not in (900, 901)} == {i: v for i, v in want.items() if i not in (900, 901)}
    assert len(want) == len(rows)


def test_quality_defined_cases(spark, edges):
    got = quality.quality(edges)
    assert got.count() == edges.count() and got.filter("doc_id = 0 AND n_words = 0 AND base_failed AND NOT kept").count() == 1
    assert quality.quality(edges.limit(0)).collect() == []


def test_grammar_weighs_context():
    weights = {"idiot": 3.0}
    symbols = toxicity.ToxicityModel(weights, ()).symbols()
    weight = lambda text: toxicity.clause_weight(text.split(), symbols, weights)
    assert weight("you idiot") == 3.0 * toxicity.AIMED and weight("idiot") == 3.0
    assert weight("not an idiot") == pytest.approx(3.0 * toxicity.NEGATED)
    assert weight("not a b c idiot") == 3.0
    assert weight("john said idiot") == pytest.approx(3.0 * toxicity.REPORTED)
    assert weight("kill you") == toxicity.THREAT_WEIGHT and weight("kill time") == 0
    assert weight("never kill them") == pytest.approx(toxicity.THREAT_WEIGHT * toxicity.NEGATED)


def test_toxicity_learns_words_and_ignores_held_out(spark):
    import zlib

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(4, 8))) for _ in range(500)]
    rows, marks = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            text.insert(rng.randint(0, 60), rng.choice(["blorf", "zwick"]))
        rows.append((i, " ".join(text)))
        marks.append((i, 0, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r["predicted"] == (i % 5 == 0) for i, r in got.items() if r["held_out"]]) > 0.98
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_defined_cases(spark, edges):
    labels = spark.createDataFrame([(1, 0, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(edges.limit(0), labels.limit(0)).collect() == []


@pytest.fixture(scope="module")
def library():
    import base64

    with open(catalog.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("sizes", [{"chunk": 16, "overlap": 8}, {"chunk": 40, "overlap": 40}, {}])
def test_bpe_equals_library(spark, library, sizes):
    rng = random.Random(5)
    parts = ["don't", "we're", "'", "'r", "'s's's", " ", "   ", "\n\n", "ab" * 30, "12345", "...", "é", "字字", " ", "🙂", "x", " the", "<|endoftext|>", "\x85 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "a" * 500, " " * 300 + "x", "'" * 200, "'s" * 150, "-" * 90 + " a b c d e f g h " * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encoding_digest(docs, catalog.RANKS, public_tokenizers.PATTERN, **sizes).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), repr(t)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), repr(t)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_cuts_long_texts(spark):
    long = spark.createDataFrame([(1, "some words go on and on " * 200), (2, "z" * 3000), (3, "z" * 500 + " a b c" * 300)], "row long, text string")
    pieces = bpe.slices_of_long(long, catalog.RANKS, public_tokenizers.PATTERN, 256, 64).collect()
    by_row = {i: "".join(p["piece"] for p in sorted((p for p in pieces if p["row"] == i), key=lambda p: p["slice"])) for i in (1, 2, 3)}
    assert by_row == {r["row"]: r["text"] for r in long.collect()}
    assert sum(p["row"] == 1 for p in pieces) > 10 and sum(p["row"] == 2 for p in pieces) == 1


def test_bpe_defined_cases(spark, edges):
    got = bpe.encoding_digest(edges, catalog.RANKS, public_tokenizers.PATTERN)
    assert got.count() == edges.count() and got.filter("n_tokens = 0").count() == 2
    assert bpe.encoding_digest(edges.limit(0), catalog.RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_ids_decode_to_the_text(spark):
    texts = ["Some words, and ünïcode 字.", "", None, "x y " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode_texts(docs, catalog.RANKS, public_tokenizers.PATTERN, chunk=100, overlap=20)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode_ids(ids, catalog.RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("after", [" BIC COBADEFFXXX", " 2024", " A 1 B 2 C 3 D 4", "", " XX12 3456 7890 123 A"])
@pytest.mark.parametrize("before", ["IBAN ", "IBAN AB12 "])
def test_account_numbers_end_before_further_capitals(before, after):
    code = "DE89 3704 0044 0532 0130 00"
    text = f"{before}{code}{after}"
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text) if k == "iban"] == [("iban", code)]
    twice = f"{text}; {code} {code}"
    assert sum(k == "iban" for k, *_ in pii.find_spans(twice)) == 3


def test_a_learnt_word_needs_no_more_contexts_in_a_larger_sample(spark):
    for n in (100, 2000):
        rows = [(toxic, f"plain words here {'abcdef'[i]} grubble xyz" if toxic and i < 6 else "plain words here") for toxic in (0, 1) for i in range(n)]
        learnt = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
        assert "grubble" in learnt and "plain" not in learnt
