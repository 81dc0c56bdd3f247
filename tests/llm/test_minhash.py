"""MinHash classes against all pairs by brute force."""

import random

import numpy as np
import pytest

from dosecast.llm import catalog, minhash

SF = "/root/testdata/sf0.001"
# Every internal name as an extra column.
DOCS = "doc_id long, text string, id int, body string, line string, spot string, n int, node string, bands string, listing int, members int, hashes string, root int, kept string"


def doc(i, text):
    return (i, text, 1, "extra", "extra", "extra", 1, "extra", "extra", 1, 1, "extra", 1, "extra")


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    return [w for w in lowered.split(" ") if w]


def shingle_set(text, length):
    words = words_of(text)
    if len(words) < length:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def plain_classes(rows, length, percent=80):
    sets = [shingle_set(t, length) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                above[top(i)] = top(j)
    out = []
    for at, (i, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if top(j) == top(at)]
        least = min((k for k in keys if k is not None), default=None)
        out.append((i, len(sets[at]), least, i == least))
    return sorted(out, key=repr)


def found(rows):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=repr)


def test_classes_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = found(catalog.op12_minhash(spark, SF).collect())
    assert got == plain_classes(rows, 4)
    assert any(not kept for *_, kept in got)


def crowd(rng, variants):
    """Near copies of two templates, texts that share half their words, exact copies, and edge cases."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    templates, passage = [[word() for _ in range(60)] for _ in range(2)], [word() for _ in range(40)]
    texts = []
    for k in range(variants):
        own = list(templates[k % 2])
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            own[rng.randrange(60)] = word()
        texts += [own, passage + [word() for _ in range(rng.randint(2, 30))]]
    texts = [" ".join(t) for t in texts]
    texts += [None, "", " \t\n", "A b", "a B", "a b c", "ÀB c d e f", "word " * 3000, "word " * 2999] + [texts[0]] * 30 + [texts[1].upper()]
    return list(enumerate(texts)) + [(5, texts[5]), (5, "another text under a key of its own"), (None, "no key here at all"), (None, None), (None, texts[0])]


@pytest.mark.parametrize("many, turns", [(32, 2), (4, 1), (1, 0)])
def test_crowded_listings(spark, monkeypatch, many, turns):
    monkeypatch.setattr(minhash, "MANY", many)  # with 1 and 0 turns every pair comes from the rarest hashes
    monkeypatch.setattr(minhash, "TURNS", turns)
    rows = crowd(random.Random(many), 60)
    table = spark.createDataFrame([doc(i, t) for i, t in rows], DOCS).repartition(5)
    assert found(minhash.minhash_classes(table, shingle=3).collect()) == plain_classes(rows, 3)


def test_only_few_pairs_and_empty_tables(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six seven"), (3, "other words")]
    assert found(minhash.minhash_classes(spark.createDataFrame([doc(*r) for r in rows], DOCS), shingle=2).collect()) == plain_classes(rows, 2)
    assert minhash.minhash_classes(spark.createDataFrame([], DOCS)).collect() == []
    nothing = [(1, None), (None, ""), (2, " ")]
    assert found(minhash.minhash_classes(spark.createDataFrame([doc(*r) for r in nothing], DOCS)).collect()) == plain_classes(nothing, 5)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_texts_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(minhash, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    for length in (1, 2, 4):
        for n in (0, 1, 2, 3, 4, 5, 60):
            text = rng.choice(["", " ", "\n"]) + "".join(rng.choice("aBé") * rng.randint(1, 9) + rng.choice([" ", "\t \n"]) for _ in range(n))
            assert len(minhash.hashed_set(text, length)) == len(shingle_set(text, length))
            assert (minhash.hashed_set(text.upper().replace("É", "é"), length) == minhash.hashed_set(text, length)).all()


def test_bands_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    agreed = 0
    for _ in range(150):
        common, own = rng.integers(0, 2**64, 80, dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)
        a, b = (np.concatenate([common, half]) for half in (own[:10], own[10:]))
        agreed += sum(x == y for x, y in zip(minhash.band_keys(a), minhash.band_keys(b)))
    assert abs(agreed / (150 * 64) - 0.8**6) < 0.03
