"""Sharding, neighbours, mixing, chat, SimHash, LM scores and the pipeline against plain versions."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dosecast.llm import ann, catalog, chat, lm, mixing, sharding, simhash
from tools.check import sorted_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, rate double, tokens long, score double, _row long"


def doc(i, text):
    return (i, text, "en", "s", 1, 9, 9, 9, 0.5, 9, 0.5, 9)


@pytest.fixture(scope="module")
def edges(spark):
    texts = [None, "", " \t\n", "a", "word " * 5000, "same text here it is", "same text here it is", "ÀB c"]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(6, texts[6]), doc(None, "no key"), (None,) * 12]
    return spark.createDataFrame(rows, DOCS)


# sharding


def check_shards(rows, shards, slack):
    per = [[r for r in rows if r["shard"] == s] for s in range(shards)]
    total = sum(r["size"] for r in rows)
    for own in per:
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= slack
    return per


def test_shards_are_even_with_hot_copies(spark):
    rng = random.Random(1)
    rows = [doc(i, "x" * rng.randint(0, 60)) for i in range(3000)] + [doc(10_000 + i, "hot " * 5) for i in range(2000)] + [doc(7, "alike in everything")] * 2000
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS).repartition(5), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    check_shards(got, sharding.SHARDS, 200)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_splitters_equal_plain_cuts(spark):
    rng = random.Random(2)
    pairs = [(rng.choice([rng.getrandbits(62), 5, 1 << 61]), rng.randint(1, 50)) for _ in range(4000)]
    cuts = sharding.splitters(spark.createDataFrame(pairs, "_key long, size long"), 10, 0)
    total, below = sum(b for _, b in pairs), lambda cut: sum(b for k, b in pairs if k < cut)
    edges = sorted({k for k, _ in pairs} | {k + 1 for k, _ in pairs})
    for i, cut in enumerate(cuts, 1):
        best = min(abs(below(e) - total * i / 10) for e in edges)
        assert abs(below(cut) - total * i / 10) == pytest.approx(best)


def test_shards_defined_cases(spark, edges):
    got = sharding.shard_by_bytes(edges)
    rows = got.collect()
    assert len(rows) == edges.count() and {"size", "shard", "slot", "fp"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert {r["size"] for r in rows if r["text"] is None} == {8}
    check_shards(rows, sharding.SHARDS, 30_000)
    assert sharding.shard_by_bytes(edges.limit(0)).collect() == []


# neighbours


def plain_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        own = dict(vectors)[q]
        ranked = sorted(((-float(np.dot(own, x)), i) for i, x in vectors if i != q))
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def found_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=32).astype(np.float32)) for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    got = found_of(ann.nearest(df, F.col("id") % 20 == 0, block=64))
    exact = [(i, v.astype(np.float64)) for i, v in vectors]
    want = plain_nearest(exact, range(0, 3000, 20), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    scores = {(q, i): float(np.dot(dict(exact)[q], dict(exact)[i])) for q in list(want)[:5] for i, _ in got[q]}
    for q in list(want)[:5]:
        assert all(s == pytest.approx(scores[q, i], abs=1e-12) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_tables(spark, sf):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = found_of(catalog.op6_ann(spark, f"/root/testdata/{sf}"))
    want = plain_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_neighbours_copies_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [0.0, 1.0]), (220, [1.0, 1.0]), (220, [1.0, 1.0])]
    odd = [(300, None), (320, []), (340, [0.0, 0.0]), (360, [nan, 1.0]), (380, [inf, 1.0]), (400, [None, 1.0]), (420, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = found_of(ann.nearest(df, F.col("id") % 20 == 0))
    assert set(got) == {0, 20, 40, 60, 80, 200, 220}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]] == [*range(20)]
    assert [i for i, _ in got[200]] == [220, *range(19)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert found_of(ann.nearest(few, F.col("id") == 0)) == {0: [(2, 2.0), (1, 0.5)]}
    assert ann.nearest(few.limit(0), F.col("id") == 0).collect() == []


# mixing


def test_rates_meet_targets_and_equal_plain_descent(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], size=800)
    tokens = rng.integers(0, 500, size=800)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posterior array<double>").repartition(3)
    for targets in ([0.5, 0.3, 0.2], [0.05, 0.05, 0.9]):
        pulls = mixing.fit_rates(rows, np.array(targets))
        rates, _ = mixing.replay(p, pulls)
        assert (rates >= 0).all()
        held = (rates * tokens) @ p
        assert np.abs(held / tokens.sum() - targets).max() <= 2e-3
        plain, ahead, own, t = np.ones(len(p)), np.ones(len(p)), tokens @ p, 1.0
        for _ in pulls:
            after = np.maximum(0, ahead - p @ (((ahead * tokens) @ p - np.array(targets) * own.sum()) / own))
            s = (1 + math.sqrt(1 + 4 * t * t)) / 2
            plain, ahead, t = after, after + (t - 1) / s * (after - plain), s
        assert np.allclose(plain, rates)


def test_mixing_learns_domains(spark):
    rng = random.Random(5)
    text = lambda good: " ".join("".join(rng.choice("abcde" if good else "#$%^&") for _ in range(5)) for _ in range(30))
    rows = [doc(i, text(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    rated, domains = mixing.mixing_rates(docs, labels, {1: 0.5, 0: 0.5}, "quality")
    got = rated.collect()
    assert domains == [0, 1] and all((r["posterior"][1] > 0.5) == (r["doc_id"] % 4 > 0) for r in got)
    good = sum(r["rate"] * r["tokens"] for r in got if r["doc_id"] % 4) / sum(r["rate"] * r["tokens"] for r in got)
    assert good == pytest.approx(0.5, abs=0.01)
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in got)
    out = mixing.mixed(docs, labels, {1: 0.5, 0: 0.5}, "quality")
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_mixing_defined_cases(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rated, domains = mixing.mixing_rates(edges, none, {1: 1.0}, "quality")
    assert domains == [] and {(r["rate"], r["copies"]) for r in rated.collect()} == {(1.0, 1)} and rated.count() == edges.count()
    marked = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rated, _ = mixing.mixing_rates(edges, marked, {1: 0.5, 0: 0.5}, "quality")
    assert rated.count() == edges.count() and rated.filter("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mixed(edges.limit(0), marked, {1: 0.5, 0: 0.5}, "quality").collect() == []


# chat


def plain_segments(rows, trained="assistant"):
    by_pair = {}
    for c, turn, role, text in rows:
        if c is not None:
            by_pair.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    own = {}
    for c, items in by_pair.items():
        seen, own[c] = Counter(), []
        for turn, role, text in sorted(items):
            seen[turn] += 1
            own[c].append((turn, seen[turn], role, text))
    last = {c: max(((t, n, x) for t, n, r, x in v if r == trained), default=None) for c, v in own.items()}
    out = []
    for c, left in own.items():
        right = []
        for t, n, r, x in left:
            if last[c] and (t, n) == last[c][:2]:
                if last.get(c ^ 1):
                    right.append((t, n, r, last[c ^ 1][2]))
            else:
                right.append((t, n, r, x))
        common = 0
        while common < len(left) and common < len(right) and left[common] == right[common]:
            common += 1
        for part, items in (("prompt", left[:common]), ("chosen", left[common:]), ("rejected", right[common:])):
            out += [(c, t, n, part, r, f"<|im_start|>{r}\n{x}<|im_end|>\n", int(part != "prompt" and r == trained)) for t, n, r, x in items]
    return sorted(out)


def test_preference_segments_equal_plain_and_sql(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "c"])) for _ in range(400)]
    rows += [(50, 0, "assistant", "same"), (51, 0, "assistant", "same"), (60, 0, "user", "x")] + [(70, 1, "user", "again")] * 5
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, mask int, pair int")
    own = chat.turns(df, "conv_id")
    got = chat.preference_segments(own, chat.swapped_replies(own)).select("pair", "turn", "copy", "part", "role", "segment", "mask")
    found = sorted(tuple(r) for r in got.collect())
    assert found == plain_segments(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(db.execute(catalog.ORACLES["op8_preference"]).fetchall()) == found
    records = {r["pair"]: r for r in chat.pair_records(got).collect()}
    for pair, r in records.items():
        for part in ("prompt", "chosen", "rejected"):
            assert r[part] == "".join(s[5] for s in found if s[0] == pair and s[3] == part)
        for part in ("chosen", "rejected"):
            trained = [s[5] for s in found if s[0] == pair and s[3] == part and s[6]]
            assert [r[part][x["start"] : x["end"]] for x in r[f"{part}_spans"]] == trained
    empty = chat.turns(df.limit(0), "conv_id")
    assert chat.preference_segments(empty, empty).collect() == []


def test_preference_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = catalog.op8_preference(spark, SF)
    cursor = db.execute(catalog.ORACLES["op8_preference"])
    assert sorted_rows(df.columns, df.collect()) == sorted_rows([d[0] for d in cursor.description], cursor.fetchall())


# SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items):
    root = {i: i for i in range(len(items))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if bin(a ^ items[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, f"{fp:016x}", least.get(find(i))) for i, (key, fp) in enumerate(items)), key=repr)


def found_classes(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_simhash_equals_plain(spark, edges):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["ab", "Cd", "é", "fgh", "x"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts = base + [t + " " + rng.choice("xyz") for t in base] + base[:20]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([doc(*r) for r in rows], DOCS)
    assert found_classes(simhash.simhash_classes(df)) == plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert found_classes(simhash.simhash_classes(edges)) == plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert simhash.simhash_classes(edges.limit(0)).collect() == []


@pytest.mark.parametrize("many", [simhash.MANY, 3])
def test_links_find_chains_and_crowds(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(30)]
    chain = [values[0]]
    for _ in range(25):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    crowd = [values[1] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)]
    items = list(enumerate(values + chain + crowd + values[:3]))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in items]
    printed = spark.createDataFrame(signed, "doc_id long, fp long")
    classes = simhash.fingerprint_classes(printed, "doc_id", 2, 4)
    got = printed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    assert found_classes(got) == plain_components(items)


def test_first_of_classes(spark, edges):
    kept = simhash.first_of_classes(edges)
    assert kept.columns == edges.columns
    classes = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in edges.collect()])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, _, c in classes if c is not None})
    assert simhash.first_of_classes(edges.limit(0)).collect() == []


# LM scores


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lowered.replace("\t", " ").replace("\n", " ").split(" ") if w] + ["\n"]


def plain_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    singles, pairs = Counter(), Counter()
    for i, text in rows:
        if not held(i):
            tokens = tokens_of(text)
            singles.update(tokens)
            pairs.update(zip(["\n", *tokens], tokens))
    n, v = sum(singles.values()), len(singles)
    level = lambda c: 1 + math.floor(math.log(c) / math.log(lm.BASE) + 1e-9) if c else 0
    near = lambda c: 0 if c == 0 else 1 if level(c) == 1 else lm.BASE ** (level(c) - 0.5)
    out = []
    for i, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((singles[t] + 1) / (n + v + 1)) for t in tokens)
        score = 0
        for before, t in zip(["\n", *tokens], tokens):
            own, first = (near(singles[t]) + 1) / (n + v + 1), near(singles[before])
            both = pairs[before, t] if pairs[before, t] >= lm.MIN_PAIR else 0
            score += math.log10(lm.MIX * min(1, near(both) / first) + (1 - lm.MIX) * own if first else own)
        out.append((i, len(tokens), sum(singles[t] > 0 for t in tokens), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def test_lm_equals_plain(spark, edges, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 64)  # so that the filter hardly ever holds an n-gram too many
    rng = random.Random(9)
    words = ["The", "of", "É", "a.", *("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300))]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([4, 50, 304])]) for _ in range(rng.randint(0, 80)))) for i in range(300)] + [(None, None), (3, "The of"), (3, "The of")]
    rows += [(r["doc_id"], r["text"]) for r in edges.collect()]
    df = spark.createDataFrame([doc(*r) for r in rows], DOCS).repartition(4)
    for frequent in (lm.FREQUENT, 10, 0):
        got = lm.lm_scores(df, ~lm.held_out(df["doc_id"]), frequent=frequent).collect()
        found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in got), key=repr)
        want = plain_scores(rows)
        assert [f[:5] for f in found] == [w[:5] for w in want]
        assert np.mean([abs(f[5] - w[5]) < 1e-5 for f, w in zip(found, want)]) > 0.98


def test_lm_filter_has_no_false_negatives_and_stays_in_bounds(spark):
    rng = np.random.default_rng(10)
    n = rng.geometric(0.05, size=5000)
    high = rng.integers(-(2**63), 2**63 - 1, size=5000)
    counts = spark.createDataFrame([(0, int(h), 0, int(c)) for h, c in zip(high, n)], "kind int, high long, low long, n long")
    shape = lm.shape_for(counts)
    held = lm.Filter(lm.build_filter(counts, shape), shape)
    found = held.levels(lm.word_keys(high.view(np.uint64)), high.view(np.uint64))
    assert (found >= lm.level_of(n)).all() and np.mean(found == lm.level_of(n)) > 0.97
    others = rng.integers(-(2**63), 2**63 - 1, size=20000).view(np.uint64)
    assert np.mean(held.levels(lm.word_keys(others), others) > 0) < 0.03
    small = lm.shape_for(counts, 1 << 12)
    assert small.least > 1 and small.segment_bits * lm.SEGMENTS <= 8 * max(1 << 12, lm.SEGMENTS * 128)


@pytest.mark.parametrize("max_bytes", [1 << 10, 1 << 13])
def test_lm_counts_all_ngrams_where_the_filter_holds_some(spark, edges, monkeypatch, max_bytes):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 64)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([4, 50, 200])]) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(None, None)]
    rows += [(r["doc_id"], r["text"]) for r in edges.collect()]
    df = spark.createDataFrame([doc(*r) for r in rows], DOCS).repartition(3)
    model, _ = lm.train(df.filter(~lm.held_out(df["doc_id"])).select("text"), max_bytes=max_bytes)
    assert model.shape.least > 1
    got = lm.lm_scores(df, ~lm.held_out(df["doc_id"]), max_bytes=max_bytes).collect()
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in got), key=repr)
    want = plain_scores(rows)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.mean([abs(f[5] - w[5]) < 1e-5 for f, w in zip(found, want)]) > 0.98


def test_lm_pairs_seen_once_count(spark):
    """Every word and pair of the training text is seen once: levels are exact counts, the shares are 1."""
    texts = [(0, "one two three four"), (1, "one two three four"), (2, "four three two one")]
    df = spark.createDataFrame([doc(*r) for r in texts], DOCS)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(df, df["doc_id"] == 0).collect()}
    own = 2 / (5 + 5 + 1)  # every word, and the end, once among 5 tokens and 5 words
    seen, unseen = lm.MIX + (1 - lm.MIX) * own, (1 - lm.MIX) * own
    assert got[0] == pytest.approx(5 * math.log10(seen)) and got[1] == got[0]
    assert got[2] == pytest.approx(5 * math.log10(unseen))


def test_lm_empty(spark, edges):
    df = edges.limit(0)
    assert lm.lm_scores(df, ~lm.held_out(df["doc_id"])).collect() == []
    one = spark.createDataFrame([doc(1, "some words")], DOCS)
    row = lm.lm_scores(one, F.lit(False)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "byte_level_bpe":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows)
            break
        assert out.schema.simpleString() == docs.schema.simpleString()
        if name == "simhash_near_dedup":
            classes = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows])
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in classes})
        from dosecast.session import materialize

        docs = materialize(out, name)
        rows = docs.collect()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
