"""Language identification, fingerprints, mixing, sharding, packing."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valora.llm import fingerprints, language_id, mixing, packing, sharding


# ---- language identification

def test_languages(docs):
    model = language_id.fit_outside(docs)
    rows = docs.withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    out = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = language_id.accept(docs, model)
    assert kept.schema.simpleString() == docs.schema.simpleString() and kept.count() >= 0.99 * len(rows)


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of("piece_bpe_32k.model")
    rnd = np.random.default_rng(0)
    p = rnd.random((pieces.size + 2, 2))
    p[-1] = 0
    for word in ["the", "étais", "zß漢", "internation"]:
        ids = pieces.lattice([word])[0]
        text = "▁" + word

        def total(at, lang):
            if at == len(text):
                return 1.0
            return sum(p[ids[at + n, n - 1], lang] * total(at + n, lang) for n in range(1, min(ids.shape[1], len(text) - at) + 1))

        a = np.exp(language_id.forward(pieces.lattice([word]), p)[0, -1])
        assert np.allclose(a, [total(0, 0), total(0, 1)])
        # expected counts: the mean number of each place's cover is one
        counts = language_id.expected(pieces.lattice([word]), p[:, 0], np.array([1.0]))
        assert counts.sum() > 0 and counts[-1] == 0


def test_runs_of_any_length(monkeypatch):
    """No limit of letters: sums of long runs, in logarithms, by whole numbers of any size."""
    from fractions import Fraction

    pieces = language_id.pieces_of("piece_bpe_32k.model")
    rnd = np.random.default_rng(1)
    p = rnd.random((pieces.size + 2, 2)) * 1e-6
    p[-1] = 0
    words = ["".join(rnd.choice(list("abcdeinrstu"), k)) for k in (41, 41, 300)]
    monkeypatch.setattr(language_id, "PLACES", 32)
    for group in (words[:2], words[2:]):
        ids = pieces.lattice(group)
        got = language_id.log_sums(pieces, group, p)
        assert np.allclose(got, language_id.forward(ids, p)[:, -1], rtol=1e-12)
        for k in range(len(group)):
            sums = [Fraction(1)]
            for i in range(1, ids.shape[1]):
                sums.append(sum((sums[i - n] * Fraction(p[ids[k, i, n - 1], 0]) for n in range(1, min(i, ids.shape[2]) + 1)), Fraction(0)))
            z = sums[-1]
            assert np.isclose(got[k, 0], np.log(float(z.numerator >> max(0, z.numerator.bit_length() - 900)))
                              + max(0, z.numerator.bit_length() - 900) * np.log(2)
                              - np.log(float(z.denominator >> max(0, z.denominator.bit_length() - 900)))
                              - max(0, z.denominator.bit_length() - 900) * np.log(2), rtol=1e-9)
        # each letter and the mark are covered once
        counts = language_id.expected(ids, p[:, 0], np.ones(len(group)))
        size = np.zeros(len(p))
        for n in range(ids.shape[2]):
            np.maximum.at(size, ids[:, :, n].reshape(-1), n + 1)
        size[-1] = 0
        size[pieces.unknown] = 1
        assert np.isclose((counts * size).sum(), sum(len(w) + 1 for w in group))


def test_languages_of_odd_rows(odd_docs, no_docs, docs):
    model = language_id.fit_outside(docs)
    out = language_id.predict(odd_docs, model).collect()
    assert len(out) == odd_docs.count()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert all(by[i] == [("und", 0.0)] for i in (1, 2, 3, 9))
    assert by[4][0][0] == "en" and by[None][0] == by[None][1] and by[8][0][0] != "und"
    assert language_id.predict(no_docs, model).count() == 0
    none = language_id.fit_outside(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, none).collect()} == {"und"}
    kept = language_id.accept(odd_docs, model)
    assert kept.schema.simpleString() == odd_docs.schema.simpleString()
    assert not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}


# ---- fingerprints

def brute_edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        a, b = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(a) // 2
        out.append((i, len(a), hashlib.sha256((a[:len(a) - half] + b[:half]).encode()).hexdigest()))
    return out


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("part", [1 << 12, 8 << 20])
def test_edited_texts(docs, monkeypatch, part):
    """Many small parts and one large one give the same rows."""
    monkeypatch.setattr(fingerprints, "PART_BYTES", part)
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", part)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = fingerprints.edited_fingerprints(docs).collect()
    assert sorted(tuple(r)[:3] for r in out) == brute_edited(rows)
    texts = dict(rows)
    order = sorted(texts)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    error = []
    for r in out:
        a, b = shingles(texts[r["doc_id"]]), shingles(texts[following[r["doc_id"]]])
        if len(a | b) > 400:
            error.append(abs(len(a & b) / len(a | b) - r["near_next"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert max(error) < 0.2 and np.mean(error) < 0.02
    for least, most, bound in ((1, 30, 0.15), (30, 100, 0.1), (100, 400, 0.06), (400, 10**9, 0.03)):
        error = []
        for r in out:
            a = texts[r["doc_id"]]
            half = len(a or "") // 2
            b = (a or "")[:len(a or "") - half] + (texts[following[r["doc_id"]]] or "")[:half]
            x, y = shingles(a), shingles(b)
            if x | y and least <= len(x | y) < most:
                error.append(abs(len(x & y) / len(x | y) - r["near_edited"]))
        assert not error or np.mean(error) < bound, (least, len(error), np.mean(error))
    by_text = defaultdict(set)
    for r in out:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_parts_of_odd_ids(spark, monkeypatch):
    """One id far from the others, a third of the ids null, many rows with one
    id: no part is much above its size, and every row meets the next one."""
    monkeypatch.setattr(fingerprints, "PART_BYTES", 4000)
    ids = [*range(400), 1 << 60, -(1 << 62), *[None] * 300, *[77] * 200]
    rows = [(i, f"row {k} " + "word " * (k % 40)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = docs.select(F.col("doc_id").isNull().cast("long").alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                        F.xxhash64("text").alias("mark"), (F.octet_length("text") + 1).alias("bytes"))
    firsts = fingerprints._parts(sizes)
    at = {tuple(x) for x in firsts}
    size, own = [], 0
    for r in sorted(tuple(r) for r in sizes.collect()):
        if r[:3] in at:
            size.append(own)
            own = 0
        own += r[3]
    assert size[0] == 0 and len(firsts) > 20 and max(*size, own) <= 2 * 4000
    out = fingerprints.edited_fingerprints(docs)
    mark = {r[0]: r[1] for r in docs.select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, mark[r[1]]))
    wanted = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        half = len(a) // 2
        wanted.append((i, len(a), hashlib.sha256((a[:len(a) - half] + b[:half]).encode()).hexdigest()))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)[:3]) for r in out.collect())


def test_sketches_merge():
    """The sketch of a union of shingles is the union of sketches."""
    import pyarrow as pa
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    a, b = [" ".join(rnd.choice(words) for _ in range(800)) for _ in range(2)]
    (_, x), (_, y), (f, z) = fingerprints.sketches(pa.array([a, b, f"{a} {b}"]))
    assert np.isin(np.union1d(x, y), z).all() and len(z) - len(np.union1d(x, y)) <= 4
    assert abs(len(x) / 796 - 1 / fingerprints.SCALE) < 0.05
    assert np.array_equal(np.frombuffer(base64.b64decode(f[16:]), "<u8"), z)


def test_edited_odd_rows(odd_docs, no_docs):
    small = odd_docs.where("doc_id IS NOT NULL AND doc_id NOT IN (6, 13)")
    out = fingerprints.edited_fingerprints(small).collect()
    assert sorted(tuple(r)[:3] for r in out) == brute_edited([(r["doc_id"], r["text"]) for r in small.collect()])
    assert fingerprints.edited_fingerprints(odd_docs).count() == odd_docs.count()
    one = fingerprints.edited_fingerprints(odd_docs.where("doc_id = 10")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


# ---- mixing

def brute_targets(sizes):
    """Sources in order, by the resharing that the contract words describe."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        share = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def check_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        assert r["target"] == pytest.approx(goal[r["source"]], rel=1e-9)
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    return goal, taken, largest


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len((texts[r["id"]] or "").encode().split()) for r in rows)
    goal, taken, largest = check_mix(rows)
    assert all(abs(taken[s] - goal[s]) <= 0.5 * largest[s] for s in goal)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["id"], r["copies"]) for r in rows) == sorted((r["id"], r["copies"]) for r in again)


def test_mix_of_capped_sources(spark):
    """Sources far too small for their share stop at three times their size."""
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)), s) for i, s in enumerate("a" * 3 + "b" * 5 + "c" * 200 + "d" * 90)]
    rows += [(900, "one two", None), (901, "", "empty"), (902, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    goal, taken, _ = check_mix(got)
    assert goal["a"] == 3 * sum(r["size"] for r in got if r["source"] == "a") == taken["a"]
    assert abs(taken["c"] - goal["c"]) < 60 and abs(taken["d"] - goal["d"]) < 60
    assert goal["empty"] == taken["empty"] == 0


def test_rates_are_the_entropy_solution(spark):
    """Rates are exp(tilt * x), with one tilt per source, up to the cap."""
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 90)), s) for i, s in enumerate("ab" * 150)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        mean = sum(r["size"] for r in own) / len(own)
        tilt = {round(np.log(r["rate"]) * mean / r["size"], 6) for r in own if r["rate"] < 2.999}
        assert len(tilt) == 1
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-5)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check_mix(rows)
    taken = mixing.take(odd_docs)
    assert taken.schema.simpleString() == odd_docs.schema.simpleString()
    assert taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.take(no_docs).count() == 0


# ---- sharding

def test_best_fit_decreasing():
    rnd = random.Random(7)
    for _ in range(200):
        sizes = [rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 60))]
        bins, expected = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[i]]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append(60)
            bins[b] -= sizes[i]
            expected.append((i, b))
        assert sharding.best_fit_decreasing(sizes, 60) == [b for _, b in sorted(expected)]
    assert sharding.best_fit_decreasing([], 10) == []


def check_shards(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts(r)].add(r["shard"])
    assert all(len(v) == 1 for v in by_text.values())


def test_shards(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    check_shards(rows, lambda r: texts[r["doc_id"]])
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.02 * sum(load.values()) / 16


def test_shards_of_odd_rows(odd_docs, no_docs, spark, monkeypatch):
    rows = sharding.shard(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check_shards(rows, lambda r: (r["text_crc32"], r["size"]))
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1] == [(1, None)]
    assert sharding.shard(no_docs).count() == 0
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 20)
    hot = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(600)], "doc_id long, text string")
    check_shards(sharding.shard(hot).collect(), lambda r: r["text_crc32"])


# ---- packing

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, texts, tokenizer, capacity=2048):
    """Exact round trip: pieces make up the documents, sequences have no gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    expected = defaultdict(list)
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected[i].append(np.array(ids, "<u4"))
    assert set(by_doc) == set(expected)
    for i, own in by_doc.items():
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own) == Counter(
            (s, n, zlib.crc32(ids[s:s + n].tobytes()), len(ids))
            for ids in expected[i] for s, n in spans([r for r in own if r["doc_tokens"] == len(ids)], len(ids)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    return by_sequence


def spans(own, n):
    found = sorted({(r["start"], r["length"]) for r in own})
    assert [s for s, _ in found] == [0, *np.cumsum([x for _, x in found])[:-1].tolist()] and sum(x for _, x in found) == n
    return found


def test_packing(docs, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs).collect()
    sequences = check_packing(rows, texts, tokenizer)
    tokens = sum(r["length"] for r in rows)
    assert set(sequences) == set(range(len(sequences)))
    assert len(sequences) * 2048 < 1.05 * tokens + 2048


def test_packing_odd_rows(odd_docs, no_docs, tokenizer, spark, monkeypatch):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_packing(packing.pack(odd_docs).collect(), texts, tokenizer)
    assert packing.pack(no_docs).count() == 0
    monkeypatch.setattr(packing, "ROWS_PER_BLOCK", 10)
    odd = ["It's THE “test” — don't 'sun ½ 12.5a b.c é É x̸", "<|endoftext|>abc<|EndOfText|>", "a\x85b \x1c ΑΣ ς İ ß K", ".'s''re a'b"]
    df = spark.createDataFrame(list(enumerate(odd * 10)), "doc_id long, text string")
    check_packing(packing.pack(df, min_piece=4, capacity=64).collect(), list(enumerate(odd * 10)), tokenizer, 64)


def test_cut_lengths():
    for n in range(1, 5000):
        own = packing.cut_lengths(n, 2048, 128)
        assert sum(own) == n and all(x in (2048, 1024, 512, 256, 128) for x in own[:-1])
