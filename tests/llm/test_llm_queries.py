"""Registered queries: their SQL, their columns, and the whole pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from oracle_check import compare, duck
from valora.llm import queries as q
from valora.llm import language_id

COLUMNS = {
    1: "doc_id held_out lang_pred score", 2: "query_id rank vec_id score", 3: "doc_id fingerprint component_id",
    4: "doc_id n_bytes n_removed n_spans kept_sha256",
    5: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    6: "doc_id size source_size target taken", 7: "doc_id n_words n_removed kept_sha256",
    8: "page_id host path rule verdict", 9: "doc_id size text_crc32 law shard slot grown_shard",
    10: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    11: "doc_id n_lines n_dropped kept_sha256", 12: "doc_id leaf subroot root proof_sha256 folded_root verified",
    13: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_all_are_registered():
    names = entry.queries()
    assert set(q.queries()) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    ok, msg = compare(spark, name, sf, duck(sf))
    assert ok, msg


@pytest.mark.parametrize("name", ["op6_mixing", "op9_sharding"])
def test_columns(spark, sf, name):
    have = q.queries()[name](spark, sf).columns
    wanted = COLUMNS[int(name[2:].split("_")[0])].split()
    assert have[:len(wanted)] == wanted


def test_pipeline(spark, sf, docs):
    """Every stage's rows against what its input allows."""
    from test_repeats import brute_words
    from test_simhash import brute_components, brute_fingerprint

    model = language_id.fit_outside(docs)
    known = {r["doc_id"] for r in language_id.predict(docs, model).where("lang_pred <> 'und'").collect()}
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        rows = now.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in rows} == known
        elif name == "simhash_near_dedup":
            fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in seen}
            root, least = brute_components(set(fps.values()), 4), {}
            for i, x in fps.items():
                least[root[x]] = min(least.get(root[x], i), i)
            assert sorted(r["doc_id"] for r in rows) == sorted(least.values())
        elif name == "substring_dedup":
            gone = {k[0]: v for k, v in brute_words([((r["doc_id"],), r["text"]) for r in seen]).items()}
            before = {r["doc_id"]: r for r in seen}
            assert {r["doc_id"] for r in rows} == {i for i, v in gone.items() if v[1] < v[0] or not v[0]}
            for r in rows:
                n, removed, _ = gone[r["doc_id"]]
                assert len(r["text"].encode().split()) == n - removed
                assert removed or r == before[r["doc_id"]]
        elif name == "mixing":
            times = Counter(r["doc_id"] for r in rows)
            assert max(times.values()) <= 3 and set(rows) <= set(seen)
            words = Counter()
            for r in rows:
                words[r["source"]] += len(r["text"].encode().split())
            total = sum(len(r["text"].encode().split()) for r in seen)
            assert abs(sum(words.values()) - total) < 0.1 * total
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            expected, got = defaultdict(list), Counter()
            for r in seen:
                expected[r["doc_id"]] = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
            for r in rows:
                ids = np.array(expected[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
                assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["doc_tokens"] == len(expected[r["doc_id"]])
                got[r["doc_id"]] += r["length"]
            times = Counter(r["doc_id"] for r in seen)
            assert got == Counter({i: n * len(expected[i]) for i, n in times.items()})
        assert name == "packing" or now.schema.simpleString() == docs.schema.simpleString()
        seen = rows
