"""The registered queries over a whole small set of tables, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from tests.llm.test_text_operators import brute_groups, brute_prints

from typeweave.llm import queries as Q
from typeweave.llm.common import words_of


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf, docs):
    got = {r["doc_id"]: r for r in Q.op1_hmm_scores(spark, sf).collect()}
    train = Counter()
    for d, r in docs.items():
        if crc(d) % 10:
            train.update([*words_of(r["text"]), b""])
    n, v = sum(train.values()), len(train)
    assert got.keys() == docs.keys()
    for d, r in docs.items():
        tokens = [*words_of(r["text"]), b""]
        x = got[d]
        assert (x["held_out"], x["n_tokens"], x["train_tokens"]) == (crc(d) % 10 == 0, len(tokens), n)
        assert x["n_known"] == sum(train[t] > 0 for t in tokens)
        assert x["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
    held = [x for x in got.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: r for r in Q.op2_toxicity(spark, sf).collect()}
    assert got.keys() == docs.keys()
    assert all(r["held_out"] == (crc(d) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    assert all(crc(r["doc_id"]) % 4 != 2 for r in Q.learned_labels(spark, sf).collect())


def test_op2_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in Q.op2_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.9 and hit / sum(p for p, _ in held) > 0.9


def test_op4(spark, sf, docs):
    got = {r["doc_id"]: r["text"] for r in Q.op4_pii_surrogates(spark, sf).collect()}
    assert got.keys() == docs.keys()
    found = r"[\w.+-]+@[\w-]+\.[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b"
    originals = {x for r in docs.values() for x in re.findall(found, r["text"])}
    assert originals and not any(x in text for text in got.values() for x in re.findall(found, text) if x in originals)
    plain = re.compile(r"[0-9@]")
    assert all(got[d] == r["text"] for d, r in docs.items() if not plain.search(r["text"]))
    pairs = {}
    for d, r in docs.items():
        before, after = re.findall(found, r["text"]), re.findall(found, got[d])
        assert len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            assert pairs.setdefault(a, b) == b, "one entity, one surrogate"
    assert len(set(pairs.values())) == len(pairs), "different entities, different surrogates"


def test_op5(spark, sf, docs):
    got = {r["doc_id"]: r for r in Q.op5_language_id(spark, sf).collect()}
    assert got.keys() == docs.keys()
    held = [d for d in docs if crc(d) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[d]["lang_pred"] == docs[d]["lang"] for d in held) / len(held) > 0.95


def test_op7(spark, sf, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = sorted(docs)
    counts = [len(e.ids) for e in model.encode_batch([docs[d]["text"] for d in ids], add_special_tokens=False)]
    got = {r["doc_id"]: tuple(r) for r in Q.op7_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {d: (d, len(docs[d]["text"].encode()), n, n > 2048) for d, n in zip(ids, counts, strict=True)}


def test_op8(spark, sf, docs):
    for r in Q.op8_matroska(spark, sf).collect():
        raw = docs[r["doc_id"]]["text"].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64


def test_op9(spark, sf, docs):
    ids = sorted(docs)
    prints = [brute_prints(docs[d]["text"]) for d in ids]
    want = {(d, f"{p:016x}", ids[g]) for d, p, g in zip(ids, prints, brute_groups(prints), strict=True)}
    assert {tuple(r) for r in Q.op9_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in Q.queries() if n.startswith("op")} == set(range(1, 11)) and "pipeline" in Q.queries()
