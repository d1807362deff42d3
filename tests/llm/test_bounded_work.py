import corpus_pipeline
import numpy as np
import pyarrow as pa
from tests.llm.test_text_operators import docs_of

from typeweave.llm import toxicity
from typeweave.llm.common import TEXTS


def some_model(seed=2):
    rng = np.random.default_rng(seed)
    total = rng.integers(1, 900, 1 << toxicity.CELL_BITS).astype(np.float32)
    return toxicity.CharModel(rng.integers(0, 90, len(total)).astype(np.float32), total, rng.integers(1, 30, len(total)).astype(np.float32))


def test_contexts_share_what_shorter_ones_say(monkeypatch):
    model, cells, real = some_model(), [], toxicity._cell
    contexts = [f"{a}bcd" for a in "abcdefghijklmnopqrstuvwxyz"]
    codes = np.array([toxicity._code(c) for c in contexts], np.uint64)
    want = model.at(codes, np.full(len(codes), np.uint64(ord("e")))).tolist()
    monkeypatch.setattr(toxicity, "_cell", lambda *a: cells.append(a) or real(*a))
    got = [model.p(c, "e") for c in contexts]
    assert np.allclose(got, want, rtol=1e-9)
    assert len(cells) <= 2 * toxicity.ORDER + 2 * len(contexts)


def test_disguised_tokens_are_decoded_once(monkeypatch):
    model, asked = some_model(), []
    first = [model.decode(t) for t in ("1d10t", "st*p1d", "a" * 100 + "1")]
    real = toxicity.CharModel.logp
    monkeypatch.setattr(toxicity.CharModel, "logp", lambda *a: asked.append(a) or real(*a))
    assert [model.decode(t) for t in ("1d10t", "st*p1d")] == first[:2] and not asked
    assert model.decode("a" * 100 + "1") == first[2] and asked  # long ones are not kept


def test_quick_ways_change_no_score():
    model = some_model()
    lexicon = {"spam": 3.0, "abc": 2.0, "a": 1.0, "stup-": 2.5, "idiot-": 4.0}
    scores = toxicity._Scores(lexicon, model)
    for text in (None, "", "a b", "s p a m", "x a b c", "\x1ca b\x1dc", "A B  C", "Stupidly idiotic idio stu st spam.", "a", "STUP stupa spamm"):
        words = [w for t in (text or "").split() for w in [max([0.0, *(lexicon.get(f, 0.0) for x in toxicity.words_of(t, model) for f in toxicity.features_of(x))])] if w > 0]
        words += [x for x in (max(lexicon.get(f, 0.0) for f in toxicity.features_of(w)) for w in toxicity.spaced(text or "", model)) if x > 0]
        n = len(words)
        assert scores.text(text) == [1.0, float(n > 0), float(n > 1), min(n, 4) / 4, min(sum(words), 24.0) / 24, max(words, default=0.0) / 8], text


def test_pipeline_hands_workers_few_texts_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = docs_of(spark, [(1, "one text", "en", "a"), (2, "other words", "en", "a")])

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.num_rows for b in batches)], pa.int64())], ["n"])

    before = spark.conf.get(name)
    try:
        assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 2
        assert spark.range(5 * TEXTS).coalesce(1).mapInArrow(largest, "n long").first()["n"] <= TEXTS
        spark.conf.set(name, "7")
        assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 2
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
