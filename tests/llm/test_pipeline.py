from collections import Counter

import corpus_pipeline
from tests.llm.test_copies import brute_copies
from tests.llm.test_text_operators import brute_contained

from typeweave.llm import toxicity
from typeweave.llm.common import table
from typeweave.llm.queries import TOXIC_FROM, learned_labels


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").cache()
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == columns
    model = toxicity.fit(docs, learned_labels(spark, sf))
    scorer = model.scorer()
    import numpy as np

    score = {d: float(1 / (1 + np.exp(-np.array(scorer.text(t)) @ model.weights))) for d, t in before.items()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in score.items() if s < TOXIC_FROM}

    kept = stages["simhash near-dedup"](spark, docs, sf)
    top = brute_copies(sorted(before.items()))
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, t in top.items() if d == t)

    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    kept = stages["benchmark decontamination"](spark, docs, sf)
    bad = {d for d, *_ in brute_contained(before.items(), items)}
    assert bad and kept.columns == columns and {r["doc_id"] for r in kept.collect()} == set(before) - bad

    kept = stages["pii surrogates"](spark, docs, sf)
    rows = kept.collect()
    assert kept.columns == columns and {r["doc_id"] for r in rows} == set(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
    import re

    addresses = {m for t in before.values() for m in re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+\w", t)}
    assert addresses and not any(a in r["text"] for a in addresses for r in rows)
    assert all(r["text"] == before[r["doc_id"]] for r in rows if not re.search(r"[0-9@]", before[r["doc_id"]]))


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert {"doc_id", "size", "taken"} <= set(got.columns)
    assert 0 < len(rows) < table(spark, sf, "documents").count()
    assert max(Counter(r["doc_id"] for r in rows).values()) == 1


WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam".split()


def odd_tables(spark, path, *, rows=True):
    """Tables with nulls, empty and long texts, repeated rows and keys, and columns named like those of the operators."""
    from pyspark.sql import functions as F

    rng = __import__("random").Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item, near = text(30), text(80).split()
    docs = [(None, None), (None, None), (1, None), (2, ""), (3, " \t"), (4, text(60)), (4, text(60)), (5, text(40) + " " + item + " " + text(30)), (None, text(50) + " " + item), (None, text(70)), (6, " ".join(near)), (7, " ".join(near[:-1] + ["other"])), (8, text(20_000))]
    docs += [(9, "Dear Mrs. Anna Smith, write to anna@example.org"), (9, "Dear Mrs. Anna Smith, write to anna@example.org"), (10, docs[5][1])]
    frame = spark.createDataFrame([(i, t, "en", None if i is None or i % 2 else "a", len(t or "")) for i, t in docs] if rows else [], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "hits", "row", "mark", "found_mark", "tries", "few_id", "group", "n"):
        frame = frame.withColumn(c, F.lit(1))
    tables = {"documents": frame, "benchmark": spark.createDataFrame([(1, item), (None, None), (2, "")] if rows else [], "item_id long, text string"), "labels": spark.createDataFrame([(1, None, None), (None, 1, 1)] if rows else [], "doc_id long, quality int, toxic int")}
    tables["pages"] = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "x"), (2, "v", "x"), (3, "w", "")] if rows else [], "page_id long, url string, html string")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return docs, item


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs, item = odd_tables(spark, tmp_path)
    before = [(i, t or "") for i, t in docs]
    got = Counter((r["doc_id"], r["size"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # one row of each group of copies, the smallest key first and null last; then what contains the item goes
    sets, kept = [], []
    for i, t in sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        words = t.encode().lower().split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        if not any(len(own & x) >= 0.8 * len(own | x) - 1e-9 for x in sets):
            kept.append((i, t))
        sets.append(own)
    want = Counter((i, len(t.split())) for i, t in kept if item not in t)
    assert got == want


def test_queries_of_odd_and_empty_tables(spark, tmp_path):
    from typeweave.llm import queries as Q

    docs, _ = odd_tables(spark, tmp_path / "odd")
    odd_tables(spark, tmp_path / "empty", rows=False)
    for name, f in Q.queries().items():
        rows = f(spark, str(tmp_path / "odd")).collect()
        if name not in ("op3_decontamination", "pipeline"):
            assert len(rows) == (5 if name == "op10_warc" else len(docs)), name
        if "held_out" in (rows[0].asDict() if rows else {}):
            assert all(r["held_out"] is not None for r in rows), name
        assert f(spark, str(tmp_path / "empty")).count() == 0, name
