import itertools
import os
import random

import corpus_pipeline
from tests.llm.test_text_operators import docs_of

from typeweave.llm import copies
from typeweave.operators.fixpoint import scratch_dir


def brute_copies(rows, size=5, similarity=0.8):
    """doc_id -> smallest doc_id of its component, all pairs compared."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: top(i) for i in sets}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def corpus(seed=3):
    rng, texts = random.Random(seed), []
    line = "all rights reserved by the owners of this page and its parts".split()
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 6, 40, 150, 600]))] + (line if rng.random() < 0.5 else [])
        texts += [base, *(edited(rng, base, rng.choice([0, 1, 2, 3, len(base) // 40])) for _ in range(rng.randrange(4)))]
    crowd = [f"c{i}" for i in range(200)]
    texts += [edited(rng, crowd, k % 5) for k in range(80)]
    for _ in range(12):  # a chain: each like the one before it
        texts.append(crowd := edited(rng, crowd, 2))
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_copies_equal_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, " "), (1002, "Short text"), (1003, "short  TEXT")]
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs_of(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == brute_copies(rows)


def test_near_copies_of_odd_rows(spark):
    text = " ".join(map(str, range(50)))
    rows = [(None, text + " end", "en", "a"), (7, text, "en", "a"), (7, "something else", "en", "a"), (3, text.replace("49", "x"), "en", "b"), (None, "alone", "en", "b")]
    got = copies.near_copies(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (7, 3), (7, 7)]


def test_pipeline_drops_near_copies(spark):
    rows = corpus(5)
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    for name, stage in corpus_pipeline.STAGES:
        if "near-dedup" in name:
            docs = stage(spark, docs, "")
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, top in brute_copies(rows).items() if i == top}


def test_a_pair_meets_once(spark, tmp_path, monkeypatch):
    rng, real = random.Random(8), copies._crossing
    base = [f"b{i}" for i in range(1500)]
    other = [f"o{i}" if i % 40 == 0 else w for i, w in enumerate(base)]  # alike in most shingles, not in enough of them
    rows = [(i, " ".join(edited(rng, (base, other)[i % 2], 1))) for i in range(30)]

    def crossing(similarity):
        def run(batches):
            for batch in real(similarity)(batches):
                with open(tmp_path / str(os.getpid()), "a") as out:
                    out.writelines(f"{a} {b}\n" for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
                yield batch

        return run

    monkeypatch.setattr(copies, "_crossing", crossing)
    monkeypatch.setattr(copies, "COMMON", 1_000)  # no order of shingles that drops pairs by the place where they meet
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs_of(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == brute_copies(rows)
    met = [line for path in tmp_path.iterdir() for line in path.read_text().splitlines()]
    assert met and len(met) == len(set(met))


def test_near_dedup_leaves_no_tables_of_its_search(spark):
    before = set(os.listdir(scratch := scratch_dir(spark)))
    copies.one_of_each(docs_of(spark, [(i, t, "en", "a") for i, t in corpus(6)])).count()
    left = {name.split("-", 1)[1] for name in set(os.listdir(scratch)) - before}
    assert left <= {"dropped", "edges", "stars"}, left
