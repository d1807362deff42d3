"""What a step holds at once does not grow with the tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.test_graph import brute_components

from typeweave.operators import components, fixpoint, load
from typeweave.plans import catalog, loaders


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q11_components", "q12_primaries", "q12_two_primitives"])
def test_components_broadcast_no_table(spark, sf, name, monkeypatch):
    plans, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, what: plans.append(executed(df)) or real(df, what))
    monkeypatch.setattr(components, "_contracted", lambda links, number: real(links, "stars"))  # so that rounds are needed
    plans.append(executed(catalog.queries()[name](spark, sf)))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_a_task_of_many_edges_contracts_them_in_blocks(monkeypatch):
    monkeypatch.setattr(components, "LOCAL", 50)
    rng, taken = random.Random(5), []
    edges = [(x, rng.randrange(x)) for x in range(1, 1000)]
    batches = [pa.record_batch({"u": [u for u, _ in edges[i : i + 20]], "v": [v for _, v in edges[i : i + 20]]}) for i in range(0, len(edges), 20)]
    stars = []
    for out in components._stars(taken.append(b) or b for b in batches):
        assert out.num_rows <= 70 and len(taken) * 20 - len(stars) <= 90  # what was read is handed on soon
        stars += zip(*out.to_pydict().values(), strict=True)
    assert brute_components(stars) == brute_components(edges)


def tasks(df):
    """Tasks that have rows of df."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_members_are_dealt_out_by_their_number(spark, monkeypatch):
    die = loaders.entries(spark.range(400), "structure_type", goff="id")
    die = die.unionByName(loaders.entries(spark.range(4000), "member", goff=F.col("id") + 1000, parent=F.col("id") % 400, ord=F.col("id").cast("int"), member_loc="id", type_ref="id"))
    monkeypatch.setattr(fixpoint, "ROWS", 200)
    found = load.load_compounds(die, load.Config())
    assert 15 <= tasks(found) <= 20
    assert found.select("goff", F.size("members").alias("n")).distinct().agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (400, 10, 10)


def test_lines_are_dealt_out_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(fixpoint, "ROWS", 500)
    lines, orders = (catalog.table(spark, sf, t).count() for t in ("lineitem", "orders"))
    assert tasks(catalog.per_order(spark, sf)) == -(-(lines + orders) // 500)
