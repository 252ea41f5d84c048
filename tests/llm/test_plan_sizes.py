"""What the driver holds and plans at once: no written table's plan reads more than a few tables.

The driver keeps every plan of a running query, and each adaptive step plans and describes it anew, so a
table that one plan works out several times costs the driver memory by the plan's size times its steps.
"""

import random

import pytest

from tidewater.llm import common, components, near_dup, pii

#: Tables that one written plan may read.
MOST = 8


@pytest.fixture
def reads(monkeypatch):
    """The numbers of tables that the plans read which are written meanwhile."""
    found = []

    def materialise(df):
        found.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return common.materialise(df)

    for module in (components, near_dup, pii):
        monkeypatch.setattr(module, "materialise", materialise)
    return found


def test_near_duplicates(spark, reads):
    rng, texts = random.Random(5), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in rng.sample(range(60), rng.randrange(1, 4))]
    docs = common.materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, shingle=4, percent=80).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i, x in enumerate(sets):
            root[i] = min(root[j] for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y))
        if root == before:
            break
    assert found == dict(enumerate(root)) and len(set(root)) < len(texts)
    assert max(reads) <= MOST, reads


def test_chain_of_edges(spark, reads):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(7, 7), (90, 80)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(common.materialise(edges)).collect()}
    assert found == {i: 0 if i <= 30 else 31 for i in range(61)} | {80: 80, 90: 80}
    assert max(reads) <= MOST, reads


def test_sources(spark, reads):
    words = [f"t{i}" for i in range(40)]
    texts = spark.createDataFrame([(k, words[k : k + 30]) for k in range(4)] + [(9, [f"u{i}" for i in range(30)])], "__key long, terms array<string>")
    found = {r["__key"]: r["source"] for r in pii.sources(common.materialise(texts)).collect()}
    assert found and set(found) <= {1, 2, 3} and set(found.values()) <= {0, 1, 2}
    assert max(reads) <= MOST // 2, reads
