"""op12 against brute force, whatever the batches and levels."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import Workspace
from tessera.llm.lines import LineRuns, drop_lines
from tessera.llm.queries import QUERIES

from .cases import documents, sentence

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(BLANK).encode().lower().decode()


def plain(rows, least_chars=40, least_docs=5):
    held = defaultdict(list)
    for i, text in rows:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                held[key].append(i)
    tops = {k: max((x for x in ids if x is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if tops.get(key_of(x)) is None or (i is not None and i >= tops[key_of(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def cases(seed=5, n=60):
    rng = random.Random(seed)
    common = [sentence(rng, 12) for _ in range(6)] + ["мир " * 12, "x" * 39, "y" * 40, "Ünï " * 11 + "ß"]
    pick = lambda: rng.choice([lambda c: c, str.upper, lambda c: f" \t{c}\r", lambda c: c])(rng.choice(common))
    rows = [(i, "\n".join(pick() if rng.random() < 0.5 else sentence(rng, rng.randint(0, 20)) for _ in range(rng.randint(0, 9)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, " \n\t"), (904, common[0]), (904, common[0]), (904, f"{common[0]}\n{common[1]}"), (None, common[0]), (None, "\n".join(common)), (None, None)]
    rows += [(905, "\n".join([common[1]] * 3)), rows[0], rows[0], (906, "\n".join(sentence(rng, 15) for _ in range(3000))), (907, "a" * 300_000)]
    return rows + [(None, "only rows without an id hold this line, so that it stays")] * 6


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (6, 2), (5, 3)])
def test_against_brute_force(spark, batches, fan):
    rows = cases()
    got = drop_lines(spark, documents(spark, [(i, t, "a") for i, t in rows]), batches=batches, fan=fan)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[2] for r in want) > 50


def test_levels(spark):
    """Seven batches with a fan of two leave runs of levels 2, 1 and 0; what settled is left out of later runs."""
    index = LineRuns(Workspace(spark, "t"), least=2, fan=2)
    for k in range(7):
        lines = [("hot", 100 - k), ("hot", 90 - k), (f"own {k}", k), ("rising", k)]
        index.absorb(spark.createDataFrame(lines, "_hash string, _id long").withColumn("_hash", F.col("_hash").cast("binary")))
    assert {level: len(runs) for level, runs in index.levels.items() if runs} == {0: 1, 1: 1, 2: 1}
    found = {bytes(r["_hash"]).decode(): (r.docs, r.top) for r in index.repeated().collect()}
    assert found == {"hot": (2, 100), "rising": (7, 6)}
    plan = index.runs()[0].join(index.runs()[1], "_hash")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    index.drop()


def test_empty(spark):
    assert drop_lines(spark, documents(spark, [(1, "a", "b")]).limit(0)).count() == 0
    assert [tuple(r) for r in drop_lines(spark, documents(spark, [(1, None, None)])).collect()] == [(1, 1, 0, "")]


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, d) for i, n, d, _ in plain(rows)]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in QUERIES["op12_line_dedup"](spark, SF).collect()) == sorted(want)
