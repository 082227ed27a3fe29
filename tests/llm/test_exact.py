"""op3 and the shared components against brute force."""

import hashlib
import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tessera.llm.common import Workspace
from tessera.llm.components import connected_components
from tessera.llm.exact import drop_exact_copies, exact_groups
from tessera.llm.queries import QUERIES, SQL

from .cases import documents, odd_rows

SF = "/root/testdata/sf0.001"


def lower(text):
    return (text or "").encode().lower()


def test_groups(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t, _ in rows:
        ids = groups[lower(t)]
        top = max((x for x in ids if x is not None), default=None)
        want.append((i, top, len(ids), i is not None and i == top, hashlib.sha256(lower(t)).hexdigest()))
    got = exact_groups(documents(spark, rows), salts=3)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_only_ascii_letters_fold(spark):
    got = {r.doc_id: r.group_size for r in exact_groups(documents(spark, [(1, "ÄB", "a"), (2, "äb", "a"), (3, "Äb", "a")])).collect()}
    assert got == {1: 2, 2: 1, 3: 2}


def test_empty_and_dropped(spark):
    empty = documents(spark, odd_rows()).limit(0)
    assert exact_groups(empty).count() == 0 and drop_exact_copies(empty).count() == 0
    docs = documents(spark, odd_rows())
    left = drop_exact_copies(docs)
    texts = [lower(r.text) for r in left.collect() if r.doc_id is not None]
    assert left.columns == docs.columns and len(texts) == len(set(texts)) == len({lower(t) for i, t, _ in odd_rows() if i is not None})
    assert left.where("doc_id IS NULL").count() == 1  # the other has equals with an id


def test_different_texts_of_one_digest(spark):
    """A digest that takes two values only: texts are told apart by content, at every stage and in the join back."""
    rows = odd_rows()
    docs = documents(spark, rows)
    weak = lambda norm: F.unhex(F.lpad(F.hex(F.length(norm) % 2), 64, "0"))
    assert sorted(map(tuple, exact_groups(docs, salts=3, digest=weak).collect()), key=repr) == sorted(map(tuple, exact_groups(docs, salts=3).collect()), key=repr)
    one = lambda norm: F.unhex(F.lpad(F.hex(F.xxhash64(norm)), 64, "0"))
    assert sorted(map(tuple, exact_groups(docs, salts=3, digest=one).collect()), key=repr) == sorted(map(tuple, exact_groups(docs, salts=3).collect()), key=repr)


def test_ids_that_name_several_texts(spark):
    """No unique text is lost; of repeated rows one stays, the same in any order."""
    rows = [(5, "alpha", "a"), (5, "beta", "b"), (5, "ALPHA", "c"), (5, "alpha", "a"), (4, "beta", "a"), (None, "gamma", "a"), (None, "gamma", "b"), (None, "beta", "a"), (None, "delta", "a")]
    found = [sorted(((r.doc_id, r.text, r.source) for r in drop_exact_copies(documents(spark, x, n)).collect()), key=repr) for x, n in ((rows, 3), (rows[::-1], 5))]
    assert found[0] == found[1]
    assert sorted(((i, t.lower()) for i, t, _ in found[0]), key=repr) == sorted([(5, "alpha"), (5, "beta"), (None, "delta"), (None, "gamma")], key=repr)


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in SQL.items():
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        got = QUERIES[name](spark, SF)
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall()), name


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)] + [(7, 7), (None, 3), (5, 4)]
    up = {x: x for a, b in links if a is not None for x in (a, b)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    got = connected_components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0
