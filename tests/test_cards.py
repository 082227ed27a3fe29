"""The card search on small hand-made graphs."""

from pyspark.sql import functions as F

from tessera.operators.search import card_search, memory_search

_CLAIM = "claim_id string, user_id string, subject_id string, object_id string, object_value string, predicate string, statement string, source_id string, scope string, asserted_by_kind string, stated_at timestamp, valid_from timestamp, valid_to timestamp, status string"


def search(spark, nodes, vectors, claims, claim_vectors, links=(), sources=(), scope="personal", limit=2):
    n = spark.createDataFrame([(i, "u", "Object", label) for i, label in nodes], "node_id string, user_id string, node_type string, label string")
    v, cv = (spark.createDataFrame(x, f"{c} string, embedding array<double>") for x, c in ((vectors, "node_id"), (claim_vectors, "claim_id")))
    rows = [(i, "u", s, o, None, "KNOWS", f"{s} {o}", f"src{i}", sc, kind, None, None, None, status) for i, s, o, sc, kind, status in claims]
    c = spark.createDataFrame(rows, _CLAIM)
    ln, sr = spark.createDataFrame(list(links), "source_id string, node_id string"), spark.createDataFrame([(i, "u", s) for i, s in sources], "source_id string, user_id string, scope string")
    aliases = spark.createDataFrame([], "node_id string, alias_text string")
    cards, evidence = card_search(n, v, c, cv, ln, sr, aliases, [1.0, 0.0], limit, scope, 0.4, "u", at=F.lit("2020-01-01").cast("timestamp"))
    return [(r.pos, r.node_id, r.scope) for r in cards.orderBy("pos").collect()], [(r.claim_id, r.source_id) for r in evidence.orderBy("pos").collect()]


NODES = [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")]
VECTORS = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.8, 0.3]), ("d", [-1.0, 0.0])]


def test_later_candidates_move_up(spark):
    """a and b are similar, but b is reference; the subject of the best claim takes its place, which similarity alone would not find."""
    claims = [("1", "d", "a", "personal", "user", "active"), ("2", "b", "b", "reference", "user", "active")]
    cards, evidence = search(spark, NODES, VECTORS, claims, [("1", [1.0, 0.1]), ("2", [1.0, 0.0])])
    assert cards == [(0, "a", "personal"), (1, "d", "personal")] and evidence == [("1", "src1")]


def test_reference_only(spark):
    """A node with one personal signal is personal, be it of a claim that no longer holds; evidence follows the cards."""
    claims = [("1", "b", "c", "reference", "user", "active"), ("2", "c", None, "personal", "user", "retracted"), ("3", "a", None, "personal", "user", "active")]
    cards, evidence = search(spark, NODES, VECTORS, claims, [("1", [1.0, 0.0]), ("3", [1.0, 0.0])], scope="reference", limit=3)
    assert cards == [(0, "b", "reference")] and evidence == [("1", "src1")]
    cards, _ = search(spark, NODES, VECTORS, claims, [], [("s", "b")], [("s", "personal")], scope="reference", limit=3)
    assert cards == []


def test_inferred_and_far_claims_give_nothing(spark):
    claims = [("1", "a", "d", "personal", "assistant_inferred", "active"), ("2", "b", "d", "personal", "user", "active")]
    cards, evidence = search(spark, NODES[:3], VECTORS, claims, [("1", [1.0, 0.0]), ("2", [0.0, 1.0])], limit=5)
    assert cards == [(0, "a", "personal"), (1, "b", "personal")] and evidence == []


def test_empty(spark):
    assert search(spark, [], [], [], []) == ([], [])


def test_the_claims_of_the_user_are_made_once(spark):
    """Both searches read them in several steps; what makes them runs once, and other users' claims don't count."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("1", "u", "a", "b"), ("2", "u", "b", "c"), ("3", "v", "a", "d")]
    c = spark.createDataFrame([(i, u, s, o, None, "KNOWS", "x", "src", "personal", "user", None, None, None, "active") for i, u, s, o in rows], _CLAIM)
    c = c.mapInArrow(count, c.schema)
    n = spark.createDataFrame([(i, "u", "Object", label) for i, label in NODES], "node_id string, user_id string, node_type string, label string")
    v, cv = spark.createDataFrame(VECTORS, "node_id string, embedding array<double>"), spark.createDataFrame([("1", [1.0, 0.0]), ("3", [1.0, 0.0])], "claim_id string, embedding array<double>")
    ln, sr = spark.createDataFrame([], "source_id string, node_id string"), spark.createDataFrame([], "source_id string, user_id string, scope string")
    at = F.lit("2020-01-01").cast("timestamp")
    found = memory_search(n, v, c, cv, ln, sr, [1.0, 0.0], 1, 0.4, "u", at=at).collect()
    assert sorted((r.kind, r.id) for r in found) == [("claim", "1"), ("neighbour", "c"), ("node", "a")] and seen.value == 3
    cards, evidence = card_search(n, v, c, cv, ln, sr, spark.createDataFrame([], "node_id string, alias_text string"), [1.0, 0.0], 2, "personal", 0.4, "u", at=at)
    assert [r.node_id for r in cards.orderBy("pos").collect()] == ["a", "b"] and [r.claim_id for r in evidence.collect()] == ["1"] and seen.value == 6
