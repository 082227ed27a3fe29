"""The cleanup log: the cases of the data model, a user each, in one call."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.cleanup import OPERATION, apply_cleanup, components
from tessera.storage import new_folder, saved

CLAIM = "claim_id string, user_id string, subject_id string, object_id string, object_value string, predicate string, statement string, source_id string, scope string, asserted_by_kind string, asserted_by_id string, stated_at timestamp, valid_from timestamp, valid_to timestamp, status string, created_at timestamp, updated_at timestamp"
T0 = dt.datetime(2024, 1, 1)


class World:
    def __init__(self):
        self.ops, self.temps, self.claims, self.nodes, self.links, self.sources, self.aliases, self.allowed = [], [], [], [], [], [], [], []

    def node(self, user, name, kind="Person"):
        self.nodes.append((name, user, kind, name, T0))
        self.temps.append((user, "r", f"t_{name}", name))

    def source(self, user, name, scope="personal"):
        self.sources.append((name, user, scope))

    def claim(self, user, name, subject, predicate, target=None, value=None, kind="user", scope="personal", source="s", speaker=None, day=0, status="active"):
        at = T0 + dt.timedelta(days=day)
        self.claims.append((name, user, subject, target, value, predicate, f"says {name}", source, scope, kind, speaker, at, None, None, status, at, at))

    def op(self, user, kind, claim=None, cited=None, temp=None, other=None, removed=None, text=None, type=None, predicate=None, value=None, run="r"):  # noqa: A002
        self.ops.append((user, run, len(self.ops), kind, claim, cited, temp, other, removed, text, type, predicate, value))

    def apply(self, spark):
        make = spark.createDataFrame
        return apply_cleanup(
            make(self.ops, OPERATION), make(self.temps, "user_id string, run string, temp_id string, node_id string"), make(self.claims, CLAIM), make(self.nodes, "node_id string, user_id string, node_type string, label string, created_at timestamp"),
            make(self.links, "source_id string, node_id string"), make(self.sources, "source_id string, user_id string, scope string"), make(self.aliases, "user_id string, alias_text string, normalized_alias_text string, node_id string"),
            F.lit("2025-01-01").cast("timestamp"), make(self.allowed, "user_id string, run string, claim_id string"),
        )


@pytest.fixture(scope="module")
def after(spark):
    w = World()
    w.node("u1", "alice")
    w.claim("u1", "c1", "alice", "HAS_STATUS", value="active", kind="assistant_inferred")
    w.claim("u1", "c2", "alice", "HAS_ATTRIBUTE", value="tall")
    w.op("u1", "retract_claim", "c1")
    w.op("u1", "retract_claim", "c2")
    w.op("u1", "retract_claim", "missing")
    w.node("u2", "ada"), w.node("u2", "lamp", "Object")
    w.claim("u2", "c3", "ada", "LOCATED_IN", "lamp")  # a shape that can't be: may be retracted whoever said it
    w.op("u2", "retract_claim", "c3")
    w.node("u3", "bob")
    for name, kind, scope in (("c4", "user", "personal"), ("c5", "user", "personal"), ("c6", "assistant_inferred", "personal"), ("c7", "user", "reference")):
        w.claim("u3", name, "bob", "HAS_ATTRIBUTE", value=name, kind=kind, scope=scope)
    for cited in ("c4", "c6", "c7", "gone", "c5"):
        w.op("u3", "contradict_claim", "c4", cited)
    w.op("u3", "contradict_claim", "c5", "c4")  # c4 is contradicted by now
    w.node("u4", "orphan"), w.node("u4", "busy"), w.node("u4", "speaker"), w.node("u4", "linked"), w.node("u4", "named")
    w.claim("u4", "c8", "busy", "HAS_ATTRIBUTE", value="x", speaker="speaker", kind="participant")
    w.links.append(("s4", "linked")), w.source("u4", "s4"), w.aliases.append(("u4", "Nick", "nick", "named"))
    for name in ("orphan", "busy", "speaker", "linked", "named", "nobody"):
        w.op("u4", "delete_node", temp=f"t_{name}")
    w.op("u4", "remove_alias", temp="t_named", text=" NICK")
    w.op("u4", "delete_node", temp="t_named")
    w.node("u5", "carol"), w.node("u5", "paris", "Location"), w.source("u5", "s5", "reference")
    w.claim("u5", "c9", "carol", "HAS_ATTRIBUTE", value="y", source="s5", scope="reference")
    w.op("u5", "add_claim", cited="c9", temp="t_carol", other="t_paris", predicate="LOCATED_IN", text="Carol lives in Paris")
    w.op("u5", "add_claim", temp="t_carol", value="z", predicate="HAS_GOAL", text="goal")
    w.op("u5", "add_claim", temp="t_carol", predicate="HAS_GOAL", text="neither")
    w.op("u5", "add_claim", temp="t_who", value="z", predicate="HAS_GOAL", text="unknown")
    w.op("u5", "add_claim", temp="t_paris", other="t_carol", predicate="LOCATED_IN", text="misshapen")
    w.op("u5", "add_alias", temp="t_carol", text="Caz "), w.op("u5", "add_alias", temp="t_carol", text="caz")
    for n in ("a", "b", "c", "d"):
        w.node("u6", f"m{n}")
    w.node("u6", "task", "Task"), w.node("u6", "ref"), w.source("u6", "s6", "reference"), w.links.append(("s6", "ref"))
    w.claim("u6", "c10", "mb", "AFFILIATED_WITH", "ma"), w.claim("u6", "c11", "mb", "HAS_ATTRIBUTE", value="q", source="s"), w.claim("u6", "c12", "ma", "HAS_ATTRIBUTE", value="q", source="s", day=1)
    w.op("u6", "merge_nodes", temp="t_ma", removed=["t_mb"])
    w.op("u6", "merge_nodes", temp="t_mc", removed=["t_mb", "t_nothing"])  # t_mb is ma now
    w.op("u6", "merge_nodes", temp="t_mc", removed=["t_task"])
    w.op("u6", "merge_nodes", temp="t_mc", removed=["t_ref"])
    w.op("u6", "merge_nodes", temp="t_mc", removed=["t_ma"])
    w.op("u6", "add_claim", temp="t_mb", value="new", predicate="HAS_GOAL", text="of the survivor")
    w.op("u6", "create_node", temp="t_new", text="Dora", type="Person")
    w.op("u6", "merge_nodes", temp="t_new", removed=["t_md"])
    w.op("u6", "delete_node", temp="t_md")
    w.node("u7", "erin"), w.source("u7", "s7")
    w.claim("u7", "c13", "erin", "HAS_STATUS", value="busy", kind="assistant_inferred"), w.claim("u7", "c14", "erin", "HAS_PREFERENCE", value="tea", kind="assistant_inferred"), w.claim("u7", "c15", "erin", "HAS_PREFERENCE", value="milk")
    for c, s in (("c13", "s7"), ("c14", "s7"), ("c15", "s7"), ("c14", "s_none"), ("c_none", "s7")):
        w.op("u7", "promote_assertion", c, s)
    w.op("u7", "contradict_claim", "c15", "c13")  # superseded by the promoted copy
    w.node("u8", "finn")
    w.claim("u8", "c16", "finn", "HAS_ATTRIBUTE", value="1", kind="assistant_inferred"), w.claim("u8", "c17", "finn", "HAS_ATTRIBUTE", value="2", kind="assistant_inferred")
    w.allowed.append(("u8", "r", "c16"))
    w.op("u8", "retract_claim", "c17"), w.op("u8", "contradict_claim", "c16", "c17"), w.op("u8", "promote_assertion", "c17", "s"), w.op("u8", "retract_claim", "c16")
    w.op("u8", "retract_claim", "c16", run="r0")  # an earlier run of the same group, which is free
    result = w.apply(spark)
    outcomes = {}
    for r in sorted(result.outcomes.collect(), key=lambda r: r.seq):
        outcomes.setdefault(r.user_id, []).append((r.outcome, r.message))
    return result, outcomes, {r.claim_id: r for r in result.claims.collect()}


def kinds(outcomes, user):
    return "".join(o[0][0] for o in outcomes[user])


def test_retract(after):
    _, outcomes, claims = after
    assert kinds(outcomes, "u1") == "aes" and claims["c1"].status == "retracted" and claims["c2"].status == "active" and "refused for user claim" in outcomes["u1"][1][1]
    assert kinds(outcomes, "u2") == "a" and claims["c3"].status == "retracted"


def test_contradict(after):
    _, outcomes, claims = after
    assert kinds(outcomes, "u3") == "eeeeae" and claims["c4"].status == "contradicted" and claims["c5"].status == "active"
    assert [part in m for part, (_, m) in zip(("same claim", "source-backed", "scope mismatch", "not found"), outcomes["u3"], strict=False)] == [True] * 4 and "expected active" in outcomes["u3"][5][1]


def test_delete(after):
    result, outcomes, _ = after
    assert kinds(outcomes, "u4") == "aeeeesaa"
    assert "claims=1, sourceLinks=0, aliases=0" in outcomes["u4"][2][1] and "sourceLinks=1" in outcomes["u4"][3][1] and "aliases=1" in outcomes["u4"][4][1]
    assert {r.node_id for r in result.nodes.where("user_id = 'u4'").collect()} == {"busy", "speaker", "linked"}


def test_add(after):
    result, outcomes, claims = after
    assert kinds(outcomes, "u5") == "aaeseaa"
    made = {c.statement: c for c in claims.values() if c.user_id == "u5" and c.claim_id.startswith("clm_")}
    assert {(c.predicate, c.object_id, c.scope, c.asserted_by_kind) for c in made.values()} == {("LOCATED_IN", "paris", "reference", "system"), ("HAS_GOAL", None, "personal", "system")}
    assert [(r.normalized_alias_text, r.alias_text) for r in result.aliases.where("user_id = 'u5'").collect()] == [("caz", "Caz")]


def test_merge(after):
    result, outcomes, claims = after
    assert kinds(outcomes, "u6") == "aaseaaaaa"  # the fifth names a node that is gone: nothing merges, its temporary id moves on
    assert {(r.from_id, r.to_id) for r in result.redirects.collect() if r.from_id in ("ma", "mb")} == {("ma", "mc"), ("mb", "mc")}
    assert "c10" not in claims and claims["c11"].subject_id == "mc" and "c12" not in claims  # a claim between the merged, and one that became equal to an earlier one
    assert [c.subject_id for c in claims.values() if c.statement == "of the survivor"] == ["mc"]
    nodes = {r.node_id: r.label for r in result.nodes.where("user_id = 'u6'").collect()}
    assert set(nodes.values()) == {"mc", "task", "ref"}  # the new node took in md, and went by md's temporary id


def test_promote(after):
    _, outcomes, claims = after
    assert kinds(outcomes, "u7") == "aaeeee" and "superseded, expected active" in outcomes["u7"][5][1]
    copies = {c.predicate: c for c in claims.values() if c.user_id == "u7" and c.claim_id.startswith("clm_")}
    assert all(c.asserted_by_kind == "user_confirmed" and c.status == "active" and c.source_id == "s7" for c in copies.values())
    assert claims["c13"].status == "superseded" and claims["c13"].superseded_by == copies["HAS_STATUS"].claim_id and claims["c14"].status == "active" and copies["HAS_PREFERENCE"].statement == "says c14"


def test_bounds_and_counts(after):
    result, outcomes, claims = after
    assert kinds(outcomes, "u8") == "eeeaa" and claims["c16"].status == "retracted" and claims["c17"].status == "active"
    counts = {(r.user_id, r.run): (r.applied, r.skipped, r.errors, r.affected) for r in result.counts().collect()}
    assert counts["u8", "r"] == (1, 0, 3, []) and counts["u8", "r0"] == (1, 0, 0, []) and counts["u5", "r"][:3] == (4, 1, 2) and counts["u5", "r"][3] == ["carol", "paris"]
    assert len(counts["u6", "r"][3]) == 3


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "z"), ("q", "q")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string"), new_folder(spark, "t")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(41)}, "x": "x", "y": "x", "z": "x", "q": "q"}


def test_runs_that_share_nothing_make_no_edges(spark, monkeypatch):
    """Runs of one user that only read a common node are groups of their own; the components see no row of them."""
    from tessera.operators import cleanup

    w, edges = World(), []
    w.node("u", "part", "Object")
    for n in range(4):
        w.node("u", f"task{n}", "Task")
        w.claim("u", f"k{n}", f"task{n}", "RELATED_TO", "part", kind="assistant_inferred")
        w.op("u", "retract_claim", f"k{n}", run=f"r{n}")
    w.op("u", "retract_claim", "k3", run="r9")  # shares a claim with r3
    w.allowed.append(("u", "r0", "k0"))
    w.links.append(("s", "part")), w.source("u", "s"), w.aliases.append(("u", "P", "p", "part"))
    found = cleanup.components
    monkeypatch.setattr(cleanup, "components", lambda e, folder: found(edges.append(e.count()) or e, folder))
    result = w.apply(spark)
    assert edges[0] <= 2 and {r.status for r in result.claims.collect()} == {"retracted"}


def claims_only() -> World:
    """Random runs that only retract and contradict: chains, shapes, claims that several runs name, and some that are missing."""
    draw, w = random.Random(7), World()
    for u in ("u1", "u2"):
        for i in range(6):
            w.node(u, f"{u}p{i}"), w.node(u, f"{u}t{i}", "Task"), w.node(u, f"{u}d{i}", "Temporal")
        for i in range(60):
            predicate = draw.choice(("HAS_STATUS", "DUE_ON", "LOCATED_IN", "RELATED_TO", "ASSIGNED_TO", "HAS_GOAL"))
            target = None if predicate.startswith("HAS") else f"{u}{draw.choice('ptd')}{draw.randrange(6)}"
            w.claim(u, f"{u}c{i}", f"{u}{draw.choice('ptx')}{draw.randrange(6)}", predicate, target, None if target else f"v{i}", draw.choice(("user", "assistant_inferred", "participant")), draw.choice(("personal", "personal", "reference")), day=i % 9, status=draw.choice(("active", "active", "superseded")))
        for i in range(80):
            a, b = (f"{u}c{min(int(draw.expovariate(0.04)), 61)}" for _ in range(2))
            w.op(u, *draw.choice((("retract_claim", a), ("contradict_claim", a, b))), run=f"r{draw.randrange(30)}")
    return w


def test_operations_on_claims_see_what_all_would(spark, monkeypatch):
    """Groups that only retract and contradict see few rows; the outcome is the one with all rows."""
    from tessera.operators import cleanup

    found = []
    for kinds_of_claims in (cleanup.OF_CLAIMS, ()):
        monkeypatch.setattr(cleanup, "OF_CLAIMS", kinds_of_claims)
        result = claims_only().apply(spark)
        found.append([sorted(map(repr, df.collect())) for df in (result.outcomes, result.claims)])
    assert found[0] == found[1] and len({r.split("outcome=")[1][:7] for r in found[0][0]}) == 3


def test_operations_on_claims_read_no_nodes(spark, monkeypatch):
    """What groups that only retract and contradict see grows with the claims they name, not with the nodes at their ends."""
    from tessera.operators import cleanup

    w, written = World(), {}
    for n in range(20):
        w.node("u", f"task{n}", "Task"), w.node("u", f"part{n}", "Object")
        w.claim("u", f"k{n}", f"task{n}", "RELATED_TO", f"part{n}", kind="assistant_inferred")
        w.op("u", "retract_claim", f"k{n}", run=f"r{n}")

    def spy(df, path):
        out = saved(df, path)
        written[path.split("/")[-1]] = out.count()
        return out

    monkeypatch.setattr(cleanup, "saved", spy)
    assert {r.status for r in w.apply(spark).claims.collect()} == {"retracted"}
    assert max(written.values()) == written["done"] == 40  # an outcome and an effect each; no table holds the ends
