"""Supersession scenarios and the invariants of its result."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators.lifecycle import apply_lifecycle, recompute, supersede
from tessera.schema import CLAIMS, validate_claims

DAY0 = datetime(2024, 1, 1)


def claim(i, day, kind="user", value="v", subject="s", status="active", created=None, predicate="HAS_STATUS", **more):
    at = DAY0 + timedelta(days=day)
    return {"claim_id": f"c{i}", "user_id": "u", "subject_id": subject, "object_id": None, "object_value": value, "predicate": predicate, "statement": "", "source_id": "x", "scope": "personal", "asserted_by_kind": kind, "asserted_by_id": None, "stated_at": at, "valid_from": None, "valid_to": None, "status": status, "created_at": created or at, "updated_at": at} | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], CLAIMS)


def resolved(spark, rows):
    return {r.claim_id: r for r in supersede(frame(spark, rows)).collect()}


def test_chain(spark):
    got = resolved(spark, [claim(1, 0), claim(3, 4), claim(2, 2)])
    assert [got[f"c{i}"].resolved_status for i in (1, 2, 3)] == ["superseded", "superseded", "active"]
    assert [got[f"c{i}"].superseded_by for i in (1, 2, 3)] == ["c2", "c3", None]
    assert got["c1"].resolved_to == DAY0 + timedelta(days=2) and got["c3"].resolved_to is None


def test_inferred_does_not_overrule_the_user(spark):
    got = resolved(spark, [claim(1, 0), claim(2, 1, "assistant_inferred")])
    assert got["c1"].resolved_status == "active" and got["c2"].demoted
    assert got["c2"].superseded_by == "c1" and got["c2"].resolved_to == got["c2"].stated_at


def test_only_one_is_demoted(spark):
    got = resolved(spark, [claim(1, 0), claim(2, 1, "assistant_inferred"), claim(3, 2, "assistant_inferred")])
    assert got["c2"].resolved_status == "active" and got["c3"].demoted and got["c3"].superseded_by == "c2"


@pytest.mark.parametrize("kind", ["participant", "document_author", "system", "assistant_inferred"])
def test_others_may_be_overruled(spark, kind):
    assert resolved(spark, [claim(1, 0, kind), claim(2, 1, "assistant_inferred")])["c2"].resolved_status == "active"


def test_ties_go_to_trust_then_id(spark):
    got = resolved(spark, [claim(1, 0, "user"), claim(2, 0, "system"), claim(3, 0, "participant")])
    assert got["c1"].resolved_status == "active"


def test_head_keeps_its_end_unless_it_was_superseded(spark):
    end = DAY0 + timedelta(days=9)
    assert resolved(spark, [claim(1, 0, valid_to=end)])["c1"].resolved_to == end
    assert resolved(spark, [claim(1, 0, valid_to=end, status="superseded")])["c1"].resolved_to is None


def test_recompute_equals_a_full_run(spark):
    rows = [claim(i, i % 7, ("user", "assistant_inferred", "system")[i % 3], subject=f"s{i % 4}") for i in range(40)]
    late = [claim(100, 3, subject="s1"), claim(101, 20, "assistant_inferred", subject="s2")]
    part = recompute(apply_lifecycle(frame(spark, rows)), frame(spark, late))
    whole = apply_lifecycle(frame(spark, rows + late))
    assert sorted(part.select(*whole.columns).collect()) == sorted(whole.collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["user", "assistant_inferred", "participant"]), st.integers(0, 2)), min_size=1, max_size=15))
def test_one_active_row_a_key_and_no_overlap(spark, items):
    got = resolved(spark, [claim(i, d, k, subject=f"s{s}") for i, (d, k, s) in enumerate(items)])
    for s in {r.subject_id for r in got.values()}:
        own = [r for r in got.values() if r.subject_id == s]
        assert sum(r.resolved_status == "active" for r in own) == 1
        spans = sorted((r.resolved_from, r.resolved_to or datetime.max) for r in own if not r.demoted)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_validation(spark):
    good, bad = validate_claims(frame(spark, [claim(1, 0), claim(2, 0, scope="x"), claim(3, 0, object_id="o"), claim(4, 0, "participant")]))
    assert [r.claim_id for r in good.collect()] == ["c1"]
    assert {r.claim_id: r.broken for r in bad.collect()} == {"c2": ["scope"], "c3": ["object_xor_value"], "c4": ["participant_speaker"]}
