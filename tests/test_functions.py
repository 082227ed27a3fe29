"""Scalar functions, pages, streams and readers on small cases."""

import json

from pyspark.sql import functions as F

from tessera.functions import period as P
from tessera.functions import text as X
from tessera.operators import commitments as C
from tessera.operators import ingest as N
from tessera.operators import search as R
from tessera.sources.files import chat_export, vault


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, X.normalize_label(lit("  A \t b\n"))) == "a b"
    assert one(spark, X.normalize_alias(lit("  A  b "))) == "a  b"
    assert one(spark, X.escape_xml(lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, X.contains_ci(lit("50% off_now"), "50%")) and not one(spark, X.contains_ci(lit("500 off"), "50%"))
    assert one(spark, X.first_line(lit("\n  \n hello \nx"))) == "hello" and one(spark, X.first_line(lit(" \n"))) is None
    assert one(spark, X.slugify(lit("Hello, World! "))) == "hello-world"
    assert one(spark, X.wikilinks_to_text(lit("[[a|b]] and [[c]]"))) == "b and c"
    assert one(spark, X.strip_front_matter(lit("---\nk: v\n---\nbody"))) == "body"
    assert one(spark, X.dice(lit("night"), lit("nacht"))) == 0.25
    assert one(spark, X.coerce_task_status(lit(" In-Progress "))) == "in_progress" and one(spark, X.coerce_task_status(lit("?"))) is None
    assert one(spark, X.label_with_aliases(lit("Ann"), F.array(lit("ann"), lit("A."), lit("a.")))) == "Ann (aka A.)"


def test_periods(spark):
    key = lambda d: one(spark, P.week_key(F.to_date(F.lit(d))))
    assert [key(d) for d in ("2021-01-03", "2020-12-31", "2024-12-30")] == ["2020-W53", "2020-W53", "2025-W01"]
    last = lambda k: str(one(spark, P.last_day_of(F.lit(k))))
    assert [last(k) for k in ("2020-W53", "2024-02", "2023", "2024-01-05")] == ["2021-01-03", "2024-02-29", "2023-12-31", "2024-01-05"]
    assert not one(spark, P.complete(F.lit("2024-02"), F.to_date(F.lit("2024-02-29"))))


def test_pages_concatenate_to_the_whole(spark):
    rows = spark.createDataFrame([(f"t{i}", None if i % 3 == 0 else f"2024-01-0{i % 5 + 1}") for i in range(20)], "id string, due string")
    for down in (False, True):
        seen, after = [], None
        while True:
            page = C.keyset_page(rows, "due", "id", 6, down, after).collect()
            seen += page[:6]
            if len(page) <= 6:
                break
            after = C.encode_cursor(page[5].due, page[5].id)
        order = rows.orderBy(F.col("due").desc_nulls_last() if down else F.col("due").asc_nulls_last(), F.desc("id") if down else "id").collect()
        assert seen == order


def test_due_qualifier(spark):
    read = lambda t, z: one(spark, C.due_qualifier(F.lit(json.dumps({"dueTime": t, "timeZone": z}))))
    assert tuple(read("09:30", "Europe/Oslo")) == ("09:30", "Europe/Oslo")
    assert read("9:30", "Europe/Oslo") is None and read("09:30", "nowhere") is None


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "red cars"), (2, "a blue car, big car"), (3, "old red big car"), (4, None)], "id int, t string")
    assert [r.id for r in R.lexical(docs, "t", 'blue "big car" OR red -old', 9, "id", fuzzy=False).collect()] == [1, 2]
    assert {r.id for r in R.lexical(docs, "t", "cars", 9, "id").collect()} == {1, 2, 3}


def test_chunks_keep_all_words():
    text = "# A\nintro\n\n## B\n" + "word " * 300 + "\n\n## C\nshort\n"
    chunks = N.pack_sections(text, 400)
    assert [c[:4] for c in chunks] == ["# A\n", "## B", "## C"] and len(chunks[1]) == len("## B\n" + "word " * 300) - 1  # no paragraph is cut
    assert N.pack_sections("# A\n\nx\n\n## B\n\ny\n\n## C\n\nz", 22) == ["# A\n\nx\n\n## B\n\ny", "## C\n\nz"]
    assert N.pack_sections("## B\n\n" + "p " * 10 + "\n\n### h\n\n" + "q " * 10, 30) == ["## B\n\np p p p p p p p p p", "### h\n\nq q q q q q q q q q"]
    assert " ".join(" ".join(chunks).split()).replace(" ", "") == "".join(text.split())
    assert N.pack_sections(None) == [] and N.pack_sections("plain") == ["plain"]


def test_readers(spark, tmp_path):
    chunks = [{"role": "user", "text": "hi", "createTime": "2024-01-01T00:00:00Z"}, {"role": "model", "text": "hm", "isThought": True}, {"role": "model", "text": " "}, {"role": "model", "text": "yes", "createTime": "2024-01-02T00:00:00Z"}]
    (tmp_path / "My Chat.json").write_text(json.dumps({"chunkedPrompt": {"chunks": chunks}}))
    assert sorted((r.role, r.text) for r in chat_export(spark, str(tmp_path)).collect()) == [("assistant", "yes"), ("user", "hi")]
    (tmp_path / "notes" / "deep").mkdir(parents=True)
    (tmp_path / "notes" / "deep" / "a.md").write_text("---\nk: v\n---\nsee [[b|that]] now")
    (tmp_path / "notes" / "b.txt").write_text("no")
    got = vault(spark, str(tmp_path / "notes"), exclude=("/private/",)).collect()
    assert [(r.text, r.words) for r in got] == [("see that now", 3)]


def test_json_merge(spark):
    got = json.loads(one(spark, N.merge_json(F.lit('{"title": "old", "a": "1"}'), {"title": F.lit("new"), "a": F.lit("2")}, keep=("title",))))
    assert got == {"title": "old", "a": "2"}


def test_local_instants(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from tessera.functions.period import day_start, local_instant

    rows = [("2024-07-01", "09:30", "Europe/Oslo"), ("2024-01-15", "23:59", "America/New_York"), ("2024-03-31", "12:00", "Asia/Tokyo"), ("2024-01-01", "24:00", "UTC"), ("x", "09:30", "UTC"), ("2024-01-01", "09:30", "nowhere")]
    df = spark.createDataFrame(rows, "d string, t string, z string").select("*", F.date_format(local_instant(F.col("d"), F.col("t"), F.col("z")), "yyyy-MM-dd HH:mm").alias("i"), F.date_format(day_start(F.col("d"), F.col("z")), "yyyy-MM-dd HH:mm").alias("s"))
    got = {(r.d, r.t, r.z): (r.i, r.s) for r in df.collect()}
    for d, t, z in rows[:3]:
        utc = lambda x, z=z: datetime.fromisoformat(x).replace(tzinfo=ZoneInfo(z)).astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%d %H:%M")
        assert got[d, t, z] == (utc(f"{d} {t}"), utc(f"{d} 00:00"))
    assert all(got[r][0] is None for r in rows[3:])
