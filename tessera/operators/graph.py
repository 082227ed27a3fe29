"""Graph operators: neighbourhoods, timelines, change feeds, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.period import DAY
from ..storage import new_folder, saved
from ..vocab import STRUCTURAL_TYPES
from .filters import endpoints, in_scope, without_inferred


def both_ways(claims: DataFrame) -> DataFrame:
    """Edges from either end: (node_id, other_id, claim_id, predicate, stated_at). Two equi-joinable halves instead of a join with OR."""
    edges = claims.where(F.col("object_id").isNotNull())
    half = lambda a, b: edges.select(F.col(a).alias("node_id"), F.col(b).alias("other_id"), "claim_id", "predicate", "stated_at")
    return half("subject_id", "object_id").unionByName(half("object_id", "subject_id").where("node_id <> other_id"))


def one_hop(claims: DataFrame, nodes: DataFrame, seeds: DataFrame, limit: int | None = 50, user_id: str | None = None, reference: bool = False, inferred: bool = False) -> DataFrame:
    """Labelled neighbours of seed nodes by active claims, each once with its smallest claim, seeds left out, in order of id.

    Personal claims that the assistant didn't infer; ``reference`` and ``inferred`` add the others. user_id: only that user's claims."""
    ids = seeds.select("node_id").distinct()
    usable = claims.where((F.col("status") == "active") & F.col("object_id").isNotNull())
    usable = usable.where(F.col("user_id") == user_id) if user_id else usable
    usable = in_scope(usable, include_reference=reference)
    usable = usable if inferred else without_inferred(usable)
    near = both_ways(usable).join(ids, "node_id", "left_semi").groupBy(F.col("other_id").alias("id")).agg(F.min("claim_id").alias("claim_id"))
    near = near.join(ids.withColumnRenamed("node_id", "id"), "id", "left_anti")
    out = nodes.where(F.col("label").isNotNull()).join(near.withColumnRenamed("id", "node_id"), "node_id").select("node_id", "node_type", "label", "claim_id").orderBy("node_id")
    return out if limit is None else out.limit(limit)


def ego(claims: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` steps of the seeds, with their distance."""
    edges = both_ways(claims).select("node_id", "other_id")
    found = seeds.select("node_id", F.lit(0).alias("hop")).distinct()
    frontier = found
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select("node_id"), "node_id", "left_semi").select(F.col("other_id").alias("node_id")).distinct()
        frontier = step.join(found, "node_id", "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(frontier)
    return found


def subgraph(claims: DataFrame, seeds: DataFrame, max_nodes: int, max_hops: int = 3) -> DataFrame:
    """The first ``max_nodes`` nodes in order of (distance, id); hops are bounded, so the plan is too."""
    return ego(claims, seeds, max_hops).orderBy("hop", "node_id").limit(max_nodes)


def claims_between(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims with both ends in a set of nodes."""
    inside = ids.select("node_id").distinct()
    return claims.join(inside.withColumnRenamed("node_id", "subject_id"), "subject_id", "left_semi").join(inside.withColumnRenamed("node_id", "object_id"), "object_id", "left_semi")


def labelled(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with the labels of both ends; values have no object label."""
    s, o = (nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("label").alias(f"{k}_label")) for k in ("subject", "object"))
    return claims.join(s, "subject_id", "left").join(o, "object_id", "left")


def by_type(nodes: DataFrame, node_type: str, limit: int = 200) -> DataFrame:
    """The newest labelled nodes of a type."""
    return nodes.where((F.col("node_type") == node_type) & F.col("label").isNotNull()).orderBy(F.desc("created_at"), "node_id").limit(limit)


def sources_of_nodes(links: DataFrame) -> DataFrame:
    return links.groupBy("node_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def timeline(claims: DataFrame, nodes: DataFrame, limit: int, offset: int = 0, types: tuple[str, ...] | None = None) -> DataFrame:
    """Days, newest first, with how many nodes touch each (all of them) and the list of those of the given types."""
    days = nodes.where((F.col("node_type") == "Temporal") & F.col("label").rlike(DAY)).select(F.col("node_id").alias("day_id"), F.col("label").alias("day"))
    page = days.orderBy(F.desc("day")).offset(offset).limit(limit)
    touched = both_ways(claims).join(page.withColumnRenamed("day_id", "node_id"), "node_id").select("day", F.col("other_id").alias("node_id")).distinct()
    shown = touched.join(nodes.select("node_id", "node_type", "label"), "node_id")
    wanted = F.col("node_type").isin(*types) if types else F.lit(True)
    per_day = shown.groupBy("day").agg(F.count(F.lit(1)).alias("node_count"), F.array_sort(F.collect_list(F.when(wanted, F.col("node_id")))).alias("nodes"))
    return page.join(per_day, "day", "left").select("day", F.coalesce("node_count", F.lit(0)).alias("node_count"), "nodes")


def nodes_on_day(claims: DataFrame, nodes: DataFrame, day: str, types: tuple[str, ...] = (), user_id: str | None = None, limit: int | None = 50, reference: bool = False, inferred: bool = False) -> DataFrame:
    """The first ``limit`` neighbours of a day (None: all), of these those of some types; by which claims is as in one_hop."""
    days = nodes.where(F.col("user_id") == user_id) if user_id else nodes
    seed = days.where((F.col("node_type") == "Temporal") & (F.col("label") == day)).select("node_id")
    near = one_hop(claims, nodes, seed, limit, user_id, reference, inferred)
    return near.where(F.col("node_type").isin(*types)) if types else near


def day_report(claims: DataFrame, nodes: DataFrame, day: str, user_id: str) -> DataFrame:
    """What active claims connect with a day of a user, as one text: day, node_count, text. Nodes stand once under each predicate, in order of predicate and id."""
    own = nodes.where(F.col("user_id") == user_id)
    seed = own.where((F.col("node_type") == "Temporal") & (F.col("label") == day)).select("node_id")
    active = claims.where((F.col("user_id") == user_id) & (F.col("status") == "active") & F.col("object_id").isNotNull())
    hits = both_ways(active).join(seed, "node_id", "left_semi").select("predicate", F.col("other_id").alias("node_id")).distinct().join(own, "node_id")
    description = F.coalesce("description", F.lit("")) if "description" in own.columns else F.lit("")
    line = F.concat(F.lit("- **"), F.coalesce("label", F.lit("Unnamed")), F.lit("** (id: "), "node_id", F.lit("): "), description, F.lit("\n"))
    lines = hits.groupBy("predicate").agg(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))).alias("found"))
    parts = lines.select("predicate", F.transform("found", lambda x: x["node_id"]).alias("ids"), F.concat(F.lit("## "), "predicate", F.lit("\n\n"), F.array_join(F.transform("found", lambda x: x["line"]), ""), F.lit("\n")).alias("part"))
    whole = parts.groupBy(F.lit(day).alias("day")).agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("node_count"), F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("day", "node_count", F.concat(F.lit(f"# Memories from {day}\n\n"), F.array_join("parts", "")).alias("text"))


def recent_changes(claims: DataFrame, nodes: DataFrame, sources: DataFrame, user_id: str, since: Column, until: Column, limit: int, types: tuple[str, ...] = ()) -> DataFrame:
    """What is new in a user's memory within [since, until], as three feeds of rows (feed, id, change, at, label), each newest first by ``place``.

    claim: active personal claims created or updated then, at most ``limit``; with ``types`` those with such a node at one of their ends. node: nodes created then, and older ones that one of those claims touches,
    at most ``limit`` together, of ``types`` or else of any type but the structural ones. source: where those claims come from, titled by title or file name. A row created in the window is added, another updated.
    """
    work = new_folder(nodes.sparkSession, "changes")
    inside = lambda c: F.col(c).between(since, until)
    own = nodes.where(F.col("user_id") == user_id)
    fit = F.col("node_type").isin(*types) if types else ~F.col("node_type").isin(*STRUCTURAL_TYPES)
    rows = claims.where((F.col("user_id") == user_id) & (F.col("status") == "active") & (F.col("scope") == "personal") & (inside("created_at") | inside("updated_at")))
    end = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("label").alias(f"_{side}"), F.col("node_type").alias(f"_{side}_type"))
    rows = rows.join(end("subject"), "subject_id")
    if types:
        rows = rows.join(end("object"), "object_id", "left").where(F.col("_subject_type").isin(*types) | F.coalesce(F.col("_object_type").isin(*types), F.lit(False)))
    changed = F.when(F.col("created_at") >= since, "added").otherwise("updated")
    rows = rows.withColumn("at", F.greatest("created_at", "updated_at")).orderBy(F.desc("at"), "claim_id").limit(limit)
    said = saved(rows.select("claim_id", "subject_id", "object_id", "source_id", "at", changed.alias("change"), F.col("_subject").alias("label")), f"{work}/claims")  # at most ``limit`` rows, read three times
    touched = endpoints(said).groupBy("node_id").agg(F.max("at").alias("at"))
    added = own.where(inside("created_at") & fit).orderBy(F.desc("created_at"), "node_id").limit(limit).select("node_id", F.lit("added").alias("change"), F.col("created_at").alias("at"), "label")
    older = own.where((F.col("created_at") < since) & fit).join(touched, "node_id").select("node_id", F.lit("updated").alias("change"), "at", "label")
    n = added.unionByName(older).orderBy(F.desc("at"), "node_id").limit(limit)
    text = lambda c: F.nullif(F.trim(F.get_json_object("metadata", f"$.{c}")), F.lit(""))
    s = sources.where(F.col("user_id") == user_id).join(said.select("source_id").distinct(), "source_id", "left_semi")
    s = s.select("source_id", F.lit(None).cast("string").alias("change"), F.coalesce("last_ingested_at", "created_at").alias("at"), F.coalesce(text("title"), text("filename")).alias("label"))
    feeds = (("claim", said, "claim_id"), ("node", n, "node_id"), ("source", s, "source_id"))
    parts = [df.select(F.lit(feed).alias("feed"), F.col(key).alias("id"), "change", "at", "label") for feed, df, key in feeds]
    order = W.partitionBy("feed").orderBy(F.desc("at"), "id")  # at most ``limit`` rows a feed
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(order))


def sample_pool(claims: DataFrame, least: int = 3, pool: int = 60) -> DataFrame:
    """The best connected nodes: at least ``least`` claims, most first."""
    return endpoints(claims).groupBy("node_id").agg(F.count(F.lit(1)).alias("connections")).where(F.col("connections") >= least).orderBy(F.desc("connections"), "node_id").limit(pool)


def sample_nodes(claims: DataFrame, n: int, seed: int) -> DataFrame:
    """A random choice from the pool; the sampling is the feature."""
    return sample_pool(claims).orderBy(F.rand(seed)).limit(n)


def entry_nodes(claims: DataFrame, since: Column, limit: int) -> DataFrame:
    return claims.where(F.col("created_at") >= since).groupBy(F.col("subject_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").limit(limit)


def evidence_counts(nodes: DataFrame, claims: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """How many claims, source links and aliases speak for each node. Each is counted before it joins."""
    counted = lambda df, name: df.groupBy("node_id").agg(F.count(F.lit(1)).alias(name))
    out = nodes.select("node_id")
    for df, name in ((endpoints(claims, speakers=True), "n_claims"), (links, "n_links"), (aliases, "n_aliases")):
        out = out.join(counted(df, name), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def resolve_ids(ids: DataFrame, redirects: DataFrame) -> DataFrame:
    """Where merged nodes went; an id without a redirect is itself."""
    return ids.join(redirects.select(F.col("from_id").alias("node_id"), "to_id"), "node_id", "left").select("node_id", F.coalesce("to_id", "node_id").alias("resolved_id"))


def flatten_redirects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Redirects with the new ones put in; old targets that moved are followed, so that one hop always suffices."""
    moved = old.join(new.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_next")), "to_id", "left").select("from_id", F.coalesce("_next", "to_id").alias("to_id"))
    return new.select("from_id", "to_id").unionByName(moved.join(new.select("from_id"), "from_id", "left_anti"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """Of claims that say the same, nulls being equal, the one that was created first stays."""
    same = W.partitionBy("user_id", "subject_id", "object_id", "object_value", "predicate", "status", "scope").orderBy("created_at", "claim_id")
    return claims.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def merge_nodes(claims: DataFrame, merges: DataFrame) -> DataFrame:
    """Claims after merges (from_id, to_id): all three references move, claims that now point at their own subject go, equal ones become one."""
    for c in ("subject_id", "object_id", "asserted_by_id"):
        m = merges.select(F.col("from_id").alias(c), F.col("to_id").alias("_to"))
        claims = claims.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    loops = F.coalesce(F.col("subject_id") == F.col("object_id"), F.lit(False))
    return dedupe_claims(claims.where(~loops))


def merge_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    m = merges.select(F.col("from_id").alias("node_id"), "to_id")
    return links.join(m, "node_id", "left").select("source_id", F.coalesce("to_id", "node_id").alias("node_id")).distinct()


def delete_nodes(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims after nodes go: those that touch one go too, and a lost speaker becomes null."""
    gone = ids.select("node_id").distinct()
    for c in ("subject_id", "object_id"):
        claims = claims.join(gone.withColumnRenamed("node_id", c), c, "left_anti")
    speakers = gone.select(F.col("node_id").alias("asserted_by_id"), F.lit(True).alias("_gone"))
    return claims.join(speakers, "asserted_by_id", "left").withColumn("asserted_by_id", F.when(F.col("_gone").isNull(), F.col("asserted_by_id"))).drop("_gone")


def resolve_citations(cited: DataFrame, nodes: DataFrame, claims: DataFrame, sources: DataFrame, redirects: DataFrame) -> DataFrame:
    """For (place, ref) what each reference shows: nodes through redirects, claims only while active, sources unless deleted; in order of place."""
    n = cited.join(redirects.select(F.col("from_id").alias("ref"), "to_id"), "ref", "left").withColumn("target", F.coalesce("to_id", "ref"))
    as_node = n.join(nodes.select(F.col("node_id").alias("target"), "label"), "target").select("place", "ref", F.lit("node").alias("kind"), F.col("label").alias("title"))
    as_claim = cited.join(claims.where("status = 'active'").select(F.col("claim_id").alias("ref"), "statement"), "ref").select("place", "ref", F.lit("claim").alias("kind"), F.col("statement").alias("title"))
    as_source = cited.join(sources.where("deleted_at IS NULL").select(F.col("source_id").alias("ref"), "external_id"), "ref").select("place", "ref", F.lit("source").alias("kind"), F.col("external_id").alias("title"))
    return as_node.unionByName(as_claim).unionByName(as_source).orderBy("place")


def sources_page(sources: DataFrame, links: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """Sources with node counts, newest first by last ingestion or creation; ``before`` is (time, id) of the last row seen."""
    key = F.coalesce("last_ingested_at", "created_at")
    rows = sources.where("deleted_at IS NULL").withColumn("sort_at", key)
    if before:
        at, i = F.lit(before[0]).cast(rows.schema["sort_at"].dataType), before[1]
        rows = rows.where((F.col("sort_at") < at) | ((F.col("sort_at") == at) & (F.col("source_id") < i)))
    page = rows.orderBy(F.desc("sort_at"), F.desc("source_id")).limit(limit + 1)
    return page.join(links, "source_id", "left").groupBy(*page.columns).agg(F.count("node_id").alias("node_count"))


def nodes_of_source(links: DataFrame, nodes: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """Distinct nodes of some sources, newest first."""
    return nodes.join(links.join(sources.select("source_id"), "source_id", "left_semi").select("node_id").distinct(), "node_id", "left_semi").orderBy(F.desc("created_at"), F.desc("node_id")).limit(limit + 1)
