"""Vector and lexical search, rank fusion and result cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..storage import new_folder, saved
from .filters import effective_scope, endpoints, in_scope, scope_support, stated_between, valid_at, with_status, without_inferred
from .graph import one_hop, sources_of_nodes
from .textindex import TextIndex

#: Fusion constant, least similarity of memory search.
FUSION_K, SEARCH_LEAST = 60, 0.40


def vector_topk(vectors: DataFrame, query: list[float], k: int, least: float | None = None, id_col: str = "node_id") -> DataFrame:
    """The k most similar rows of one query, similarity rounded to six places, ties by id. A top-k per task, then one merge; no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.withColumn("similarity", F.round(cosine(F.col("embedding"), q), 6)).where(F.col("similarity").isNotNull())
    rows = rows if least is None else rows.where(F.col("similarity") >= least)
    return rows.orderBy(F.desc("similarity"), id_col).limit(k)


def lexical(rows: DataFrame, text_col: str, query: str, limit: int, id_col: str, fuzzy: bool = True) -> DataFrame:
    """Rows that match the query by words or by their letters: id, score (cover-density rank), similarity, headline. Builds the index; keep a TextIndex where several queries are asked."""
    among = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = TextIndex.build(among, "id", F.col("text"), fuzzy, members=False).search(query, limit, among)
    return found.select(F.col("id").alias(id_col), F.col("rank").alias("score"), "similarity", "headline")


def fuse(rankings: list[DataFrame], id_col: str, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, rank from 0): the sum of 1 / (k + rank), best first, ties by id. An id counts once a ranking."""
    parts = [r.groupBy(id_col).agg(F.min("rank").alias("rank")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), id_col)


def ranked(rows: DataFrame, score: str, id_col: str, *more: str) -> DataFrame:
    """Rank from 0 of a short list, as searches return it."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), *[F.desc(c) for c in more], id_col)) - 1)


def hybrid(vectors: DataFrame, texts: DataFrame, text_col: str, query_vector: list[float], query: str, limit: int, id_col: str = "node_id") -> DataFrame:
    """Vector and lexical legs of max(2 * limit, 20) each, fused."""
    leg = max(2 * limit, 20)
    v = ranked(vector_topk(vectors, query_vector, leg, id_col=id_col), "similarity", id_col).select(id_col, "rank")
    t = ranked(lexical(texts, text_col, query, leg, id_col), "score", id_col, "similarity").select(id_col, "rank")
    return fuse([v, t], id_col).limit(limit)


def ordered_union(parts: list[DataFrame], id_col: str, limit: int) -> DataFrame:
    """Distinct ids of lists (id, pos) in order of list and place."""
    every = None
    for n, p in enumerate(parts):
        p = p.select(id_col, F.struct(F.lit(n).alias("part"), F.col("pos").cast("long").alias("pos")).alias("at"))
        every = p if every is None else every.unionByName(p)
    return every.groupBy(id_col).agg(F.min("at").alias("at")).orderBy("at", id_col).limit(limit).select(id_col)


def node_cards(nodes: DataFrame, claims: DataFrame, links: DataFrame, aliases: DataFrame, recent: int = 8) -> DataFrame:
    """Per node its label, trusted current facts, most recent statements, aliases and sources, each list gathered on its own before it joins."""
    active = claims.where("status = 'active'")
    touch = endpoints(active).where(F.col("asserted_by_kind") != "assistant_inferred")
    newest = W.partitionBy("node_id").orderBy(F.desc("stated_at"), "claim_id")
    evidence = touch.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= recent).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "statement"))), lambda x: x["statement"]).alias("recent"))
    facts = active.where(F.col("object_value").isNotNull() & (F.col("asserted_by_kind") != "assistant_inferred")).groupBy(F.col("subject_id").alias("node_id"), "predicate").agg(F.max_by("object_value", F.struct("stated_at", "claim_id")).alias("value"))
    facts = facts.groupBy("node_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "predicate", "value"))).alias("facts"))
    names = aliases.groupBy("node_id").agg(F.array_sort(F.collect_set("alias_text")).alias("aliases"))
    where = links.groupBy("node_id").agg(F.min("source_id").alias("source_id"))
    out = nodes.select("node_id", "node_type", "label")
    for part in (facts, evidence, names, where):
        out = out.join(part, "node_id", "left")
    return out


def first_source(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The source of each node that was ingested last; those never ingested come last, then the newest."""
    order = W.partitionBy("node_id").orderBy(F.col("last_ingested_at").desc_nulls_last(), F.desc("created_at"), "source_id")
    return links.join(sources, "source_id").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("node_id", "source_id")


def embedding_text(kind: str, *parts: Column) -> Column:
    """Text that stands for a node, claim, metric or period when it is embedded."""
    if kind == "claim":
        predicate, statement, status, stated = parts
        return F.concat_ws(" ", predicate, statement, F.concat(F.lit("status="), status), F.concat(F.lit("statedAt="), stated))
    return F.concat_ws("\n" if kind == "metric" else ": ", *parts)


def searchable_nodes(nodes: DataFrame, claims: DataFrame, links: DataFrame, sources: DataFrame, user_id: str | None = None, scope: str | None = "personal", types: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """The labelled nodes that a search may return: of the user, with support in the scope by a source or an active claim (None: any), of some types or without some."""
    mine = (lambda df: df.where(F.col("user_id") == user_id)) if user_id else (lambda df: df)
    found = mine(nodes).where(F.col("label").isNotNull())
    found = found.where(F.col("node_type").isin(*types)) if types else found
    found = found.where(~F.col("node_type").isin(*without)) if without else found
    return scope_support(found, mine(claims), links, mine(sources), scope) if scope else found


def searchable_claims(claims: DataFrame, user_id: str | None = None, scope: str | None = "personal", at: Column | None = None, stated: tuple[Column | None, Column | None] = (None, None), inferred: bool = False, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """The claims that a search may return: of the user, scope and states, still valid, said within a time, those that the assistant inferred only on request."""
    found = with_status(claims.where(F.col("user_id") == user_id) if user_id else claims, statuses)
    found = in_scope(found, scope, scope is None)
    found = found if inferred else without_inferred(found)
    return stated_between(valid_at(found, at if at is not None else F.current_timestamp()), *stated)


def _of_user(claims: DataFrame, user_id: str | None, work: str) -> DataFrame:
    """The user's claims, written once: what makes them (joins, unions) is not repeated inside the tasks of each step that reads them."""
    return saved(claims.where(F.col("user_id") == user_id) if user_id else claims, f"{work}/of_user")


def _near(rows: DataFrame, vectors: DataFrame, id_col: str, query_vector: list[float], k: int, least: float | None = None) -> DataFrame:
    held = rows.select(id_col).join(vectors.select(id_col), id_col, "left_semi")  # mostly few: the rest needs no shuffle
    return vector_topk(vectors.select(id_col, "embedding").join(held, id_col, "left_semi"), query_vector, k, least, id_col)


def _searched(nodes: DataFrame, vectors: DataFrame, claims: DataFrame, links: DataFrame, sources: DataFrame, user_id: str | None, *scope: str | None, without: tuple[str, ...] = ()) -> DataFrame:
    """searchable_nodes of the nodes that have a vector; claims and links that touch none of them are left out before they are joined."""
    ids = vectors.select("node_id")
    touch = endpoints(claims.select("user_id", "subject_id", "object_id", "scope", "status")).join(ids, "node_id", "left_semi")
    about = touch.select("user_id", "scope", "status", F.col("node_id").alias("subject_id"), F.lit(None).cast("string").alias("object_id"))
    return searchable_nodes(nodes.join(ids, "node_id", "left_semi"), about, links.join(ids, "node_id", "left_semi"), sources, user_id, *scope, without=without)


def explicit_search(nodes: DataFrame, node_vectors: DataFrame, claims: DataFrame, claim_vectors: DataFrame, links: DataFrame, sources: DataFrame, query_vector: list[float], query: str, limit: int, types: tuple[str, ...] = (),
                    stated: tuple[Column | None, Column | None] = (None, None), scope: str = "personal", user_id: str | None = None, at: Column | None = None) -> DataFrame:
    """Hits of four legs, nodes and claims each by vector and by words, of max(2 * limit, 20) rows a leg: kind, node_id, node_type, claim_id, text, highlight, score, source_id, source_type, title, author, stated_at.

    Each kind fuses its two legs by reciprocal ranks; hits of both go in order of score, node and claim. The words are looked up in a text index of the rows that may be
    found. ``types`` keeps nodes of some types, ``stated`` claims of a time. Claims bring their source, nodes have many and bring none.
    """
    work, leg = new_folder(nodes.sparkSession, "search"), max(2 * limit, 20)
    shown = searchable_nodes(nodes, claims, links, sources, user_id, scope, types)
    said = searchable_claims(claims, user_id, scope, at, stated)

    def fused(rows: DataFrame, vectors: DataFrame, id_col: str, text_col: str) -> DataFrame:
        rows = saved(rows, f"{work}/{id_col}")  # read by both legs and by the hits
        words = saved(lexical(rows, text_col, query, leg, id_col), f"{work}/{id_col}_words")
        near = _near(rows, vectors, id_col, query_vector, leg)
        found = fuse([ranked(near, "similarity", id_col).select(id_col, "rank"), ranked(words, "score", id_col, "similarity").select(id_col, "rank")], id_col)
        return found.join(rows, id_col).join(words.select(id_col, "headline"), id_col, "left").withColumn("highlight", F.coalesce("headline", text_col))

    none = F.lit(None).cast("string")
    n = fused(shown, node_vectors, "node_id", "label")
    n = n.select(F.lit("node").alias("kind"), "node_id", "node_type", none.alias("claim_id"), F.col("label").alias("text"), "highlight", "score", *[none.alias(c) for c in ("source_id", "source_type", "title", "author")], F.lit(None).cast("timestamp_ntz").alias("stated_at"))
    facts = sources.select("source_id", F.col("type").alias("source_type"), *[F.get_json_object("metadata", f"$.{c}").alias(c) for c in ("title", "author")])
    c = fused(said, claim_vectors, "claim_id", "statement").join(facts, "source_id", "left")
    c = c.select(F.lit("claim").alias("kind"), F.col("subject_id").alias("node_id"), none.alias("node_type"), "claim_id", F.col("statement").alias("text"), "highlight", "score", "source_id", "source_type", "title", "author", F.col("stated_at").cast("timestamp_ntz").alias("stated_at"))
    return n.unionByName(c).orderBy(F.desc("score"), "node_id", F.col("claim_id").asc_nulls_first()).limit(limit)


def memory_search(nodes: DataFrame, node_vectors: DataFrame, claims: DataFrame, claim_vectors: DataFrame, links: DataFrame, sources: DataFrame, query_vector: list[float], limit: int, least: float = SEARCH_LEAST, user_id: str | None = None,
                  without: tuple[str, ...] = (), at: Column | None = None) -> DataFrame:
    """Personal nodes and trusted personal claims of at least ``least`` similarity, ``limit`` of each, and the first 50 nodes one step from any of them: kind, id, similarity (null for neighbours), source_ids."""
    work = new_folder(nodes.sparkSession, "search")
    claims = _of_user(claims, user_id, work)
    shown, said = _searched(nodes, node_vectors, claims, links, sources, user_id, without=without), searchable_claims(claims, user_id, at=at)
    n = _near(shown, node_vectors, "node_id", query_vector, limit, least).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "similarity")
    c = _near(said, claim_vectors, "claim_id", query_vector, limit, least).select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), "similarity")
    hits = saved(n.unionByName(c), f"{work}/hits")
    found = hits.where("kind = 'claim'").select(F.col("id").alias("claim_id"))
    ends = endpoints(claims.join(found, "claim_id", "left_semi")).select("node_id").union(hits.where("kind = 'node'").select("id")).distinct()
    near = one_hop(claims, nodes, saved(ends, f"{work}/ends"), user_id=user_id).select(F.lit("neighbour").alias("kind"), F.col("node_id").alias("id"), F.lit(None).cast("double").alias("similarity"))
    out = hits.unionByName(saved(near, f"{work}/near"))
    return out.join(sources_of_nodes(links.join(out.select(F.col("id").alias("node_id")), "node_id", "left_semi")).withColumnRenamed("node_id", "id"), "id", "left").select("kind", "id", "similarity", "source_ids")


def card_search(nodes: DataFrame, node_vectors: DataFrame, claims: DataFrame, claim_vectors: DataFrame, links: DataFrame, sources: DataFrame, aliases: DataFrame, query_vector: list[float], limit: int = 10, scope: str = "personal", least: float = SEARCH_LEAST,
                user_id: str | None = None, without: tuple[str, ...] = (), at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards, evidence) of a search for nodes of one scope.

    Candidates are the ``limit`` most similar nodes, then subject and object of each of the ``limit`` most similar trusted claims, each once, where it stands first. A candidate is kept
    if the scope that all its claims and sources give it is the one asked for; later candidates move up until ``limit`` cards stand or none is left. A search for reference
    looks among all scopes, one for personal among personal ones only. cards: pos from 0, scope and the columns of node_cards. evidence: pos, claim_id and
    source_id of the claims found whose subject has a card. Candidates without a node of the user have no card. Claims that touch no candidate are left out before anything is gathered.
    """
    work, among = new_folder(nodes.sparkSession, "cards"), None if scope == "reference" else scope
    mine = (lambda df: df.where(F.col("user_id") == user_id)) if user_id else (lambda df: df)
    claims = _of_user(claims, user_id, work)
    shown, said = _searched(nodes, node_vectors, claims, links, sources, user_id, among, without=without), searchable_claims(claims, user_id, among, at)
    found = saved(ranked(_near(shown, node_vectors, "node_id", query_vector, limit, least), "similarity", "node_id").select("node_id", "rank"), f"{work}/nodes")
    hits = ranked(_near(said, claim_vectors, "claim_id", query_vector, limit, least), "similarity", "claim_id").select("claim_id", "rank")
    hits = saved(said.join(hits, "claim_id").select("claim_id", "rank", "source_id", "subject_id", "object_id"), f"{work}/claims")
    ends = hits.select("rank", F.posexplode(F.array("subject_id", "object_id")).alias("end", "node_id")).where("node_id IS NOT NULL")
    first = F.min(F.struct("part", "rank", "end")).alias("first")
    candidates = found.select("node_id", F.lit(0).alias("part"), "rank", F.lit(0).alias("end")).unionByName(ends.select("node_id", F.lit(1).alias("part"), "rank", "end")).groupBy("node_id").agg(first)
    candidates = saved(mine(nodes).join(candidates, "node_id"), f"{work}/candidates")  # at most three times ``limit``

    ids = candidates.select("node_id")
    touch = endpoints(mine(claims)).join(ids, "node_id", "left_semi")
    signals = touch.select(F.col("node_id").alias("subject_id"), F.lit(None).cast("string").alias("object_id"), "scope")
    near_links = links.join(ids, "node_id", "left_semi")
    kept = effective_scope(candidates, signals, near_links, mine(sources)).where(F.col("effective_scope") == scope).orderBy("first").limit(limit)
    kept = saved(kept.withColumn("pos", F.row_number().over(W.orderBy("first")) - 1), f"{work}/kept")

    own = mine(claims).join(touch.select("claim_id"), "claim_id", "left_semi")
    cards = node_cards(kept, own, near_links, aliases.join(ids, "node_id", "left_semi"))
    cards = cards.join(kept.select("node_id", "pos", F.col("effective_scope").alias("scope")), "node_id")
    evidence = hits.join(kept.select(F.col("node_id").alias("subject_id")), "subject_id", "left_semi").select(F.col("rank").alias("pos"), "claim_id", "source_id")
    return cards, evidence
