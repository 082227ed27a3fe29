"""The log of cleanup operations: applied in order within each connected group, with guards, counts and the lifecycle of what they touch."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_alias, normalize_label
from ..storage import new_folder, saved
from ..vocab import SINGLE_CURRENT, SINGLE_CURRENT_OF_TASK, TRUST, TRUSTED_USERS
from .filters import endpoints
from .hygiene import SHAPES
from .lifecycle import recompute

#: Fixed values of the data model: who may be cited against a claim, types that may be merged without being asked, attribute predicates.
CITED = ("user", "user_confirmed", "participant", "document_author")
MERGED = ("Person", "Organization", "Location", "Object", "Emotion", "Concept", "Media", "Temporal")
ATTRIBUTES = ("HAS_STATUS", "HAS_TASK_STATUS", "HAS_PREFERENCE", "HAS_GOAL", "MADE_DECISION", "HAS_ATTRIBUTE")
STATES = ("pending", "in_progress", "done", "abandoned")
#: Operations that name claims only; groups of no others see no nodes but those whose types decide.
OF_CLAIMS = ("retract_claim", "contradict_claim")
#: Predicates whose shape leaves out some types.
SHAPED = tuple(p for p, ends in SHAPES.items() if any("*" not in ok for ok in ends))

#: The columns of an operation. temp ids name nodes of the run; removed is the list of a merge.
OPERATION = "user_id string, run string, seq int, kind string, claim_id string, cited_id string, temp_id string, object_temp_id string, removed array<string>, text string, node_type string, predicate string, object_value string"
_DONE = "user_id string, run string, seq int, kind string, outcome string, message string, effect string, claim_id string, node_id string, other_id string, predicate string, object_value string, text string, node_type string, scope string, source_id string, by_kind string, created int"


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for edges (a, b): root is the smallest node reachable. Each round takes the smallest root among the neighbours, then jumps to the root's root, so that a chain halves."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{folder}/edges")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{folder}/roots0")
    n = 0
    while True:
        n += 1
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        step = roots.join(near, "node").select("node", F.least("root", "_near").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left")
        after = saved(jump.select("node", F.coalesce("_next", "root").alias("root")), f"{folder}/roots{n}")
        if after.join(roots, ["node", "root"], "left_anti").isEmpty():
            return after
        roots = after


def resolve_chain(chain: list[dict]) -> None:
    """Sets the state of the claims of one subject and predicate, as lifecycle.supersede does."""
    rows = sorted((c for c in chain if c["status"] in ("active", "superseded")), key=lambda c: (c["at"], c["made"], TRUST.get(c["kind"], 0), c["id"]))
    if rows and rows[-1]["kind"] == "assistant_inferred" and any(c["kind"] in TRUSTED_USERS for c in rows[:-1]):
        rows.pop()["status"] = "superseded"
    for c in rows:
        c["status"] = "superseded"
    for c in rows[-1:]:
        c["status"] = "active"


class Refused(Exception):
    """An operation that a guard forbids; it is recorded and changes nothing."""


class Group:
    """What the operations of one group see and change. Only rows that they name, that lie between their nodes, or that share a chain with those are held."""

    def __init__(self, state: list[dict]):
        rows: dict[str, list[dict]] = {}
        for r in state:
            rows.setdefault(r["what"], []).append(r)
        take = lambda kind: rows.get(kind, [])
        self.claims = {r["id"]: r for r in take("claim")}
        self.nodes = {r["id"]: {"type": r["predicate"], "outside": int(r["n"]), "links": int(r["m"]), "scopes": set(filter(None, (r["scope"] or "").split(",")))} for r in take("node")}
        self.aliases = {(r["id"], r["value"]) for r in take("alias")}
        self.sources = {r["id"]: r["scope"] for r in take("source")}
        self.temps = {(r["subject"], r["id"]): r["object"] for r in take("temp")}
        self.allowed = {(r["subject"], r["id"]) for r in take("allowed")}
        self.bounded = {r["subject"] for r in take("allowed")}

    def run(self, op: dict) -> tuple[str, str, list[dict]]:
        named = {"retract_claim": ("claim_id",), "contradict_claim": ("claim_id", "cited_id"), "promote_assertion": ("claim_id",)}.get(op["kind"], ())
        try:
            for c in named:
                if op["run"] in self.bounded and (op["run"], op[c]) not in self.allowed:
                    raise Refused(f"{op['kind']} {'cites' if c == 'cited_id' else 'references'} claim {op[c]} outside the rendered subgraph")
            effects = getattr(self, op["kind"], lambda _: None)(op)
        except Refused as refused:
            return "error", str(refused), []
        return ("skipped", "", []) if effects is None else ("applied", "", effects)

    def node(self, op: dict, temp: str | None) -> str | None:
        return self.temps.get((op["run"], temp))

    def chain(self, c: dict) -> None:
        single = c["predicate"] in SINGLE_CURRENT or (c["predicate"] in SINGLE_CURRENT_OF_TASK and self.nodes.get(c["subject"], {}).get("type") == "Task")
        if single:
            resolve_chain([x for x in self.claims.values() if (x["subject"], x["predicate"]) == (c["subject"], c["predicate"])])

    def misshapen(self, predicate: str, subject: str, target: str | None) -> bool:
        if predicate not in SHAPES:
            return False
        if target is None:
            return True
        ends = [self.nodes[x]["type"] if x in self.nodes else None for x in (subject, target)]
        return None not in ends and not all("*" in ok or end in ok for ok, end in zip(SHAPES[predicate], ends, strict=True))

    def retract_claim(self, op):
        c = self.claims.get(op["claim_id"])
        if c is None:
            return None
        if c["kind"] != "assistant_inferred" and not self.misshapen(c["predicate"], c["subject"], c["object"]):
            raise Refused(f"retract_claim refused for {c['kind']} claim {c['id']}; use contradict_claim with a cited claim instead")
        c["status"] = "retracted"
        self.chain(c)
        return [{"effect": "status", "claim_id": c["id"], "text": "retracted"}]

    def contradict_claim(self, op):
        c, cited = self.claims.get(op["claim_id"]), self.claims.get(op["cited_id"])
        if op["claim_id"] == op["cited_id"]:
            raise Refused("contradict_claim cannot cite the same claim it contradicts")
        if c is None:
            return None
        if cited is None:
            raise Refused(f"contradict_claim citation {op['cited_id']} not found for user")
        if cited["status"] != "active":
            raise Refused(f"contradict_claim citation {cited['id']} is {cited['status']}, expected active")
        if cited["kind"] not in CITED:
            raise Refused(f"contradict_claim citation {cited['id']} is {cited['kind']}, expected source-backed provenance")
        if cited["scope"] != c["scope"]:
            raise Refused(f"contradict_claim scope mismatch: target is {c['scope']}, citation is {cited['scope']}")
        c["status"] = "contradicted"
        self.chain(c)
        return [{"effect": "status", "claim_id": c["id"], "other_id": cited["id"], "text": "contradicted"}]

    def _insert(self, op, subject, target, value, predicate, scope, source, kind):
        if (target is None) == (value is None):
            raise Refused("exactly one of an object node and an object value is required")
        if (predicate in SHAPES and target is None) or (predicate in ATTRIBUTES and value is None):
            raise Refused(f"{predicate} takes {'a node' if predicate in SHAPES else 'a value'} as its object")
        if predicate == "HAS_TASK_STATUS" and value not in STATES:
            raise Refused(f"{value} is no state of a task")
        if any(x not in self.nodes for x in (subject, target) if x is not None):
            raise Refused("a node of the claim is gone")
        if self.misshapen(predicate, subject, target):
            raise Refused(f"{predicate} doesn't hold between these types of nodes")
        name = "clm_" + hashlib.sha256(f"{op['user_id']}\x1f{op['run']}\x1f{op['seq']}".encode()).hexdigest()[:26]
        c = {"id": name, "subject": subject, "object": target, "value": value, "predicate": predicate, "status": "active", "kind": kind, "scope": scope, "source": source, "at": "~", "made": f"~{op['place']:09d}", "speaker": None}
        self.claims[name] = c
        for x in (subject, target):
            if x is not None:
                self.nodes[x]["scopes"].add(scope)
        self.chain(c)
        return {"effect": "claim", "claim_id": name, "node_id": subject, "other_id": target, "predicate": predicate, "object_value": value, "text": op["text"], "scope": scope, "source_id": source, "by_kind": kind, "created": op["place"]}

    def add_claim(self, op):
        if (op["object_temp_id"] is None) == (op["object_value"] is None):
            raise Refused("add_claim: exactly one of objectTempId or objectValue is required")
        subject, target = self.node(op, op["temp_id"]), self.node(op, op["object_temp_id"])
        if subject is None or (op["object_temp_id"] is not None and target is None):
            return None
        scope, source = "personal", None
        if op["cited_id"] is not None:
            cited = self.claims.get(op["cited_id"])
            if cited is None or cited["source"] not in self.sources:
                raise Refused(f"add_claim source claim {op['cited_id']} not found for user")
            scope, source = self.sources[cited["source"]], cited["source"]
        return [self._insert(op, subject, target, op["object_value"], op["predicate"], scope, source, "system")]

    def promote_assertion(self, op):
        c = self.claims.get(op["claim_id"])
        if c is None:
            raise Refused("promote_assertion: claim not found")
        if c["kind"] != "assistant_inferred":
            raise Refused(f"promote_assertion: claim is {c['kind']}, expected assistant_inferred")
        if op["cited_id"] not in self.sources:
            raise Refused(f"promote_assertion: corroborating source {op['cited_id']} not found")
        return [self._insert({**op, "text": None}, c["subject"], c["object"], c["value"], c["predicate"], self.sources[op["cited_id"]], op["cited_id"], "user_confirmed") | {"text": c["id"]}]

    def add_alias(self, op):
        node, text = self.node(op, op["temp_id"]), (op["text"] or "").strip().lower()
        if node is None:
            return None
        if node not in self.nodes:
            raise Refused("the node of the alias is gone")
        if not text or (node, text) in self.aliases:
            return []
        self.aliases.add((node, text))
        return [{"effect": "alias", "node_id": node, "text": op["text"]}]

    def remove_alias(self, op):
        node, text = self.node(op, op["temp_id"]), (op["text"] or "").strip().lower()
        if node is None or (node, text) not in self.aliases:
            return None
        self.aliases.discard((node, text))
        return [{"effect": "no_alias", "node_id": node, "text": op["text"]}]

    def merge_nodes(self, op):
        keep = self.node(op, op["temp_id"])
        gone = list(dict.fromkeys(x for t in op["removed"] if (x := self.node(op, t)) is not None and x != keep))
        if keep is None or not gone or any(self.nodes[x]["type"] not in MERGED for x in (keep, *gone) if x in self.nodes):
            return None
        if any(x not in self.nodes for x in (keep, *gone)):  # one is gone: nothing merges, the temporary ids move all the same
            self.temps |= {(op["run"], t): keep for t in op["removed"]}
            return []
        scopes = {"reference" if self.nodes[x]["scopes"] == {"reference"} else "personal" for x in (keep, *gone)}
        if len(scopes) > 1:
            raise Refused(f"nodes of scopes {', '.join(sorted(scopes))} are not merged")
        into = self.nodes[keep]
        for x in gone:
            lost = self.nodes.pop(x)
            into["outside"], into["links"], into["scopes"] = into["outside"] + lost["outside"], into["links"] + lost["links"], into["scopes"] | lost["scopes"]
            for c in self.claims.values():
                for end in ("subject", "object", "speaker"):
                    c[end] = keep if c[end] == x else c[end]
            self.aliases = {a for a in self.aliases if a[0] != x}
        self.claims = {k: c for k, c in self.claims.items() if not c["subject"] == c["object"] == keep}
        self.temps |= {(op["run"], t): keep for t in op["removed"]}
        return [{"effect": "merge", "node_id": x, "other_id": keep} for x in gone]

    def delete_node(self, op):
        node = self.node(op, op["temp_id"])
        if node is None:
            return None
        known = self.nodes.get(node, {"outside": 0, "links": 0})
        claims = known["outside"] + sum(node in (c["subject"], c["object"], c["speaker"]) for c in self.claims.values())
        aliases = sum(a[0] == node for a in self.aliases)
        if claims or known["links"] or aliases:
            raise Refused(f"delete_node refused for {node}; node still has claims={claims}, sourceLinks={known['links']}, aliases={aliases}")
        if self.nodes.pop(node, None) is None:
            return None
        return [{"effect": "no_node", "node_id": node}]

    def create_node(self, op):
        name = "node_" + hashlib.sha256(f"{op['user_id']}\x1f{op['run']}\x1f{op['seq']}".encode()).hexdigest()[:26]
        self.nodes[name] = {"type": op["node_type"], "outside": 0, "links": 0, "scopes": set()}
        self.temps[op["run"], op["temp_id"]] = name
        return [{"effect": "node", "node_id": name, "text": op["text"], "node_type": op["node_type"]}]


def _records(table: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    columns = table.column_names
    # Pandas makes objects of whole columns many times faster than to_pylist.
    for values in zip(*(c.to_pandas(integer_object_nulls=True).tolist() for c in table.columns), strict=True):
        r = dict(zip(columns, values, strict=True))
        out.setdefault(r["group"], []).append(r)
    return out


def _apply(ops: pa.Table, state: pa.Table) -> pa.Table:
    """Outcomes and effects of the groups of a bucket, each in order of run and place."""
    columns = [c.split() for c in _DONE.split(", ")]
    nothing = (None,) * (len(columns) - 8)
    held, out = _records(state), []
    for name, mine in _records(ops).items():
        group = Group(held.get(name, []))
        for place, op in enumerate(sorted(mine, key=lambda r: (r["run"], r["seq"]))):
            op["place"], op["removed"] = place, list(op["removed"]) if op["removed"] is not None else []
            outcome, message, effects = group.run(op)
            head = (op["user_id"], op["run"], op["seq"], op["kind"])
            out.append((*head, outcome, message or None, None, op["claim_id"], *nothing))
            out += [(*head, *(e.get(c) for c, _ in columns[4:])) for e in effects]
    values = zip(*out) if out else ((),) * len(columns)
    return pa.table({c: pa.array(v, pa.int32() if t == "int" else pa.string()) for (c, t), v in zip(columns, values, strict=True)})


class CleanupResult:
    """outcomes: one row per operation (applied, skipped or error, with the message and the claim it names). effects: what they change, in order. The tables after it: claims, nodes, links, aliases, redirects."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)

    def counts(self) -> DataFrame:
        """applied, skipped and errors of each run, and the nodes that it touched: survivors of merges, new nodes, ends of new claims."""
        sums = self.outcomes.groupBy("user_id", "run").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("applied", "applied"), ("skipped", "skipped"), ("error", "errors"))])
        ends = F.when(F.col("effect") == "merge", F.array("other_id")).when((F.col("effect") == "claim") & (F.col("by_kind") == "system"), F.array("node_id", "other_id")).when(F.col("effect") == "node", F.array("node_id"))
        touched = self.effects.select("user_id", "run", F.explode(F.array_compact(ends)).alias("_n")).groupBy("user_id", "run").agg(F.array_sort(F.collect_set("_n")).alias("affected"))
        return sums.join(touched, ["user_id", "run"], "left").withColumn("affected", F.coalesce("affected", F.array().cast("array<string>")))


def apply_cleanup(operations: DataFrame, temps: DataFrame, claims: DataFrame, nodes: DataFrame, links: DataFrame, sources: DataFrame, aliases: DataFrame, at: Column, allowed: DataFrame | None = None) -> CleanupResult:
    """Applies a log of cleanup operations (see OPERATION): user_id, run, seq give the order; a run's temporary ids (user_id, run, temp_id, node_id) name its nodes.

    Kinds: merge_nodes (temp_id survives, removed go), delete_node, retract_claim, contradict_claim (cited_id), add_claim (temp_id, predicate, object_temp_id or object_value, text; cited_id is the claim
    whose source lends its scope), add_alias, remove_alias (temp_id, text), promote_assertion (cited_id is a source), create_node (temp_id, text, node_type). A refused operation is an error in the
    outcomes and changes nothing. allowed (user_id, run, claim_id): the claims that operations of a run may name; a run that has none there is free.

    Runs of one user form a group (components) where one may change what another reads: a claim, the chain of a single-valued predicate, a node that is merged or deleted, an alias. Groups are independent, and
    Spark deals them out. A group sees a few rows: the nodes that it names, how many claims lie outside, and the claims that it names, that lie between its nodes or in their chains. A group that only retracts and contradicts
    sees less: the claims that it names, their chains, and the types of nodes that a shape or a chain asks for. It is worked off in order, so that later temporary ids point to survivors. What comes of it is applied to the whole tables by joins: merges of merges are followed to the last survivor, and the lifecycle runs on touched keys only.
    """
    folder = new_folder(operations.sparkSession, "cleanup")
    ops, temps = saved(operations, f"{folder}/ops"), saved(temps, f"{folder}/temps")
    own = claims.select("claim_id", "user_id", "subject_id", "object_id", "object_value", "predicate", "status", "asserted_by_kind", "scope", "source_id", "stated_at", "created_at", "asserted_by_id")
    key = ["user_id", "run"]
    # Who names a claim is dealt by claim, which its rows, the first and last run that name it and the join all go by.
    refs = ops.select(*key, F.explode(F.array_compact(F.array("claim_id", "cited_id"))).alias("claim_id")).repartition("user_id", "claim_id").distinct()
    runs_of = W.partitionBy("user_id", "claim_id")
    refs = refs.withColumn("_low", F.min("run").over(runs_of)).withColumn("_high", F.max("run").over(runs_of))
    named = saved(refs.join(own, ["user_id", "claim_id"]), f"{folder}/named")
    used = ops.select(*key, "kind", "predicate", "text", "temp_id", F.explode(F.array_compact(F.concat(F.array("temp_id", "object_temp_id"), F.coalesce("removed", F.array().cast("array<string>"))))).alias("_temp"))
    used = saved(used.join(temps.withColumnRenamed("temp_id", "_temp"), [*key, "_temp"]), f"{folder}/used")
    ends = named.select(*key, F.explode(F.array_compact(F.array("subject_id", "object_id"))).alias("ref")).union(used.select(*key, F.col("node_id").alias("ref")))

    # Runs belong together where one changes what the other reads: a claim, a chain of claims, a node that is merged or deleted, an alias. What only one run reads links nothing.
    written = saved(used.where("kind IN ('merge_nodes', 'delete_node')").select("user_id", F.col("node_id").alias("ref")).distinct(), f"{folder}/written")
    singles = F.col("predicate").isin(*SINGLE_CURRENT, *SINGLE_CURRENT_OF_TASK)
    chains = named.where(singles).select(*key, F.concat_ws("\x1f", "subject_id", "predicate").alias("ref")).union(used.where((F.col("kind") == "add_claim") & singles & (F.col("temp_id") == F.col("_temp"))).select(*key, F.concat_ws("\x1f", "node_id", "predicate").alias("ref")))
    names = used.where("kind IN ('add_alias', 'remove_alias')").select(*key, F.concat_ws("\x1f", "node_id", normalize_alias(F.col("text"))).alias("ref"))
    readers = saved(ends.join(written, ["user_id", "ref"], "left_semi").union(chains).union(names).distinct(), f"{folder}/readers")
    shared = readers.groupBy("user_id", "ref").agg(F.min("run").alias("_low"), F.max("run").alias("_high")).where("_low <> _high")
    links_by = named.where("_low <> _high").select(*key, "_low").union(readers.join(shared, ["user_id", "ref"]).select(*key, "_low"))
    run = lambda c: F.concat_ws("\x1f", F.lit("run"), "user_id", c)
    groups = components(links_by.select(run("run").alias("a"), run("_low").alias("b")), f"{folder}/components")
    parts = F.split("node", "\x1f")
    roots = saved(groups.select(F.get(parts, F.lit(1)).alias("user_id"), F.get(parts, F.lit(2)).alias("run"), F.col("root").alias("_root")), f"{folder}/runs")
    grouped = lambda df: df.join(roots, key, "left").withColumn("group", F.coalesce("_root", run("run")))
    dealt = grouped(ops.where("user_id IS NOT NULL AND run IS NOT NULL")).drop("_root")
    # Groups with an operation on nodes or sources see all about their nodes.
    wide = saved(dealt.where(~F.coalesce(F.col("kind").isin(*OF_CLAIMS), F.lit(False))).select("user_id", "group").distinct(), f"{folder}/wide")
    state = _state_of_claims(grouped(named).join(wide, ["user_id", "group"], "left_anti"), own, nodes, folder)
    if not wide.isEmpty():
        refs = grouped(named.select(*key, F.col("claim_id").alias("ref")).union(ends)).join(wide, ["user_id", "group"], "left_semi")
        held = saved(refs.select("user_id", "group", "ref").distinct(), f"{folder}/held")
        state = state.unionByName(_state(held, grouped, own, nodes, links, sources, aliases, temps, ops, folder))
    if allowed is not None:
        state = state.unionByName(_shaped(grouped(allowed), "allowed", id="claim_id", subject="run"))
    buckets = max(1, -(-ops.count() // 2000))
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket")
    done = dealt.groupBy(bucket).cogroup(state.groupBy(bucket)).applyInArrow(_apply, _DONE)
    done = saved(done, f"{folder}/done")
    outcomes = done.where("outcome IS NOT NULL").select("user_id", "run", "seq", "kind", "claim_id", "outcome", "message")
    effects = done.where("effect IS NOT NULL").drop("outcome", "message")
    return CleanupResult(outcomes=outcomes, effects=effects, **_after(effects, claims, nodes, links, aliases, at, folder))


def _shaped(df: DataFrame, what: str, **columns) -> DataFrame:
    """Rows that groups see, of one shape: group, what, id, and what each kind needs."""
    null, none = F.lit(None).cast("string"), F.lit(0).cast("long")
    empty = {c: null for c in ("subject", "object", "value", "predicate", "status", "kind", "scope", "source", "at", "made", "speaker")} | {"n": none, "m": none}
    return df.select("group", F.lit(what).alias("what"), *[(F.col(v) if isinstance(v, str) else v).alias(c) for c, v in ({"id": columns.pop("id")} | empty | columns).items()])


def _shaped_claims(claims: DataFrame) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return _shaped(claims, "claim", id="claim_id", subject="subject_id", object="object_id", value="object_value", predicate="predicate", status="status", kind="asserted_by_kind", scope="scope", source="source_id", at=text("stated_at"), made=text("created_at"), speaker="asserted_by_id")


def _state_of_claims(named: DataFrame, own: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """What groups see that only retract and contradict: the claims they name, the chains of these, and the types of nodes that a shape or a chain asks for."""
    chain = ["user_id", "subject_id", "predicate"]
    singles = F.col("predicate").isin(*SINGLE_CURRENT, *SINGLE_CURRENT_OF_TASK)
    out = _shaped_claims(named)
    chains = saved(named.where(singles).select("group", *chain).distinct(), f"{folder}/chains")
    if not chains.isEmpty():
        out = out.unionByName(_shaped_claims(own.where(singles).join(chains, chain)))
    ends = F.when(F.col("predicate").isin(*SHAPED), F.array("subject_id", "object_id")).when(F.col("predicate").isin(*SINGLE_CURRENT_OF_TASK), F.array("subject_id"))
    typed = saved(named.select("user_id", "group", F.explode(F.array_compact(ends)).alias("node_id")).distinct(), f"{folder}/typed")
    if not typed.isEmpty():
        out = out.unionByName(_shaped(nodes.select("user_id", "node_id", "node_type").join(typed, ["user_id", "node_id"]), "node", id="node_id", predicate="node_type"))
    return out


def _state(held, grouped, own, nodes, links, sources, aliases, temps, ops, folder) -> DataFrame:
    """The rows that groups see which change nodes."""
    null = F.lit(None).cast("string")

    # Claims that a group sees: named, in a chain, or between two of its nodes. One of an end and, for the last, the other end decides; the other claims are only counted, per node.
    singles = F.coalesce(F.col("predicate").isin(*SINGLE_CURRENT, *SINGLE_CURRENT_OF_TASK), F.lit(False))
    at = lambda ok, ref, other: F.when(ok & F.col(ref).isNotNull(), F.struct(F.col(ref).alias("ref"), (F.col(other) if other else null).alias("other")))
    pairs = [at(F.col(a) != F.col(b), a, b) for a, b in (("subject_id", "object_id"), ("subject_id", "asserted_by_id"), ("object_id", "asserted_by_id"))]
    spread = own.select("claim_id", "user_id", F.explode(F.array_compact(F.array(at(F.lit(True), "claim_id", None), at(singles, "subject_id", None), *pairs))).alias("_at")).select("claim_id", "user_id", "_at.*")
    met = saved(spread.join(held, ["user_id", "ref"]).select("user_id", "group", "claim_id", "other"), f"{folder}/met")
    both = met.where("other IS NOT NULL").join(held.withColumnRenamed("ref", "other"), ["user_id", "group", "other"], "left_semi").select("user_id", "group", "claim_id")
    seen = met.where("other IS NULL").select("user_id", "group", "claim_id").union(both).distinct()
    seen = saved(seen.join(own, ["claim_id", "user_id"]), f"{folder}/seen")
    # What speaks for a node, counted once whatever groups hold it: its claims and their scopes (a speaker lends none), its links. Of the claims a group sees some, the others lie outside.
    end = lambda c, said: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("ref"), said.alias("said")))
    speaks = F.when(F.coalesce(F.col("asserted_by_id") != F.col("subject_id"), F.lit(True)) & F.coalesce(F.col("asserted_by_id") != F.col("object_id"), F.lit(True)), end("asserted_by_id", null))
    touch = own.select("user_id", F.explode(F.array_compact(F.array_distinct(F.array(end("subject_id", F.col("scope")), end("object_id", F.col("scope")), speaks)))).alias("_at")).select("user_id", "_at.*")
    said = touch.groupBy("user_id", "ref").agg(F.count(F.lit(1)).alias("_all"), F.collect_set("said").alias("_of_claims"))
    inside = endpoints(seen, speakers=True).groupBy("group", F.col("node_id").alias("ref")).agg(F.count(F.lit(1)).alias("_inside"))
    linked = links.join(sources.select("source_id", F.col("scope").alias("_scope")), "source_id", "left").groupBy(F.col("node_id").alias("ref")).agg(F.count(F.lit(1)).alias("m"), F.collect_set("_scope").alias("_of_links"))
    here = nodes.select(F.col("node_id").alias("ref"), "user_id", "node_type").join(held, ["user_id", "ref"])
    rows = here.join(said, ["user_id", "ref"], "left").join(linked, "ref", "left").join(inside, ["group", "ref"], "left")
    rows = rows.withColumn("n", F.coalesce("_all", F.lit(0)) - F.coalesce("_inside", F.lit(0)))
    none = F.array().cast("array<string>")
    scopes = F.array_join(F.array_union(F.coalesce("_of_links", none), F.coalesce("_of_claims", none)), ",")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = _shaped_claims(seen).unionByName(_shaped(rows, "node", id="ref", predicate="node_type", scope=scopes, n=zero("n"), m=zero("m")))
    out = out.unionByName(_shaped(aliases.select(F.col("node_id").alias("ref"), "user_id", "normalized_alias_text").join(held, ["user_id", "ref"]), "alias", id="ref", value="normalized_alias_text"))
    cited = grouped(ops.where("kind = 'promote_assertion'")).select("user_id", "group", F.col("cited_id").alias("source_id"))
    lent = seen.select("user_id", "group", "source_id")
    out = out.unionByName(_shaped(cited.union(lent).distinct().join(sources.select("source_id", "user_id", "scope"), ["source_id", "user_id"]), "source", id="source_id", scope="scope"))
    out = out.unionByName(_shaped(grouped(temps), "temp", id="temp_id", subject="run", object="node_id"))
    return out


def _moved(effects: DataFrame, folder: str) -> DataFrame:
    """(from_id, to_id) of all merges, each to its last survivor."""
    moves = saved(effects.where("effect = 'merge'").select(F.col("node_id").alias("from_id"), F.col("other_id").alias("to_id")), f"{folder}/moves0")
    n = 0
    while True:
        n += 1
        far = moves.join(moves.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_next")), "to_id", "left")
        if far.where("_next IS NOT NULL").isEmpty():
            return moves
        moves = saved(far.select("from_id", F.coalesce("_next", "to_id").alias("to_id")), f"{folder}/moves{n}")


def _put(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """Follows moves in a column. Rows without a value don't travel to the join."""
    m = moves.select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    some = rows.where(F.col(column).isNotNull()).join(m, column, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)
    return some.unionByName(rows.where(F.col(column).isNull()))


def _merged(claims: DataFrame, moves: DataFrame, folder: str) -> DataFrame:
    """The claims after all merges: ends moved to survivors, claims from a survivor to itself and repeated ones dropped."""
    every = saved(claims, f"{folder}/claims")
    for c in ("subject_id", "object_id", "asserted_by_id"):
        every = _put(every, c, moves)
    loops = F.coalesce(F.col("subject_id") == F.col("object_id"), F.lit(False))
    survivors = moves.select("to_id").distinct()
    # Claims that a merge made equal: of these the one that was created first stays.
    near = every.join(survivors.withColumnRenamed("to_id", "subject_id"), "subject_id", "left_semi").select("claim_id").union(every.where("object_id IS NOT NULL").join(survivors.withColumnRenamed("to_id", "object_id"), "object_id", "left_semi").select("claim_id")).distinct()
    same = W.partitionBy("user_id", "subject_id", "predicate", "source_id", "object_id", "object_value", "asserted_by_kind", "asserted_by_id").orderBy("created_at", "claim_id")
    twins = every.join(near, "claim_id", "left_semi").withColumn("_n", F.row_number().over(same)).where(F.col("_n") > 1).select("claim_id")
    drop = every.where(loops).join(near, "claim_id", "left_semi").select("claim_id").union(twins)
    return saved(every.join(drop, "claim_id", "left_anti").select(*claims.columns), f"{folder}/merged")


def _after(effects: DataFrame, claims: DataFrame, nodes: DataFrame, links: DataFrame, aliases: DataFrame, at: Column, folder: str) -> dict[str, DataFrame]:
    moves = _moved(effects, folder)
    gone = effects.where("effect = 'no_node'").select("node_id").union(moves.select("from_id"))
    cast = {f.name: f.dataType for f in claims.schema}
    added = effects.where("effect = 'claim'")
    said = claims.join(added.select(F.col("text").alias("claim_id")).distinct(), "claim_id", "left_semi").select(F.col("claim_id").alias("text"), F.col("statement").alias("_said"))
    made = added.join(said, "text", "left")
    new = {"claim_id": "claim_id", "user_id": "user_id", "subject_id": "node_id", "object_id": "other_id", "object_value": "object_value", "predicate": "predicate", "scope": "scope", "source_id": "source_id", "asserted_by_kind": "by_kind"}
    fixed = {"statement": F.coalesce("_said", "text"), "status": F.lit("active"), **{c: at + F.make_dt_interval(secs=F.col("created") / 1e6) for c in ("stated_at", "created_at", "updated_at")}}
    created = made.select(*[(F.col(new[c]) if c in new else fixed.get(c, F.lit(None))).cast(cast[c]).alias(c) for c in claims.columns])
    ended = effects.where("effect = 'status'").groupBy("claim_id").agg(F.max_by("text", F.struct("run", "seq")).alias("_status"))
    old = claims.join(ended, "claim_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    created = saved(created, f"{folder}/created")
    every = old.select(*claims.columns) if created.isEmpty() else old.unionByName(created).select(*claims.columns)
    if not moves.isEmpty():
        every = _merged(every, moves, folder)
    new_nodes = effects.where("effect = 'node'").select("node_id", "user_id", "node_type", F.col("text").alias("label"), at.alias("created_at"))
    left = nodes.select("node_id", "user_id", "node_type", "label", "created_at").unionByName(new_nodes).join(gone, "node_id", "left_anti")
    single = F.col("predicate").isin(*SINGLE_CURRENT)
    tasks = left.where("node_type = 'Task'").select(F.col("node_id").alias("subject_id"))
    due = every.where(F.col("predicate").isin(*SINGLE_CURRENT_OF_TASK)).join(tasks, "subject_id", "left_semi").select(*claims.columns)
    kept = [c for c in claims.columns if c != "superseded_by"]
    chained = saved(every.where(single).unionByName(due).select(*kept), f"{folder}/chained")
    changed = saved(chained.join(created.select("claim_id").union(ended.select("claim_id")), "claim_id", "left_semi").select(*kept), f"{folder}/changed")
    resolved = recompute(chained, changed)
    # The rest are rows of other predicates, and of those of tasks the ones whose subject is none.
    free = every.where(~F.coalesce(single | F.col("predicate").isin(*SINGLE_CURRENT_OF_TASK), F.lit(False))).select(*claims.columns)
    free = free.unionByName(every.where(F.col("predicate").isin(*SINGLE_CURRENT_OF_TASK) & ~single).join(tasks, "subject_id", "left_anti").select(*claims.columns))
    rest = free.select(*kept).withColumn("superseded_by", F.lit(None).cast("string"))
    pick = effects.where("effect IN ('alias', 'no_alias')").withColumn("normalized_alias_text", normalize_alias(F.col("text")))
    last = pick.groupBy("user_id", "node_id", "normalized_alias_text").agg(F.max_by(F.struct("effect", "text"), F.struct("run", "seq")).alias("_last"))
    names = aliases.select("user_id", "node_id", "normalized_alias_text", "alias_text").join(last.drop("_last"), ["user_id", "node_id", "normalized_alias_text"], "left_anti")
    names = names.unionByName(last.where("_last.effect = 'alias'").select("user_id", "node_id", "normalized_alias_text", F.trim("_last.text").alias("alias_text"))).join(gone, "node_id", "left_anti")
    return {
        "claims": resolved.unionByName(rest.select(*resolved.columns)),
        "nodes": left.withColumn("canonical_label", normalize_label(F.col("label"))),
        "links": _put(links, "node_id", moves).distinct().join(effects.where("effect = 'no_node'").select("node_id"), "node_id", "left_anti"),
        "aliases": names,
        "redirects": moves,
    }
