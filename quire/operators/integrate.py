"""Integration of several books' concepts by a replayable log of decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions import text as T
from quire.operators.graph import is_fact, ordered_set

ACTIONS = ("merge", "keep", "remove")
TARGET_RATIO = 0.3
AUTO_ADD = 0.72
STOP_AFTER = 40


@dataclass(frozen=True)
class Group:
    """A current node as the fold sees it: an id, the raw ids it stands for, its state and the decision that made it."""

    id: str
    raw: tuple[str, ...]
    status: str = "raw"
    decision_id: str | None = None
    detail: dict = field(default_factory=dict)


def _sha(text: str, n: int) -> str:
    return hashlib.sha1(text.encode(), usedforsecurity=False).hexdigest()[:n]


def _rest(group: Group, left: list[str]) -> list[Group]:
    if not left:
        return []
    if len(left) == 1:
        return [Group(left[0], (left[0],), group.status, group.decision_id)]
    return [replace(group, id=f"{group.id}_{_sha('|'.join(left), 6)}", raw=tuple(sorted(left)), status="merged")]


def apply_decision(groups: list[Group], decision: dict, known: set[str]) -> list[Group]:
    """One step of the fold.

    A merge joins all groups that hold an affected id, if they have two ids at least; a keep frees the affected ids, a
    remove drops them, and what is left of their groups is rebuilt. A keep that touches no group changes nothing, even
    if its ids were removed before.
    """
    affected = [i for i in dict.fromkeys(decision.get("affected_nodes") or []) if i in known]
    wanted, action = set(affected), decision["action"]
    if not wanted:
        return groups
    touched = [g for g in groups if wanted.intersection(g.raw)]
    if action == "merge":
        raw = sorted({i for g in touched for i in g.raw})
        if len(raw) < 2:
            return groups
        made = decision.get("result_node") or f"merged_{_sha('|'.join(raw), 8)}"
        new = Group(made, tuple(raw), "merged", decision.get("decision_id"), decision.get("result_node_detail") or {})
        return [*(g for g in groups if not wanted.intersection(g.raw)), new]
    if not touched:
        return groups
    out = []
    for g in groups:
        if not wanted.intersection(g.raw):
            out.append(g)
            continue
        if action == "keep":
            out += [Group(i, (i,), "kept", decision.get("decision_id")) for i in g.raw if i in wanted]
        out += _rest(g, [i for i in g.raw if i not in wanted])
    if action == "keep":
        present = {i for g in out for i in g.raw}
        out += [Group(i, (i,), "kept", decision.get("decision_id")) for i in affected if i not in present]
    return out


class _Live:
    """A group while a log is replayed: its raw ids, and what its id will be made from.

    ``base`` is its id as first given, or None for one that is made from the ids it had then; ``gone`` are the ids that
    left it since, step by step. No step lists or hashes the ids that it does not touch.
    """

    __slots__ = ("base", "decision_id", "detail", "gone", "n", "raw", "status")

    def __init__(self, base: str | None, raw: set[str], status: str = "raw", decision_id: str | None = None, detail: dict | None = None) -> None:
        self.base, self.raw, self.status, self.decision_id, self.detail, self.gone = base, raw, status, decision_id, detail or {}, []

    def group(self) -> Group:
        name, raw = self.base, sorted(self.raw)
        if self.gone:
            left = self.raw.union(*self.gone)
            raw = sorted(left)
            name = name or f"merged_{_sha('|'.join(raw), 8)}"
            for some in self.gone:
                left.difference_update(some)
                raw = [i for i in raw if i in left]
                name = f"{name}_{_sha('|'.join(raw), 6)}"
        return Group(name or f"merged_{_sha('|'.join(raw), 8)}", tuple(raw), self.status, self.decision_id, self.detail)


def replay(raw_ids: list[str], decisions: Iterable[dict]) -> list[Group]:
    """The whole log applied to the raw ids that it names; ids it never names stay as they are and need no fold.

    The same as apply_decision step by step, but a step takes as long as the ids it names and the smaller of the groups
    it joins: larger groups take the smaller ones in, and ids of groups are made at the end.
    """
    groups: dict[int, _Live] = {}
    at: dict[str, _Live] = {}
    known = set(raw_ids)

    def place(g: _Live) -> None:
        g.n = place.next
        groups[g.n] = g
        place.next += 1

    place.next = 0
    for i in raw_ids:
        at[i] = _Live(i, {i})
        place(at[i])
    for d in decisions:
        affected = [i for i in dict.fromkeys(d.get("affected_nodes") or []) if i in known]
        touched = sorted({at[i].n for i in affected if i in at})
        if not touched:
            continue
        before = [groups[k] for k in touched]
        if d["action"] == "merge":
            if len(before) == 1 and len(before[0].raw) < 2:
                continue
            large = max(before, key=lambda g: len(g.raw))
            for g in before:
                del groups[g.n]
                if g is not large:
                    large.raw |= g.raw
                    at.update(dict.fromkeys(g.raw, large))
            large.base, large.status, large.gone = d.get("result_node") or None, "merged", []
            large.decision_id, large.detail = d.get("decision_id"), d.get("result_node_detail") or {}
            place(large)
            continue
        wanted, kept = set(affected), d["action"] == "keep"
        for g in before:
            del groups[g.n]
            out = wanted & g.raw
            for i in sorted(out):
                del at[i]
                if kept:
                    at[i] = _Live(i, {i}, "kept", d.get("decision_id"))
                    place(at[i])
            g.raw -= out
            if len(g.raw) == 1:
                g.base, g.gone, g.detail = next(iter(g.raw)), [], {}
            elif g.raw:
                g.gone.append(out)
                g.status = "merged"
            if g.raw:
                place(g)
        for i in affected if kept else ():
            if i not in at:
                at[i] = _Live(i, {i}, "kept", d.get("decision_id"))
                place(at[i])
    return [g.group() for g in groups.values()]


def current_ids(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """raw_id, id, status and decision of each raw node that is still part of the graph.

    The whole log and the ids it names are folded on the driver, as each step depends on those before; README has the
    figures. All others are their own current node and stay distributed.
    """
    spark = raw.sparkSession
    told = [c for c in ("action", "affected_nodes", "decision_id", "result_node") if c in decisions.columns]
    log = decisions.select("seq", *told).orderBy("seq").toArrow()
    named = decisions.select(F.explode("affected_nodes").alias("id")).distinct()
    ids = raw.select("id", "ord").join(named, "id", "left_semi").orderBy("ord").toArrow()["id"].to_pylist()
    rows = [(i, g.id, g.status, g.decision_id) for g in replay(ids, (d for some in log.to_batches(10_000) for d in some.to_pylist())) for i in g.raw]
    names = ("raw_id", "id", "status", "decision_id")
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    folded = spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, columns, strict=True)}), ", ".join(f"{n} string" for n in names))
    others = raw.select("id").join(named, "id", "left_anti")
    return others.select(F.col("id").alias("raw_id"), "id", F.lit("raw").alias("status"), F.lit(None).cast("string").alias("decision_id")).unionByName(folded)


def merged_nodes(raw: DataFrame, current: DataFrame) -> DataFrame:
    """Attributes of current nodes from their raw ones: shortest name, longest definition, sets in order, smallest page.

    Categories, and chapters and sources where raw nodes have them, are gathered in the order of raw ids, which are listed
    too. A raw node without page counts as page 0.
    """
    r = raw.withColumnRenamed("id", "raw_id").join(current.select("raw_id", "id", "status"), "raw_id")
    lists = [ordered_set("chapter", "raw_id").alias("chapters")] if "chapter" in raw.columns else []
    lists += [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("raw_id", "sources"))), lambda x: x["sources"])).alias("sources")] if "sources" in raw.columns else []
    return r.groupBy("id").agg(
        F.array_sort(F.collect_set("raw_id")).alias("merged_from"),
        ordered_set("category", "raw_id").alias("categories"),
        *lists,
        F.min_by("name", F.struct(F.length("name").alias("n"), F.col("raw_id"))).alias("name"),
        F.max_by("definition", F.struct(F.length(T.compact_text(F.col("definition"))).alias("n"), (-F.col("ord")).alias("o"))).alias("definition"),
        F.min_by("category", "raw_id").alias("category"),
        F.array_join(ordered_set("textbook_id", "raw_id"), "；").alias("textbook_id"),
        F.min(F.coalesce("page", F.lit(0))).alias("page"),
        F.count("*").alias("frequency"),
        F.max("status").alias("status"),
    )


EDGE = ("source", "target", "relation_type", "description")


def _moved(edges: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Edges with new_source and new_target, and whatever else ``ids`` (raw_id, id) tell of an end.

    Edges are far more than nodes: the ids of a partition are hashed, so that edges need not be sorted by their ends.
    """
    for end in ("source", "target"):
        told = ids.select(F.col("raw_id").alias("_raw"), *(F.col(c).alias(f"new_{end}" if c == "id" else f"{c}_{end}") for c in ids.columns if c != "raw_id"))
        edges = edges.join(told.hint("shuffle_hash"), F.col(end) == F.col("_raw"), how).drop("_raw")
    return edges


def rewrite_edges(edges: DataFrame, current: DataFrame) -> DataFrame:
    """Edges between current nodes: ends moved, loops and lost ends dropped, the first of equal edges kept and numbered.

    Equal edges are grouped, not ordered, and columns that nobody reads are not carried.
    """
    e = _moved(edges, current.select("raw_id", "id"), "inner").where("new_source != new_target").drop("source", "target")
    e = e.withColumnRenamed("new_source", "source").withColumnRenamed("new_target", "target")
    place = F.struct(F.col("ord").isNull(), "ord")
    rest = [F.min("ord").alias("ord") if c == "ord" else F.min_by(c, place).alias(c) for c in e.columns if c not in EDGE]
    return e.groupBy(*EDGE).agg(*rest).select(*e.columns)


def edge_counts(edges: DataFrame, current: DataFrame) -> DataFrame:
    """edges_before, and edges_after as rewrite_edges leaves them, from one pass over the edges.

    An edge that goes stays with empty keys, to be counted before; of an id that ``current`` lists twice only the first
    counts there. These are found in a shuffle of their own (hence the length), so that adaptive execution can still split
    the edges of a frequent end.
    """
    first = F.row_number().over(W.partitionBy("raw_id", F.length("raw_id")).orderBy("id")) == 1
    e = _moved(edges, current.select("raw_id", "id", first.cast("int").alias("_n")), "left")
    stays = F.col("new_source") != F.col("new_target")
    keys = [F.when(stays, F.col(f"new_{c}" if c in ("source", "target") else c)).alias(c) for c in EDGE]
    n = F.coalesce("_n_source", F.lit(1)) * F.coalesce("_n_target", F.lit(1))
    return e.select(*keys, n.alias("n")).groupBy(*EDGE).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges_before"), F.count("source").alias("edges_after"))


def resolve_ends(edges: DataFrame, raw: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Ends that are no id are looked up among names, the first node of a name winning; unresolved edges go."""
    names = raw.withColumn("key", T.match_key(F.col("name"), ascii_only)).where("key != ''").groupBy("key").agg(F.min_by("id", "ord").alias("by_name"))
    ids = raw.select(F.col("id").alias("by_id")).distinct()
    for end in ("source", "target"):
        e = edges.join(ids, F.col(end) == F.col("by_id"), "left").join(names, T.match_key(F.col(end), ascii_only) == F.col("key"), "left")
        edges = e.withColumn(end, F.coalesce("by_id", "by_name")).drop("by_id", "by_name", "key").where(F.col(end).isNotNull())
    return edges


def raw_chars(definition: Column, quotes: Column, name: Column) -> Column:
    """Characters a raw node stands for: its definition and its quotes, or its name where it has none."""
    said = F.array_join(F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), T.compact_text), lambda q: q != ""), "")
    return F.greatest(F.lit(1), F.length(T.compact_text(definition)) + F.length(F.when(said != "", said).otherwise(T.compact_text(name)))).cast("long")


def integrated_chars(definition: Column, name: Column) -> Column:
    return F.greatest(F.lit(1), T.count_chars(T.compact_text(F.coalesce(definition, name)))).cast("long")


def _before(raw: DataFrame, *more: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    return raw.agg(F.sum(raw_chars(F.col("definition"), none, F.col("name"))).alias("nodes_chars"), *more)


def _after(current: DataFrame, *more: Column) -> DataFrame:
    return current.agg(F.sum(integrated_chars(F.col("definition"), F.col("name"))).alias("integrated_chars"), *more)


def _told(one: DataFrame, book_chars: DataFrame | None, *more: str) -> DataFrame:
    """Compression from one row with nodes_chars and integrated_chars, after its columns ``more``."""
    parsed = (book_chars or one.sparkSession.range(0).select(F.col("id").alias("total_chars"))).agg(F.coalesce(F.sum("total_chars"), F.lit(0)).alias("parsed"))
    original = F.when(F.col("parsed") > 0, F.col("parsed")).otherwise(F.col("nodes_chars"))
    ratio = F.col("integrated_chars") / F.greatest(F.lit(1), original)
    source = F.when(F.col("parsed") > 0, "parsed_textbook_total_chars").otherwise("node_content_fallback")
    return one.join(parsed, F.lit(True)).select(*more, original.cast("long").alias("original_chars"), F.col("integrated_chars").cast("long").alias("integrated_chars"), F.round(ratio, 4).alias("ratio"), (ratio <= TARGET_RATIO).alias("target_met"), source.alias("source"))


def compression(raw: DataFrame, current: DataFrame, book_chars: DataFrame | None = None) -> DataFrame:
    """Characters before and after integration, their ratio and whether it meets the target."""
    return _told(_before(raw).join(_after(current), F.lit(True)), book_chars)


def action_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS))


def remaining(raw: DataFrame, decisions: DataFrame) -> DataFrame:
    """Raw nodes, those that the log names, those left, and whether to go on."""
    named = decisions.select(F.explode("affected_nodes").alias("id")).distinct().join(raw.select("id"), "id", "left_semi").agg(F.count("*").alias("processed"))
    left = F.greatest(F.lit(0), F.col("raw") - F.col("processed"))
    return raw.agg(F.count("*").alias("raw")).join(named, F.lit(True)).select("raw", "processed", left.cast("long").alias("remaining"), (left > 0).alias("should_continue"))


def comparison(raw: DataFrame, edges: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes and edges before and after; ``current`` tells the id of each raw node that is left."""
    nodes = raw.agg(F.count("*").alias("nodes_before")).join(current.agg(F.count_distinct("id").alias("nodes_after")), F.lit(True))
    return nodes.join(edge_counts(edges, current), F.lit(True)).select("nodes_before", "edges_before", "nodes_after", "edges_after")


def graph_summary(raw: DataFrame, edges: DataFrame, merged: DataFrame, current: DataFrame, decisions: DataFrame, book_chars: DataFrame | None = None) -> DataFrame:
    """One row with all that is told of an integrated graph: before and after, compression, and the log's actions.

    ``merged`` are the merged nodes (id, name, definition, frequency), a row an id; raw nodes that none of them stands for
    are removed. ``current`` tells the id of each raw node. Nodes are read once before and once after, edges once;
    ``decisions`` needs its actions only.
    """
    nodes = _before(raw, F.count("*").alias("nodes_before")).join(_after(merged, F.count("id").alias("nodes_after"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("_kept")), F.lit(True))
    one = nodes.join(edge_counts(edges, current), F.lit(True))
    told = _told(one, book_chars, "nodes_before", "edges_before", "nodes_after", "edges_after", "_kept").join(action_counts(decisions), F.lit(True))
    return told.withColumn("removed", F.greatest(F.lit(0), F.col("nodes_before") - F.col("_kept")).cast("long")).drop("_kept")


def decision_ids(decisions: DataFrame, placed: bool = False) -> DataFrame:
    """Ids by action and place in the log; ``placed`` says that ``seq`` is that place already."""
    n = F.col("seq") if placed else F.row_number().over(W.orderBy("seq"))  # places need an order over the whole log
    return decisions.withColumn("decision_id", F.concat("action", F.lit("_"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def should_stop(integrated: Column, should_continue: Column, action: Column, necessary: Column) -> Column:
    """Whether rounds of integration end after this result."""
    return ~F.coalesce(necessary, F.lit(True)) | ~F.coalesce(integrated, F.lit(False)) | F.coalesce(action.isin("keep", "explain"), F.lit(False)) | ~F.coalesce(should_continue, F.lit(True))


def run_rounds(step, most: int = STOP_AFTER) -> list[dict]:
    """Calls ``step`` (one round; it returns a result or None) until a result says to stop, ``most`` times at most."""
    out: list[dict] = []
    for _ in range(most):
        result = step(len(out))
        if result is None:
            break
        out.append(result)
        need = (result.get("necessity") or {}).get("necessary")
        if need is False or result.get("integrated") is not True or result.get("action") in ("keep", "explain") or result.get("should_continue") is False:
            break
    return out


def factual(edges: DataFrame) -> DataFrame:
    return edges.where(is_fact())
