"""The read verbs as text: documents, match tables and subgraphs as patches."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, NodeNotFound
from ..operators import graph as traversal
from ..operators.definitions import Changes
from ..operators.filters import Filter, matching
from ..operators.grep import fit_window, grep, highlight
from ..operators.schema import Schema
from ..operators.store import Outcome, count_text
from ..sources import codec

SHOWN = 10_000  # rows of a table made for reading; of more it says that there are more


def to_json(df: DataFrame) -> DataFrame:
    """One column of JSON objects."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def load_nodes(graph: Graph, ids: DataFrame) -> list[codec.Node]:
    """Nodes of a bounded set of ids, whole."""
    own = lambda df, c: df.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    out = {r["id"]: codec.Node(r["id"], r["type"], r["published"]) for r in own(graph.nodes, "id").collect()}
    for r in own(graph.attrs, "id").orderBy("id", "key", "pos").collect():
        out[r["id"]].attrs.setdefault(r["key"], []).append(_typed(r["value_str"], r["vtype"]))
    for r in own(graph.texts, "id").collect():
        out[r["id"]].texts[r["key"]] = r["value"]
    for table, name in ((graph.edges, "edges"), (graph.hrefs, "hrefs")):
        for r in own(table, "src").orderBy("src", "pos").collect():
            getattr(out[r["src"]], name).append(codec.Link(r["predicate"] or "", r["dst"], r["alias"] or ""))
    return [out[k] for k in sorted(out)]


def _typed(value: str | None, kind: str):
    if value is None:
        return None
    if kind == "bool":
        return value == "true"
    return int(value) if kind == "int" else float(value) if kind == "float" else value


def node_get(graph: Graph, id_: str, schema: Schema | None = None) -> str:
    """One node's document; NodeNotFound without it."""
    found = graph.nodes.where(F.col("id") == id_).select("id").limit(1)
    if found.isEmpty():
        raise NodeNotFound(id_)
    return codec.render_node(load_nodes(graph, found)[0], schema)


def search(graph: Graph, pattern: str, filter_: Filter = Filter()) -> DataFrame:
    """(type, id, path, line, text, start, end) of the lines that match, by path and line."""
    kept = matching(graph.nodes, graph.attrs, filter_).where("matches").select("type", "id", "path", "raw")
    return grep(kept, pattern).select("type", "id", "path", "line", "text", "start", "end").orderBy("path", "line")


def node_grep(graph: Graph, pattern: str, spec: dict | None = None, width: int = 512) -> str:
    """Matches as a Markdown table."""
    rows = search(graph, pattern, Filter.from_json(spec)).limit(SHOWN + 1).collect()
    cell = lambda s: str(s).replace("|", "\\|")
    lines = ["| type | id | line | text |", "|---|---|---|---|"]
    lines += [f"| {cell(r['type'])} | {cell(r['id'])} | {r['line']} | {cell(fit_window(r['text'], r['start'], r['end'], width))} |" for r in rows[:SHOWN]]
    return "\n".join(lines + (["", f"more than {SHOWN} matches"] if len(rows) > SHOWN else []))


def grep_text(graph: Graph, pattern: str, spec: dict | None = None, width: int = 512, color: bool = False) -> str:
    """Matches as lines of a terminal (path, line, text), the match between marks if color is wanted."""
    rows = search(graph, pattern, Filter.from_json(spec)).limit(SHOWN + 1).collect()
    lines = []
    for r in rows[:SHOWN]:
        text = highlight(r["text"], r["start"], r["end"]) if color and len(r["text"].encode()) <= width else fit_window(r["text"], r["start"], r["end"], width)
        lines.append(f"{r['path']}:{r['line']}: {text}")
    return "\n".join(lines + ([f"more than {SHOWN} matches"] if len(rows) > SHOWN else []))


def slug(text: str) -> str:
    made = "".join(c if c.isascii() and c.isalnum() else "-" for c in text.lower())
    return "-".join(x for x in made.split("-") if x)


def subgraph_get(graph: Graph, seed: str, now: dt.datetime, depth: int = 1, spec: dict | None = None, stubs: bool = False, direct_cap: int = 4096, backlink_cap: int = 1024, schema: Schema | None = None) -> str:
    """A node's surroundings as a patch document; the caps bound its size."""
    filter_ = Filter.from_json(spec)
    nodes = matching(graph.nodes, graph.attrs, filter_)
    found = traversal.subgraph(nodes, graph.edges, seed, depth, direct_cap, backlink_cap, F.col("matches") if filter_ != Filter() else None, stubs)
    members = load_nodes(graph, found.members.where("part <> 'stub'").select("id"))
    if stubs:
        outer = found.members.where("part = 'stub'").select("id").join(graph.nodes, "id").select("id", "type").orderBy("id").collect()
        members += [codec.Node(r["id"], r["type"]) for r in outer]
    stats = {"nodes": len(members), "reachableDirect": found.direct, "reachableBacklinks": found.backlinks, "truncatedDirect": found.direct_truncated, "truncatedBacklinks": found.backlinks_truncated}
    patch = codec.Patch(f"subgraph:{slug(seed)}@{now:%Y-%m-%dT%H:%M:%SZ}", now, stats=stats, nodes=members)
    return codec.render_patch(patch, schema)


def result_json(rows: DataFrame, most: int = SHOWN) -> str:
    """A result as indented JSON; ValueError for one of more rows than may reach the driver, which to_json writes as a table."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([r.asDict(True) for r in found], indent=2, default=str, ensure_ascii=False)


def ingested_text(outcome: Outcome) -> str:
    """What an ingestion did, for people."""
    if outcome.skipped:
        return f"{outcome.document} is in the graph already"
    lines = [f"Ingested {outcome.document}", f"  created  {count_text(outcome.created)}", f"  merged   {count_text(outcome.merged)}"]
    return "\n".join(lines + [f"  warning: {w}" for w in outcome.warnings])


def retracted_text(outcome: Outcome) -> str:
    """What a retraction did, for people."""
    if outcome.skipped:
        return f"{outcome.document} is out already"
    return "\n".join([f"Retracted {outcome.document} ({outcome.approach})", f"  removed     {count_text(outcome.removed)}", f"  reconciled  {count_text(outcome.reconciled)}", f"  links removed: {outcome.links_removed}"])


def violations_text(violations: DataFrame, checked: int, passing: int) -> str:
    """Violations by document, the first of them, and the totals."""
    rows = violations.limit(SHOWN + 1).collect()
    lines, last = [], None
    for r in rows[:SHOWN]:
        if r["id"] != last:
            lines.append(str(r["id"]))
            last = r["id"]
        line = r.asDict().get("line")
        lines.append(f"  {f'{line}: ' if line else ''}{r['rule']} {r['detail'] or ''}".rstrip())
    more = [f"more than {SHOWN} violations"] if len(rows) > SHOWN else []
    return "\n".join([*lines, *more, f"{checked} checked, {passing} passing, {checked - passing} failing"])


def definitions_text(changes: Changes) -> str:
    """What a schema patch did, for people."""
    parts = [f"{name} {', '.join(getattr(changes, name))}" for name in ("created", "updated", "conflicts") if getattr(changes, name)]
    return "\n".join([*parts, f"{len(changes.unchanged)} unchanged"])


def made_text(paths: list[str]) -> str:
    """What a new graph holds, for people."""
    return f"Made a graph with {len(paths)} definitions"
