"""Documents of nodes and patches: parsing and rendering.  Pure Python, without Spark.

A node document is front matter and a body; a patch document holds many nodes,
a first-level heading for each type and a second-level heading with a YAML fence
for each node.  Of Markdown only what these forms need is read: headings,
paragraphs, lists and fences; other blocks are kept as prose, or dropped with
``strict``.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

try:
    import yaml
except ImportError:  # documents can't be read without it; tables can
    yaml = None

from ..functions.text import INLINE_LINK, LIST_LINK
from ..model import InvalidDocument
from ..operators.schema import Schema

_ITEM_LINK, _INLINE = re.compile(LIST_LINK, re.S | re.A), re.compile(INLINE_LINK, re.A)
#: The names of the leading prose by type.
LEADING = {"Source": "abstract", "Entity": "definition", "Resource": "relevance"}
TRAILING = "notes"

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$")
_BULLET = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:\s+(.*))?$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*(.*?)\s*$")
_BOLD = re.compile(r"^\*\*([^*]+)\*\*$")
#: what YAML readers differ on: tags, block scalars, question marks, breaks and control characters
_RARE = re.compile("[^\n -~\u00a1-\u2027\u2030-\ud7ff]|[!|>?]")
#: strings that YAML shows as they are, but for the words that it reads as something else
_BARE, _WORDS = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,99}(?: [A-Za-z0-9_]{1,99}){0,9}"), {"yes", "no", "on", "off", "true", "false", "null"}


@dataclass
class Link:
    predicate: str
    target: str
    alias: str = ""


@dataclass
class Node:
    id: str
    type: str
    published: dt.datetime | None = None
    attrs: dict[str, list] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)
    hrefs: list[Link] = field(default_factory=list)
    edges: list[Link] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)  # headings met for predicates that no schema knows


@dataclass
class Patch:
    document: str
    published: dt.datetime
    title: str = ""
    stats: dict | None = None
    nodes: list[Node] = field(default_factory=list)


def show(value) -> str:
    """The canonical string of a value, by which all comparisons are made."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{show(v)}" for k, v in sorted(value.items())) + "]"
    if isinstance(value, (list, tuple)):
        return "[" + " ".join(map(show, value)) + "]"
    return str(value)


def _plain(value):
    """YAML values with string keys and dates as strings."""
    if isinstance(value, dict):
        return {show(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _load(text: str):
    """YAML by the compiled reader, six times as fast; what it refuses, and text of rarer characters, by the plain one, whose word counts."""
    fast = getattr(yaml, "CSafeLoader", None)
    if fast and not _RARE.search(text):
        try:
            return yaml.load(text, Loader=fast)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(text)


def _yaml(text: str) -> dict:
    if yaml is None:
        raise InvalidDocument("no YAML reader is installed")
    try:
        value = _plain(_load(text)) or {}
    except yaml.YAMLError as e:
        raise InvalidDocument(f"bad YAML: {str(e).splitlines()[0]}") from None
    if not isinstance(value, dict):
        raise InvalidDocument("front matter is no mapping")
    return value


def date(value) -> dt.datetime | None:
    """A date in one of the three accepted layouts."""
    for layout in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S%z"):
        try:
            made = dt.datetime.strptime(str(value), layout)
        except ValueError:
            continue
        return made.astimezone(dt.timezone.utc).replace(tzinfo=None) if made.tzinfo else made
    return None


def front_matter(text: str) -> tuple[dict, str]:
    """Front matter and body of a document."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---":
        raise InvalidDocument("no front matter")
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return _yaml("\n".join(lines[1:i])), "\n".join(lines[i + 1 :])
    raise InvalidDocument("front matter has no end")


@dataclass
class Block:
    kind: str  # heading, prose, list, fence or other
    text: str = ""
    level: int = 0
    items: list[str] = field(default_factory=list)


def blocks(body: str) -> list[Block]:
    """Top-level blocks of a body."""
    out: list[Block] = []
    lines = body.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1])}\s*$", lines[j]):
                j += 1
            out.append(Block("fence", "\n".join(lines[i + 1 : j]), items=[m[2], "\n".join(lines[i : j + 1])]))
            i = j + 1
        elif m := _HEADING.match(line):
            out.append(Block("heading", m[2] or "", len(m[1])))
            i += 1
        elif m := _BULLET.match(line):
            block, i = _list(lines, i, m[2][-1])
            out.append(block)
        elif line.startswith(">") or line.startswith("    ") or line.startswith("|") or re.match(r"^ {0,3}([-*_])(\s*\1){2,}\s*$", line):
            j = i
            while j < len(lines) and lines[j].strip() and (j == i or lines[j][:1] in ">| "):
                j += 1
            out.append(Block("other", "\n".join(lines[i:j])))
            i = j
        else:
            j = i
            while j < len(lines) and lines[j].strip() and (j == i or not (_HEADING.match(lines[j]) or _FENCE.match(lines[j]) or _starts_list(lines[j]))):
                j += 1
            out.append(Block("prose", "\n".join(x.strip() for x in lines[i:j])))
            i = j
    return out


def _starts_list(line: str) -> bool:
    m = _BULLET.match(line)
    return bool(m and m[3] and (m[2] in "-*+" or m[2][:-1] == "1"))


def _list(lines: list[str], i: int, mark: str) -> tuple[Block, int]:
    items: list[list[str]] = []
    indent, nested, blank = 0, False, False
    while i < len(lines):
        line = lines[i]
        m = _BULLET.match(line)
        if m and m[2][-1] == mark:
            items.append([m[3] or ""])
            indent, nested, blank = len(m[1]) + len(m[2]) + 1, False, False
        elif m and len(m[1]) < 2:
            break
        elif not line.strip():
            blank = True
        elif line.startswith(" " * min(indent, 2)):
            nested = nested or bool(_BULLET.match(line.strip()))
            if not nested:
                items[-1].append(line.strip())
            blank = False
        elif blank or _HEADING.match(line) or _FENCE.match(line):
            break
        elif not nested:
            items[-1].append(line.strip())
        i += 1
    return Block("list", items=[" ".join(x for x in item if x) for item in items]), i


def _item_link(line: str) -> Link | None:
    m = _ITEM_LINK.match(line)
    return Link((m[1] or "").rpartition(":")[2], m[2].strip(), (m[3] or "").strip()) if m else None


def _split_items(items: list[str]) -> tuple[list[Link], list[str]]:
    links, lines = [], []
    for item in items:
        link = _item_link(item)
        if link:
            links.append(link)
        else:
            lines.append(item)
    return links, lines


def _inline(text: str) -> tuple[str, list[Link]]:
    links = []

    def plain(m: re.Match) -> str:
        link = Link(m[1] or "", m[2] or m[4], m[3] or m[5] or "")
        links.append(link)
        return link.alias or link.target

    return _INLINE.sub(plain, text), links


def _camelize(label: str) -> str:
    words = label.split()
    return "".join((w[0].lower() if i == 0 else w[0].upper()) + w[1:] for i, w in enumerate(words))


def read_body(node: Node, found: list[Block], schema: Schema, strict: bool = False) -> None:
    """Fill a node's texts, citations, links and labels from its blocks."""
    parts: list[tuple[str, object]] = []  # (titled, (label, items)), (list, items) or (prose, text)
    i = 0
    while i < len(found):
        b = found[i]
        title = b.text if b.kind == "heading" else (m[1] if b.kind == "prose" and (m := _BOLD.match(b.text)) else None)
        if title is not None and i + 1 < len(found) and found[i + 1].kind == "list":
            parts.append(("titled", (title, found[i + 1].items)))
            i += 2
            continue
        if b.kind == "list":
            parts.append(("list", b.items))
        elif b.kind == "prose":
            parts.append(("prose", b.text))
        elif not strict:
            parts.append(("prose", {"heading": "#" * b.level + " " + b.text, "fence": b.items[1] if b.items else ""}.get(b.kind, b.text)))
        i += 1
    by_label = schema.by_label() if any(kind == "titled" for kind, _ in parts) else {}
    lead: list[str] = []
    tail: list[str] = []
    named: dict[str, list[str]] = {}
    leading = True
    for kind, what in parts:
        if kind == "titled":
            leading = False
            label, items = what
            predicate = by_label.get(label) or (label if label in schema.predicates else None)
            if predicate and schema.role_of(predicate) == "text":
                named.setdefault(predicate, []).extend(items)
            elif predicate:
                node.edges += _split_items(items)[0]
            else:
                predicate = _camelize(label)
                links, lines = _split_items(items)
                for link in links:
                    link.predicate = link.predicate or predicate
                    node.labels[link.predicate] = label
                node.edges += links
                if lines:
                    named.setdefault(predicate, []).extend(lines)
                    node.labels[predicate] = label
        elif kind == "list":
            links, lines = _split_items(what)
            node.edges += links
            if lines:
                (lead if leading else tail).append("\n".join(f"* {x}" for x in lines))
            leading = False
        else:
            (lead if leading else tail).append(what)
    for slot, pieces in ((LEADING.get(node.type, "text"), lead), (TRAILING, tail)):
        text, links = _inline("\n\n".join(pieces))
        node.hrefs += links
        if text:
            node.texts[slot] = text
    for predicate, items in named.items():
        made = "\n".join(f"- {x}" for x in items)
        node.texts[predicate] = f"{node.texts[predicate]}\n{made}" if predicate in node.texts else made


def _take_attrs(node: Node, values: dict) -> None:
    if "published" in values:
        node.published = date(values.pop("published"))
    for key, value in values.items():
        made = value if isinstance(value, list) else [value]
        if made:
            node.attrs[key] = made


def is_camel_case(name: str) -> bool:
    return name[:1].isupper()


def parse_node(text: str, schema: Schema | None = None, strict: bool = False) -> Node:
    """A node document."""
    values, body = front_matter(text)
    if "kind" in values:
        raise InvalidDocument("the key kind is of an older form")
    id_, type_ = values.pop("@id", None), values.pop("@type", None)
    if not isinstance(id_, str) or not id_ or not isinstance(type_, str) or not type_:
        raise InvalidDocument("@id and @type are needed")
    node = Node(id_, type_)
    _take_attrs(node, values)
    found = blocks(body)
    if found and found[0].kind == "heading" and found[0].level == 1:
        found = found[1:]
    read_body(node, found, schema or Schema(), strict)
    return node


def looks_like_patch(text: str) -> bool:
    try:
        return front_matter(text)[0].get("kind") == "patch"
    except InvalidDocument:
        return False


def parse_patch(text: str, schema: Schema | None = None, strict: bool = False) -> Patch:
    """A patch document."""
    head, body = front_matter(text)
    document, published = head.get("document"), date(head.get("published"))
    if head.get("kind") != "patch" or not isinstance(document, str) or not document or published is None:
        raise InvalidDocument("kind: patch, document and published are needed")
    patch = Patch(document, published, show(head.get("title")), head.get("stats"))
    found = blocks(body)
    starts = [i for i, b in enumerate(found) if b.kind == "heading" and b.level == 2 and i + 1 < len(found) and found[i + 1].kind == "fence" and found[i + 1].items[0] == "yaml"]
    heads = [i for i, b in enumerate(found) if b.kind == "heading" and b.level == 1]
    if found and (not heads or heads[0] != 0):
        raise InvalidDocument("a patch begins with a type heading")
    ends = sorted([*starts, *heads, len(found)])
    for h, i in enumerate(heads):
        own = [s for s in starts if i < s < ([*heads, len(found)])[h + 1]]
        if not own:
            raise InvalidDocument(f"no node under {found[i].text}")
        for s in own:
            values = _yaml(found[s + 1].text) if found[s + 1].text.strip() else {}
            patch.nodes.append(_patch_node(found[i].text, found[s].text, values))
            stop = next(e for e in ends if e > s)
            read_body(patch.nodes[-1], found[s + 2 : stop], schema or Schema(), strict)
    return patch


def _patch_node(type_: str, id_: str, values: dict) -> Node:
    own_id, own_type = values.pop("@id", id_), values.pop("@type", None)
    if own_id != id_:
        raise InvalidDocument(f"@id {own_id} isn't the heading {id_}")
    if own_type is not None and str(own_type).casefold() != type_.casefold():
        raise InvalidDocument(f"@type {own_type} isn't the heading {type_}")
    type_ = str(own_type) if own_type is not None else type_
    if not is_camel_case(type_):
        raise InvalidDocument(f"type {type_} must begin in upper case")
    node = Node(id_, type_)
    _take_attrs(node, values)
    return node


# Rendering


def markup(link: Link) -> str:
    made = f"[[{link.target}|{link.alias}]]" if link.alias else f"[[{link.target}]]"
    return f"{link.predicate}:: {made}" if link.predicate else made


def _inline_markup(link: Link, suffix: str = "") -> str:
    shown = (link.alias or link.target) + suffix
    made = f"[[{link.target}]]" if shown == link.target else f"[[{link.target}|{shown}]]"
    return f"[{link.predicate}:: {made}]" if link.predicate else made


def insert_links(texts: dict[str, str], order: list[str], links: list[Link]) -> dict[str, str]:
    """Texts with each citation put back at the first fitting place of its shown words.

    A place fits if it starts a word, overlaps no other link, and ends a word or
    goes on in lower-case letters, which are then shown as part of the link.
    """
    taken = {k: [m.span() for m in re.finditer(r"\[\[.*?\]\]", texts.get(k, ""))] for k in order}
    found: dict[str, list[tuple[int, int, str]]] = {k: [] for k in order}
    for link in links:
        words = link.alias or link.target
        for key in order:
            pattern = re.compile(rf"(?<![^\W_]){re.escape(words)}([a-z]*)(?![^\W_])")
            place = next((m for m in pattern.finditer(texts.get(key, "")) if all(m.end() <= a or m.start() >= b for a, b in taken[key])), None)
            if place:
                taken[key].append(place.span())
                found[key].append((*place.span(), _inline_markup(link, place[1])))
                break
    out = dict(texts)
    for key, places in found.items():
        for start, end, made in sorted(places, reverse=True):
            out[key] = out[key][:start] + made + out[key][end:]
    return out


def _dump(value) -> str:
    if type(value) is bool:
        return "true" if value else "false"
    if type(value) is str and _BARE.fullmatch(value) and value.lower() not in _WORDS:
        return value
    if type(value) is list and all(type(x) is str and _BARE.fullmatch(x) and x.lower() not in _WORDS for x in value):
        return f"[{', '.join(value)}]"
    return yaml.safe_dump(value, default_flow_style=True, allow_unicode=True, width=1 << 20).strip().removesuffix("\n...").strip()


def attr_yaml(node: Node) -> str:
    lines = [f'"@id": {_dump(node.id)}', f'"@type": {_dump(node.type)}']
    for key in sorted(node.attrs):
        values = node.attrs[key]
        lines.append(f"{_dump(key)}: {_dump(values[0] if len(values) == 1 else values)}")
    if node.published:
        lines.append(f"published: {node.published:%Y-%m-%d}")
    return "\n".join(lines)


def render_edges(node: Node, schema: Schema) -> list[str]:
    """Blocks of links: flat ones, then a titled list for each predicate that is shown as a group."""
    grouped = lambda p: (schema.role_of(p) or ("link" if p in node.labels else "edge")) == "link"
    label = lambda p: (schema.predicates[p].label if p in schema.predicates else "") or node.labels.get(p) or schema.label_of(p)
    flat = [e for e in node.edges if not grouped(e.predicate)]
    groups: dict[str, list[Link]] = {}
    for e in node.edges:
        if grouped(e.predicate):
            groups.setdefault(e.predicate, []).append(e)
    out = ["\n".join(f"- {markup(e)}" for e in flat)] if flat else []
    for predicate in sorted(groups, key=label):
        body = "\n".join(f"- {markup(e)}" for e in groups[predicate])
        out.append(body if not flat and len(groups) == 1 else f"**{label(predicate)}**\n\n{body}")
    return out


def render_body(node: Node, schema: Schema) -> str:
    lead = LEADING.get(node.type, "text")
    texts = insert_links(node.texts, [k for k in (lead, TRAILING) if k in node.texts], node.hrefs)
    parts = [texts[lead]] if texts.get(lead) else []
    edges = render_edges(node, schema)
    others = [k for k in sorted(texts) if k not in (lead, TRAILING)]
    named = [f"**{node.labels.get(k) or schema.label_of(k)}**\n\n" + "\n".join(x if x.startswith("- ") else f"- {x}" for x in texts[k].split("\n")) for k in others]
    body = parts + named + edges if not (edges and not edges[0].startswith("**")) else parts + edges[:1] + named + edges[1:]
    if texts.get(TRAILING):
        body.append(texts[TRAILING])
    return "\n\n".join(body)


def render_node(node: Node, schema: Schema | None = None) -> str:
    """A node document; parsing it gives the node back."""
    body = render_body(node, schema or Schema())
    return f"---\n{attr_yaml(node)}\n---\n\n# {node.id}\n" + (f"\n{body}\n" if body else "")


def render_patch(patch: Patch, schema: Schema | None = None) -> str:
    """A patch document, nodes by type and id."""
    head = ["kind: patch", f"document: {_dump(patch.document)}", f"published: {patch.published:%Y-%m-%d}"]
    head += [f"title: {_dump(patch.title)}"] if patch.title else []
    head += [f"stats: {_dump(patch.stats)}"] if patch.stats else []
    parts = ["---\n" + "\n".join(head) + "\n---"]
    last = None
    for node in sorted(patch.nodes, key=lambda n: (n.type, n.id)):
        if node.type != last:
            parts.append(f"# {node.type}")
            last = node.type
        inner = "\n".join(attr_yaml(node).split("\n")[2:])
        body = render_body(node, schema or Schema())
        parts.append(f"## {node.id}\n```yaml\n{inner}\n```".replace("\n\n```", "\n```") + (f"\n\n{body}" if body else ""))
    return "\n\n".join(parts) + "\n"
