"""The bracket markup: parsing to a flat node list, rewriting it, writing it out.

A document is a pre-order list of nodes. Parsing is a state machine over the
text's bracket structure with an explicit stack of open constructs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from palisade.core import entities
from palisade.core.brackets import PAIRS, position, unmatched

TEXT, RAW, REF, ELEMENT, ATTR, COMMENT = "text", "rawtext", "ref", "element", "attr", "comment"
SPACES = b" \t\r\n"
_START = r":A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�"
_MORE = r"\-.0-9·̀-ͯ‿-⁀"
#: An XML Name as a pattern that Python and Java both read.
NAME_PATTERN = f"[{_START}][{_START}{_MORE}]*"
_NAME = re.compile(NAME_PATTERN)
_PIECE = re.compile(rb"[()\[\]{}]|[^()\[\]{}]+")
_LEADING = re.compile(rb">[ \t\r\n]+")
_ESCAPED_BRACKET = re.compile(rb"\[[(\[{][<>][)\]}]\]\Z")
_SENSITIVE = b"[]{}"


@dataclass(slots=True)
class Node:
    kind: str
    name: str | None = None
    value: str | None = None
    parent: int = -1
    depth: int = 0
    end: int = 0
    ordinal: int = 0


class MarkupError(ValueError):
    def __init__(self, message: str, offset: int, data: bytes) -> None:
        self.message, self.offset = message, offset
        self.line, self.column = position(data, offset)
        super().__init__(f"{self.line}:{self.column} {message}")


class UnwritableError(ValueError):
    """A tree that no markup stands for."""


def is_name(raw: bytes) -> bool:
    try:
        return _NAME.fullmatch(raw.decode()) is not None
    except UnicodeDecodeError:
        return False


@dataclass(slots=True)
class _Open:
    """A construct being read: what it is, the closer it waits for, and its node if it has one."""

    what: str  # top, pair, content, attrs, quoted, bare, raw, comment, inner
    opener: int = 0
    node: int = -1
    mark: int = 0  # where a literal pair begins in the buffer
    markup: bool = True


@dataclass
class _Reader:
    data: bytes
    nodes: list[Node] = field(default_factory=list)
    held: bytearray = field(default_factory=bytearray)
    edge: int = 0  # the last bracket that sucks space, 0 for none
    edge_at: int = 0
    parents: list[int] = field(default_factory=lambda: [-1])

    def fail(self, message: str, offset: int) -> MarkupError:
        return MarkupError(message, offset, self.data)

    def add(self, kind: str, name: bytes | None = None, value: bytes | None = None) -> int:
        text = [None if x is None else x.decode("utf-8", "replace") for x in (name, value)]
        self.nodes.append(Node(kind, text[0], text[1], self.parents[-1], len(self.parents) - 1, len(self.nodes) + 1))
        return len(self.nodes) - 1

    def enter(self, node: int) -> None:
        self.parents.append(node)

    def leave(self) -> None:
        self.nodes[self.parents.pop()].end = len(self.nodes)

    def flush(self, upto: int | None = None, kind: str = TEXT) -> None:
        part = bytes(self.held if upto is None else self.held[:upto])
        if part:
            self.add(kind, value=part)
        self.held.clear()

    def name_before(self) -> bytes:
        """The run of name bytes the buffer ends in, without one leading space sucker."""
        n = len(self.held)
        while n and self.held[n - 1] not in b" \t\r\n()[]{}":
            n -= 1
        return bytes(self.held[n + (self.held[n : n + 1] == b"<") :])

    def saw(self, bracket: int) -> None:
        if bracket in _SENSITIVE:
            self.edge, self.edge_at = bracket, len(self.held)

    def suck(self, at_end: bool) -> bool:
        """Drop the white space that '>' after the last edge and, at an end, '<' before it mark."""
        sucked = False
        if self.edge:
            tail = bytes(self.held[self.edge_at :])
            if lead := _LEADING.match(tail):
                n = lead.end()
                both = at_end and n == len(tail) - 1 and tail.endswith(b"<")
                del self.held[self.edge_at : self.edge_at + (len(tail) if both else n)]
                sucked = True
            self.edge = 0
        if at_end and self.held[-1:] == b"<":
            n = len(self.held) - 1
            while n and self.held[n - 1] in SPACES:
                n -= 1
            if n < len(self.held) - 1:
                del self.held[n:]
                sucked = True
        return sucked


def parse(data: bytes, elements: bool = True) -> list[Node]:
    """Nodes of a document, in pre-order; raises MarkupError at the first fault.

    Without ``elements`` it is read as text and references alone."""
    r = _Reader(data)
    stack = [_Open("top", markup=elements)]
    at, size = 0, len(data)
    while at < size:
        top = stack[-1]
        if top.what == "attrs":
            at = _read_attrs(r, stack, at)
            continue
        if top.what == "element":  # its content must follow at once
            if data[at] != 0x5B:
                raise r.fail("expecting opener [", at)
            top.what, top.opener = "content", 0x5B
            r.saw(0x5B)
            at += 1
            continue
        piece = _PIECE.match(data, at)
        b = data[at]
        if b not in b"()[]{}":
            if top.what == "bare":
                run = piece.group()
                stop = next((i for i, x in enumerate(run) if x in SPACES), -1)
                if stop >= 0:
                    r.held += run[:stop]
                    _end_value(r, stack)
                    at += stop + 1
                    continue
            r.held += piece.group()
            at = piece.end()
        elif b in PAIRS:
            at = _open(r, stack, b, at)
        else:
            at = _close(r, stack, b, at)
    if len(stack) > 1:
        last = stack[-1]
        if last.what == "element":
            raise r.fail("expecting opener [", size)
        opener = last.opener or stack[-2].opener
        raise r.fail(f"unmatched opener {chr(opener)}", size)
    r.suck(False)
    r.flush()
    _number(r.nodes)
    return r.nodes


def _open(r: _Reader, stack: list[_Open], b: int, at: int) -> int:
    top = stack[-1]
    if top.what in ("raw", "comment", "inner"):
        r.held.append(b)
        stack.append(_Open("inner", b))
        return at + 1
    if top.markup and b != 0x28:
        name = r.name_before()
        if name:
            del r.held[len(r.held) - len(name) :]
            r.suck(True)
            r.flush()
            if name in (b"+", b"-"):
                if b != 0x5B:
                    raise r.fail("expecting opener [", at)
                stack.append(_Open("raw" if name == b"+" else "comment", b))
                return at + 1
            node = r.add(ELEMENT, name)
            r.enter(node)
            stack.append(_Open("element", 0, node))
            if b == 0x7B:
                stack.append(_Open("attrs", b, node))
                return at + 1
            return at
    r.suck(b != 0x28)
    stack.append(_Open("pair", b, mark=len(r.held), markup=top.markup))
    r.held.append(b)
    r.saw(b)
    return at + 1


def _close(r: _Reader, stack: list[_Open], b: int, at: int) -> int:
    top = stack[-1]
    if top.what == "bare":
        _end_value(r, stack)
        return at
    if top.what == "top":
        raise r.fail("expected end of file", at)
    if PAIRS[top.opener] != b:
        raise r.fail(f"opener {chr(top.opener)} closed with mismatched {chr(b)}", at)
    stack.pop()
    if top.what == "inner":
        r.held.append(b)
    elif top.what in ("raw", "comment"):
        r.flush(kind=RAW if top.what == "raw" else COMMENT)
        r.saw(b)
    elif top.what == "pair":
        _end_pair(r, top, b)
    else:  # content or quoted
        r.suck(True)
        r.flush()
        r.saw(b)
        r.leave()
        if top.what == "quoted":
            if at + 1 < len(r.data) and r.data[at + 1] not in SPACES + b"}":
                raise r.fail("end of attribute value expected", at + 1)
            r.suck(False)
    return at + 1


def _end_pair(r: _Reader, pair: _Open, b: int) -> None:
    plain = r.edge == 0x5B
    sucked = r.suck(b != 0x29)
    r.held.append(b)
    r.saw(b)
    if not (plain and not sucked) and not _ESCAPED_BRACKET.search(bytes(r.held[-5:])):
        return
    inner = bytes(r.held[pair.mark + 1 : -1])
    if inner in (b"<", b">") or not inner or any(x in SPACES for x in inner):
        return
    r.flush(pair.mark)
    r.saw(b)
    r.add(REF, inner)


def _read_attrs(r: _Reader, stack: list[_Open], at: int) -> int:
    """One step inside an attribute list: a separator, a name with its '=', or the end."""
    b = r.data[at]
    if b in SPACES:
        return at + 1
    end = at
    while end < len(r.data) and r.data[end] not in b" \t\r\n=()[]{}":
        end += 1
    if end == len(r.data):
        return end
    stop, name = r.data[end], r.data[at:end]
    if stop in PAIRS:
        raise r.fail("attribute name expected", end)
    if stop == 0x3D:
        if not is_name(name):
            raise r.fail("invalid attribute name", end)
        r.enter(r.add(ATTR, name))
        if r.data[end + 1 : end + 2] == b"[":
            stack.append(_Open("quoted", 0x5B, markup=False))
            r.saw(0x5B)
            return end + 2
        stack.append(_Open("bare", 0, markup=False))
        return end + 1
    if stop not in SPACES and stop != 0x7D:
        raise r.fail(f"opener {{ closed with mismatched {chr(stop)}", end)
    if name:
        raise r.fail("attribute value expected", end)
    stack.pop()
    return end + 1


def _end_value(r: _Reader, stack: list[_Open]) -> None:
    stack.pop()
    r.suck(False)
    r.flush()
    r.leave()


def _number(nodes: list[Node]) -> None:
    """Places among siblings: attributes and content are counted apart."""
    counts: dict[tuple[int, bool], int] = {}
    for n in nodes:
        key = (n.parent, n.kind == ATTR)
        n.ordinal = counts[key] = counts.get(key, -1) + 1


# --- rewriting -------------------------------------------------------------


def rebuild(tree: list) -> list[Node]:
    """Flat nodes of a forest of (kind, name, value, children); attributes come first."""
    out: list[Node] = []
    todo = [(item, -1, 0) for item in reversed(tree)]
    while todo:
        (kind, name, value, children), parent, depth = todo.pop()
        out.append(Node(kind, name, value, parent, depth))
        todo += [(c, len(out) - 1, depth + 1) for c in reversed(children)]
    for i in range(len(out) - 1, -1, -1):
        out[i].end = max(out[i].end, i + 1)
        if out[i].parent >= 0:
            out[out[i].parent].end = max(out[out[i].parent].end, out[i].end)
    _number(out)
    return out


def decode_entities(nodes: list[Node], names: dict[str, str] = entities.ALL) -> list[Node]:
    """References with a known name become text, except in attribute values."""
    return [
        Node(TEXT, None, names[n.name], n.parent, n.depth, n.end, n.ordinal) if n.kind == REF and n.name in names and not (n.parent >= 0 and nodes[n.parent].kind == ATTR) else n
        for n in nodes
    ]


_QUOTES = {"'": ("‘", "’"), '"': ("“", "”")}


def direct_quotes(nodes: list[Node]) -> list[Node]:
    """Quote elements give way to their content between directed quotation marks."""
    if not any(n.kind == ELEMENT and n.name in _QUOTES for n in nodes):
        return nodes
    out: list[Node] = []
    moved: dict[int, int] = {-1: -1}
    closing: list[tuple[int, str, int]] = []  # end in the old list, mark, new parent
    skip_to = 0

    def put(kind: str, name: str | None, value: str | None, parent: int) -> int:
        out.append(Node(kind, name, value, parent, 0 if parent < 0 else out[parent].depth + 1))
        return len(out) - 1

    for i, n in enumerate(nodes):
        while closing and closing[-1][0] <= i:
            _, mark, parent = closing.pop()
            put(TEXT, None, mark, parent)
        if i < skip_to:
            continue
        parent = moved[n.parent]
        if n.kind == ATTR and nodes[n.parent].kind == ELEMENT and nodes[n.parent].name in _QUOTES:
            skip_to = n.end
        elif n.kind == ELEMENT and n.name in _QUOTES:
            before, after = _QUOTES[n.name]
            put(TEXT, None, before, parent)
            moved[i] = parent
            closing.append((n.end, after, parent))
        else:
            moved[i] = put(n.kind, n.name, n.value, parent)
    while closing:
        _, mark, parent = closing.pop()
        put(TEXT, None, mark, parent)
    for i in range(len(out) - 1, -1, -1):
        out[i].end = max(out[i].end, i + 1)
        if out[i].parent >= 0:
            out[out[i].parent].end = max(out[out[i].parent].end, out[i].end)
    _number(out)
    return out


def escape_brackets(nodes: list[Node], names: dict[str, str] = entities.DECIMAL_ESCAPES) -> list[Node]:
    """Unmatched brackets of each list of siblings become references.

    All texts of a list count as one stream; attribute values stay as they are.
    A list with anything unmatched has its raw text turned into plain text.
    """
    streams: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        if n.kind in (TEXT, RAW) and not (n.parent >= 0 and nodes[n.parent].kind == ATTR):
            streams.setdefault(n.parent, []).append(i)
    split: dict[int, list[tuple[str, str]]] = {}
    for members in streams.values():
        texts = [nodes[i].value.encode() for i in members]
        lost = unmatched(b"".join(texts))
        if not lost:
            continue
        base = 0
        for i, t in zip(members, texts):
            parts, last = [], 0
            for at in (x - base for x in lost if base <= x < base + len(t)):
                parts += [(TEXT, t[last:at].decode()), (REF, names[chr(t[at])])]
                last = at + 1
            parts.append((TEXT, t[last:].decode()))
            split[i] = [p for p in parts if p[1]]
            base += len(t)
    if not split:
        return nodes
    out: list[Node] = []
    moved = {-1: -1}
    for i, n in enumerate(nodes):
        parent = moved[n.parent]
        for kind, text in split.get(i, [(None, "")]):
            out.append(Node(n.kind, n.name, n.value, parent, n.depth) if kind is None else Node(kind, text if kind == REF else None, None if kind == REF else text, parent, n.depth))
        moved[i] = len(out) - 1
    for i in range(len(out) - 1, -1, -1):
        out[i].end = max(out[i].end, i + 1)
        if out[i].parent >= 0:
            out[out[i].parent].end = max(out[out[i].parent].end, out[i].end)
    _number(out)
    return out


# --- writing ---------------------------------------------------------------


def escape(text: str, quotes: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quotes else text


def cdata(text: str) -> str:
    return "<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]>" if text else ""


def comment(text: str) -> str:
    return "<!--" + text.replace("--", "-&#45;") + "-->"


def write_tags(nodes: list[Node], xml: bool = False) -> str:
    """HTML or XML text of a forest."""
    out: list[str] = []
    closing: list[tuple[int, str]] = []
    i = 0
    while i < len(nodes):
        while closing and closing[-1][0] <= i:
            out.append(closing.pop()[1])
        n = nodes[i]
        if n.kind == TEXT or n.kind == RAW and not xml:
            out.append(escape(n.value))
        elif n.kind == RAW:
            out.append(cdata(n.value))
        elif n.kind == REF:
            out.append(f"&{n.name};")
        elif n.kind == COMMENT:
            out.append(comment(n.value))
        elif n.kind == ELEMENT:
            out.append("<" + n.name)
            i += 1
            while i < n.end and nodes[i].kind == ATTR:
                a = nodes[i]
                out.append(f' {a.name}="')
                out += [f"&{v.name};" if v.kind == REF else escape(v.value, True) for v in nodes[i + 1 : a.end]]
                out.append('"')
                i = a.end
            if i == n.end and (xml or n.name in entities.VOID):
                out.append("/>")
            else:
                out.append(">")
                closing.append((n.end, f"</{n.name}>"))
            continue
        i += 1
    out += [c[1] for c in reversed(closing)]
    return "".join(out)


_NAME_BYTES = bytes(b for b in range(256) if b not in SPACES and b not in b"()[]{}")
_MARKING = re.compile(rb"[\[{\]]")


def write_markup(nodes: list[Node]) -> str:
    """The bracket markup of a forest whose texts are balanced; false names and
    references are set apart by a space sucker. Raises UnwritableError for
    attributes that don't lead an element, and for nodes of no known kind."""
    out = bytearray()
    last, open_ref = 0x5B, False

    def put(data: bytes) -> None:
        nonlocal last, open_ref
        if not data:
            return
        last = data[-1]
        # Of a run of name bytes, what counts is the byte before it.
        edge = data[len(data.rstrip(_NAME_BYTES)) - 1 :][:1] if last in _NAME_BYTES else data[-1:]
        if edge and edge not in _NAME_BYTES:
            open_ref = edge == b"["
        out.extend(data)

    def glued() -> bool:
        return last not in SPACES and last not in b"()[]{}"

    def text(value: str, elements: bool) -> None:
        data = value.encode()
        at = 0
        for hit in _MARKING.finditer(data):
            put(data[at : hit.start()])
            at = hit.start()
            if glued() and ((elements and data[at] != 0x5D) or (data[at] == 0x5D and open_ref)):
                put(b" <")
            put(data[at : at + 1])
            at += 1
        put(data[at:])

    closing: list[int] = []
    i = 0
    while i < len(nodes):
        while closing and closing[-1] <= i:
            closing.pop()
            put(b"]")
        n = nodes[i]
        i += 1
        if n.kind == TEXT:
            text(n.value, True)
        elif n.kind == REF:
            put(f"[{n.name}]".encode())
        elif n.kind not in (RAW, COMMENT, ELEMENT):
            raise UnwritableError(f"{n.kind} out of place")
        else:
            lead = {RAW: "+", COMMENT: "-"}.get(n.kind) or n.name
            if glued() and lead:
                put(b" <")
            put(lead.encode())
            if n.kind != ELEMENT:
                put(f"[{n.value}]".encode())
                continue
            mark = b"{"
            while i < n.end and nodes[i].kind == ATTR:
                a = nodes[i]
                put(mark + f"{a.name}=[".encode())
                for v in nodes[i + 1 : a.end]:
                    if v.kind not in (REF, TEXT, RAW):
                        raise UnwritableError(f"{v.kind} in an attribute value")
                    put(f"[{v.name}]".encode()) if v.kind == REF else text(v.value, False)
                put(b"]")
                mark, i = b" ", a.end
            put(b"}[" if mark == b" " else b"[")
            closing.append(n.end)
    for _ in closing:
        put(b"]")
    return out.decode()


def convert(data: bytes) -> str:
    """Markup to HTML, with entities decoded and quotes directed."""
    return write_tags(direct_quotes(decode_entities(parse(data))))
