"""Secret scan: assignment-aware lexing of source and configuration text.

Two layers give spans of a text, in code points, end exclusive:

* base patterns: ``assign`` (a sensitive name, ``:`` or ``=``, a literal), ``access`` (access-key
  ids) and ``hex`` (long hexadecimal runs);
* ``literal``: the text is lexed into name-literal pairs. On the left stand assignments of programming
  and configuration languages (``name = ``, ``name: ``, ``name := ``, ``name: type = ``, ``"name": ``, ``x["name"] = ``, ``--name ``),
  arguments (``f("name", "..")``), elements and attributes (``<name>..</name>``, ``key="name" value=".."``),
  lists of ``name: .. value: ..``, and passwords in URLs. On the right stands an expression: strings with their
  escapes, of one or three quotes, here-documents, YAML blocks, bare words, and what joins them. Names of constants are
  looked up in a table of those seen so far, so a literal is found under every name that it is given to. A constant
  refers to those it is made of: it carries all of their pieces, however many, and none is copied.
  A pair is reported if the score of its name (how sensitive its last words are) and of its literal
  (length, mix of characters, entropy) reach ``THRESHOLD`` together. Literals are scored as one and reported
  where they are written, each joined piece that stands elsewhere by itself.

Each row is scanned on its own in Arrow batches; nothing is shuffled and nothing is kept between
rows. Work is linear in the text: runs are possessive, and an expression is read once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import in_arrow

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "literal")
# fixed values: the base patterns, and the least length of what they find
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be found
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: How sensitive a word of a name is.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "authorization": 0.9, "accesskey": 1.0, "secretkey": 1.0, "clientsecret": 1.0, "authtoken": 1.0, "bearer": 0.8, "urlpassword": 1.0, "signature": 0.6, "salt": 0.6,
}
#: Pairs of neighbouring words that are sensitive together.
NAME_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("encryption", "key"), ("signing", "key"), ("auth", "token"), ("account", "key"), ("storage", "key"), ("master", "key")}
#: Literals that stand for a value.
PLACEHOLDERS = re.compile(r"(?i)^(?:x{4,}|\*+|\.+|-+|_+|changeme|change_me|example|placeholder|redacted|none|null|true|false|undefined|your[-_ ]?\w*|<.*>|\$\{.*|\{\{.*|%\(.*|env\..*|os\.environ.*|process\.env.*|test|dummy|sample)$")
THRESHOLD = 1.5
#: Characters at both ends that tell whether a literal is a placeholder, with the set of those between: more than
#: the longest word or beginning in ``PLACEHOLDERS``.
EDGE = 16

# Runs are possessive: none is tried again from its middle, however long it is.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
_PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_$.-])(?:
      ["'](?P<qname>{_NAME})["']\s*+(?:\]\s*+(?:=(?!=))|=>|:=|[:=]|,(?=\s*+["']))
    | (?:--?)?(?P<name>{_NAME})[^\S\n]*+(?::[^\S\n]*+[A-Za-z_][A-Za-z0-9_.<>\[\]?]*+[^\S\n]*+=(?![=>])|:=|=>|===?|[:=])
    | (?P<late>{_NAME})\s++(?::=|=>|=(?!=))
    | --(?P<flag>{_NAME})\x20
    | <(?P<tag>{_NAME})>
    )
    | ://[^\s:@/"'<>]*+:(?=[^\s@/"'<>]++@)(?P<url>)""",
    re.X,
)
# Blanks before a literal go on to the next lines, unless another pair stands there.
_BLANK = re.compile(rf"""[^\S\n]*+(?!\n)|\s*+(?!(?:-[^\S\n]++)?["']?{_NAME}["']?[^\S\n]*+(?::=|=>|[:=])[^\S\n]*+[^\s=])""")
_STRING = re.compile(r"""[rRbBfFuU]{0,2}(?:(?P<q3>\"{3}|'{3})|(?P<q>["'`]))""")
_REST = {q: re.compile(rf"(?:[^{q}\\\n]|\\[^\n])*+(?={q})") for q in "\"'`"}
_HERE = re.compile(r"""(?:\$\(\s*+cat\s*+)?<<[-~]?["']?([A-Za-z_]\w*+)["']?[^\n]*+\n""")
_BLOCK = re.compile(r"[|>][0-9+-]*+[^\S\n]*+\n")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~@!#$%^&*:-]++")
_IDENTIFIER = re.compile(r"[$]?[{]?([A-Za-z_$][A-Za-z0-9_$.]*+)[}]?$")
_JOIN = re.compile(r"""\s*+(?:\+|\.\.?(?=\s)|&(?!&)|\|\|)\s*+|\s*+(?=["'])""")
_OPEN = re.compile(r"(?:(?:new\s++)?[A-Za-z_][A-Za-z0-9_.]*+)?[(\[]\s*+")
_USED = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*+)\}|\{([A-Za-z_][A-Za-z0-9_.]*+)\}|%\(([A-Za-z_]\w*+)\)s")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([^\n]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_SCHEMES = ("Bearer", "Basic", "Token", "bearer", "basic")
#: Names whose literal is itself the name of the value that follows, and names of such values.
_KEYS, _VALUES = frozenset(("key", "name", "id", "property", "param")), frozenset(("value", "val", "content"))
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HINT = re.compile(r"(?i)pass|pwd|secret|token|key|credential|bearer|signature|salt|authorization|://[^\s/@]*+@")


def name_score(name: str) -> float:
    words = [w.lower() for w in _SPLIT.findall(name)]
    score = max([NAME_WORDS.get(w, 0.0) for w in words[-2:]] + [NAME_WORDS.get("".join(words[-2:]), 0.0)], default=0.0)
    return max(score, 1.0 if tuple(words[-2:]) in NAME_PAIRS else 0.0)


class Measure(NamedTuple):
    """What ``literal_score`` needs to know of a literal; ``total`` has it of literals one after the other."""

    n: int
    counts: dict[str, int]  # of its characters, in the order in which they first occur
    head: str
    tail: str
    blank: bool  # nothing but white space
    leads: bool  # whether a space is in the white space before the first other character,
    trails: bool  # behind the last one,
    inner: bool  # and between these


def measure(value: str) -> Measure:
    body = value.strip()
    leads, trails = " " in value[: len(value) - len(value.lstrip())], " " in value[len(value.rstrip()) :]
    return Measure(len(value), Counter(value), value[:EDGE], value[-EDGE:], not body, leads, trails, " " in body)


def total(measures: list[Measure]) -> Measure:
    if len(measures) == 1:
        return measures[0]
    n, counts, head, tail, blank, leads, trails, inner = 0, {}, "", "", True, False, False, False
    for m in measures:
        n += m.n
        for c, k in m.counts.items():
            counts[c] = counts.get(c, 0) + k
        head, tail = head + m.head[: EDGE - len(head)], (tail + m.tail)[-EDGE:]
        inner = inner or m.inner or not blank and not m.blank and (trails or m.leads)
        leads, trails, blank = leads or blank and m.leads, m.trails or m.blank and trails, blank and m.blank
    return Measure(n, counts, head, tail, blank, leads, trails, inner)


def _sample(m: Measure) -> str:
    """A string that matches ``PLACEHOLDERS`` if the literal does: short ones whole, of others the ends and each
    character between them once. The patterns ask for a word, or for a beginning, an end and a class of all others."""
    if m.n <= 2 * EDGE:
        return m.head + m.tail[max(0, 2 * EDGE - m.n) :] if m.n > EDGE else m.head
    ends = Counter(m.head + m.tail)
    return m.head + "".join(c for c, k in m.counts.items() if k > ends[c]) + m.tail


def literal_score(value: str) -> float:
    """0 to 1: constants of one kind of character, words and placeholders are low."""
    return measured_score(measure(value))


def measured_score(m: Measure) -> float:
    n, letters = m.n, "".join(m.counts)
    if n < 8 or m.inner or PLACEHOLDERS.match(_sample(m)):
        return 0.0
    bits = -sum(p * math.log2(p) for c in m.counts.values() if (p := c / n))
    kinds = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if not re.search("[0-9]", letters) and not (kinds > 2 and bits > 3.5):
        return 0.0
    return min(1.0, bits / 4.5) * (min(n, 16) / 16) ** 0.5 * (0.7 + 0.1 * kinds)


#: A piece of a literal as it is read, and where it is written.
Piece = tuple[str, int, int]


class Constant:
    """The literal of an expression: its pieces and the constants that it names, in order.

    Pieces that are written one after the other are one span. ``left`` and ``right`` are the first and the last span, the
    same one if it is ``single``; ``inside`` has those between, and the ``inside`` of constants it is made of. So a constant has
    the size of its expression, and not of its literal, which may double with each line.
    """

    __slots__ = ("parts", "one", "left", "right", "single", "inside", "_measure", "_score")

    def __init__(self, parts: list[Piece | Constant], joined):
        self.parts = parts
        self.one = self.left = self.right = self._measure = self._score = None
        self.single = True
        self.inside: list = []
        for x in parts:
            if isinstance(x, tuple):
                self.one = x if self.left is None else None
                self._append((x[1], x[2]), None, (), joined)
            elif x.left:
                self.one = x.one if self.left is None else None
                self._append(x.left, None if x.single else x.right, x.inside, joined)

    def _append(self, left: tuple[int, int], right: tuple[int, int] | None, inside, joined) -> None:
        """The spans of a part: the first, the last if there is another, and those between."""
        if inside:
            self.inside.append(inside)
        if self.left is None:
            self.left, self.right, self.single = left, right or left, right is None
            return
        if joined(self.right[1], left[0]):
            left = (self.right[0], left[1])
            if self.single:
                self.left = left
        elif self.single:
            self.single = False
            if right:
                self.inside.append(left)
            self.right = right or left
            return
        else:
            self.inside.append(self.right)
        if right and not self.single:
            self.inside.append(left)
        self.right, self.single = right or left, self.single and right is None

    def pieces(self) -> list[Piece]:
        """All of them, as often as they occur, of a constant that has no score yet."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x)
            else:
                stack.extend(reversed(x.parts))
        return out

    def score(self) -> float:
        """``literal_score`` of the whole literal. Parts are let go as soon as they are measured."""
        if self._score is None:
            stack = [self]
            while stack:
                x = stack[-1]
                if x._measure is None and (first := [p for p in x.parts if isinstance(p, Constant) and p._measure is None]):
                    stack += first
                    continue
                if x._measure is None:
                    x._measure, x.parts = total([p._measure if isinstance(p, Constant) else measure(p[0]) for p in x.parts]), ()
                stack.pop()
            self._score = measured_score(self._measure)
        return self._score

    def spans_into(self, found: set[tuple[int, int]]) -> None:
        """Adds the spans. Those inside are told to the first set that asks for them, and then forgotten."""
        if self.left:
            found.update((self.left, self.right))
        stack = [self.inside]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                found.add(x)
            else:
                stack += x
                x.clear()


def _unescaped(raw: str) -> str:
    if "\\" not in raw:
        return raw
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), raw)


class Lexer:
    """The name-literal pairs of one text, with a table of the constants seen so far."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, Constant] = {}
        self._joins: dict[tuple[int, int], bool] = {}
        self._ends: dict[str, list[int]] | None = None

    def _end_of(self, tag: str, at: int) -> int:
        """Where the line of a here-document's tag begins, or -1. Lines of one word are listed once."""
        if self._ends is None:
            self._ends = {}
            for m in re.finditer(r"(?m)^[^\S\n]*+([A-Za-z_]\w*+)[)]?[^\S\n]*+$", self.text):
                self._ends.setdefault(m[1], []).append(m.start())
        lines = self._ends.get(tag, ())
        k = bisect_left(lines, at)
        return lines[k] if k < len(lines) else -1

    def _joined(self, end: int, start: int) -> bool:
        """Whether a piece from ``start`` is written right behind one that ends at ``end``."""
        if start < end or self.text[end : end + 1] not in ("'", '"'):
            return False
        if (end, start) not in self._joins:
            self._joins[end, start] = _JOINED.fullmatch(self.text, end, start) is not None
        return self._joins[end, start]

    def _trimmed(self, start: int, end: int) -> tuple[list[Piece], int]:
        body = self.text[start:end]
        left = start + len(body) - len(body.lstrip())
        value = body.strip()
        return ([(value, left, left + len(value))] if value else []), end

    def _string(self, m: re.Match) -> tuple[list[Piece | Constant], int] | None:
        if m["q3"]:
            end = self.text.find(m["q3"], m.end())
            return None if end < 0 else (self._trimmed(m.end(), end)[0], end + 3)
        rest = _REST[m["q"]].match(self.text, m.end())
        if not rest:
            return None
        raw = rest[0] if "r" in m[0].lower() else _unescaped(rest[0])
        used: list[Constant] = []
        if "{" in raw or "%(" in raw:  # constants named inside are pieces of their own

            def inside(u: re.Match) -> str:
                found = self.known.get(u[1] or u[2] or u[3])
                used.extend([found] if found else [])
                return u[0] if found is None else ""

            raw = _USED.sub(inside, raw)
        return ([(raw, m.end(), rest.end())] if rest[0] else []) + used, rest.end() + 1

    def _block(self, at: int, name_at: int) -> tuple[list[Piece], int]:
        """Lines that are indented more than the line of the name."""
        line = self.text.rfind("\n", 0, name_at) + 1
        indent = re.compile(r"[^\S\n]*+").match(self.text, line).end() - line
        inside = re.compile(rf"(?:[^\S\n]{{{indent + 1},}}+[^\n]*+(?:\n|$)|[^\S\n]*+\n)*+").match(self.text, at)
        return self._trimmed(at, inside.end())

    def _term(self, at: int, name_at: int) -> tuple[list[Piece | Constant], int] | None:
        text = self.text
        if m := _STRING.match(text, at):
            return self._string(m)
        if m := _HERE.match(text, at):
            end = self._end_of(m[1], m.end())
            return None if end < 0 else self._trimmed(m.end(), end)
        if m := _BLOCK.match(text, at):
            return self._block(m.end(), name_at)
        if m := _OPEN.match(text, at):
            got = None if _PAIR.match(text, m.end()) else _STRING.match(text, m.end())
            return self._string(got) if got else None
        if m := re.compile(r"\$\{[A-Za-z_][A-Za-z0-9_.]*+\}").match(text, at):
            return [self.known[k] for k in (m[0][2:-1],) if k in self.known], m.end()
        if m := _BARE.match(text, at):
            value = m[0].rstrip(".,;:")
            if value in _SCHEMES and (more := re.compile(r"\x20([A-Za-z0-9+/_.=~-]++)").match(text, at + len(value))):
                return [(more[1], more.start(1), more.end(1))], more.end()
            end = at + len(value)
            name = _IDENTIFIER.match(value)
            if name and name[1] in self.known:
                return [self.known[name[1]]], end
            return [(value, at, end)], end
        return None

    def expression(self, at: int, name_at: int) -> tuple[Constant, int]:
        """The literal of the expression from ``at``, and where it ends."""
        out: list[Piece | Constant] = []
        got = self._term(at, name_at)
        while got:
            out += got[0]
            at = got[1]
            join = _JOIN.match(self.text, at)
            # a string behind a bare word is not joined to it, and neither is a key in the next line
            if not join or not join[0].strip() and (self.text[at - 1 : at] not in ("'", '"') or _PAIR.match(self.text, join.end())):
                break
            got = self._term(join.end(), name_at)
        return out[0] if len(out) == 1 and isinstance(out[0], Constant) else Constant(out, self._joined), at

    def pairs(self):
        """``(name, constant)`` in the order of the text."""
        at, key, waiting = 0, None, []
        while m := _PAIR.search(self.text, at):
            if m["url"] is not None:
                end = self.text.index("@", m.end())
                yield "url_password", Constant([(self.text[m.end() : end], m.end(), end)], self._joined)
                at = end
                continue
            name = m["qname"] or m["name"] or m["late"] or m["flag"] or m["tag"]
            begin = _BLANK.match(self.text, m.end())
            start = begin.end() if begin else m.end()
            constant, end = self.expression(start, m.start())
            # ``a = b = literal``: what looked like a bare word is the next name
            chained = constant.one and constant.one[1] == start and re.compile(r"\s*+(?:=(?![=>])|:=)").match(self.text, end)
            if chained and _IDENTIFIER.match(self.text[start:end]):
                waiting.append(name)
                at = start
                continue
            for n in (*waiting, name):
                self.known[n] = constant
                yield n, constant
            waiting = []
            last = name.rsplit(".", 1)[-1].lower()
            if last in _VALUES and key:
                yield key, constant
                key = None
            elif last in _KEYS and constant.one:
                key = constant.one[0]
            # passwords and parameters in a URL are pairs as well
            url = self.text.find("://", start, end)
            at = max(url if url >= 0 else end, m.end())


def _spans(text: str, pieces: list[Piece]) -> list[list[int]]:
    """Where pieces are written; those that are written one after the other are one span."""
    spans: list[list[int]] = []
    for _, start, end in pieces:
        if spans and start >= spans[-1][1] and _JOINED.fullmatch(text, spans[-1][1], start):
            spans[-1][1] = end
        else:
            spans.append([start, end])
    return spans


def name_literals(text: str) -> list[tuple[str, str, int, int]]:
    """Name-literal pairs of a text: the name, the whole literal, and each place where it is written. All literals are
    written out, however long they are."""
    pairs = ((name, constant.pieces()) for name, constant in Lexer(text).pairs())
    return [(name, "".join(v for v, _, _ in pieces), start, end) for name, pieces in pairs for start, end in _spans(text, pieces)]


_JOINED = re.compile(r"""["']\s*+(?:[+.&]|\.\.|\|\|)?\s*+[rRbBfFuU]{0,2}["']""")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals of sensitive names that reach the threshold, each place once."""
    if not _HINT.search(text):
        return []
    found: set[tuple[int, int]] = set()
    for name, constant in Lexer(text).pairs():
        if constant.left and (sensitive := name_score(name)) and sensitive + constant.score() >= THRESHOLD:
            constant.spans_into(found)
    return [(a, b, "literal") for a, b in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, base, spans`` with ``spans`` as ``array<struct<start,end,kind>>``
    in order, ``base`` those of the fixed patterns.

    Null and empty texts have no spans; null or repeated ids are passed through; texts are scanned
    whole. Spans of different kinds may overlap, those of one kind do not repeat.
    """
    kind = "array<struct<start:int,end:int,kind:string>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            base, every = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                found = base_spans(text)
                order = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))]
                base.append(order(found))
                every.append(order(found + literal_spans(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow), pa.array(every, arrow)], ["id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, base {kind}, spans {kind}")


def joined_spans(col):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

