"""Symbols and edges of source files, by each language's grammar.

C# is walked scope by scope, strings and comments blanked first: namespaces, types, constructors, methods,
properties and fields, with parents, qualified names, documentation and literal tokens, and edges for base types,
types of members, returned types and calls. The other languages are read declaration by declaration over the
whole text, so arguments may span lines; their symbols are lines, without edges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd

from ..functions.text import CSHARP_KEYWORDS, SPECIAL_TYPES
from .search import tokens_of

NAME = r"[A-Za-z_$][\w$]*"


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    parent: Symbol | None = None
    qualified: str | None = None
    signature: str | None = None
    documentation: str | None = None
    modifiers: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    edges: list[tuple[str, str, int]] = field(default_factory=list)  # kind, target, offset


def closing(text: str, at: int) -> int:
    """Where the bracket opened at `at` is closed, or the text's end."""
    pair = {"(": ")", "[": "]", "{": "}", "<": ">"}
    opened, depth = text[at], 0
    for i in range(at, len(text)):
        if text[i] == opened:
            depth += 1
        elif text[i] == pair[opened]:
            depth -= 1
            if not depth:
                return i
    return len(text)


def apart(text: str, by: str = ",") -> list[str]:
    """Parts between separators that stand in no bracket."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == by and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


# -- languages read by declaration -------------------------------------------------------------------------------

_FLAGS = re.M
#: Per language: declarations with the groups word (what is declared, if the text says so) and name.
DECLARATIONS: dict[str, list[tuple[str | dict[str, str], re.Pattern[str]]]] = {
    "Python": [({"class": "Class", "def": "Function"}, re.compile(rf"^(?P<indent>[ \t]*)(?:async[ \t]+)?(?P<word>class|def)[ \t]+(?P<name>{NAME})", _FLAGS))],
    "JavaScript": [
        ({"class": "Class", "function": "Function"}, re.compile(rf"(?<![\w$.])(?P<word>class|function)\b[ \t]*\*?[ \t]*(?P<name>{NAME})", _FLAGS)),
        ("Function", re.compile(rf"(?<![\w$.])(?:const|let|var)[ \t]+(?P<name>{NAME})\s*(?::[^=;\n]+)?=\s*(?:async\b\s*)?(?:function\b|(?:\([^()]*\)|{NAME})\s*(?::\s*[^=;\n]+)?=>)", _FLAGS)),
    ],
    "Java": [
        ({"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Class"}, re.compile(rf"^[ \t]*(?:@{NAME}(?:\([^)\n]*\))?\s+)*(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*(?P<word>class|interface|enum|record)\s+(?P<name>{NAME})", _FLAGS)),
        ("Method", re.compile(rf"^[ \t]*(?:@{NAME}(?:\([^)\n]*\))?\s+)*(?:(?:public|protected|private|abstract|final|static|synchronized|native|default|strictfp)\s+)*(?:<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>\s*)?(?P<type>[A-Za-z_][\w.]*(?:<[^();{{}}]*>)?(?:\[\])*)\s+(?P<name>{NAME})(?=\s*\()", _FLAGS)),
    ],
    "Go": [
        ({"struct": "Struct", "interface": "Interface"}, re.compile(rf"^[ \t]*(?:type[ \t]+)?(?P<name>{NAME})(?:\[[^\]\n]*\])?[ \t]+(?P<word>struct|interface)\b", _FLAGS)),
        ("Function", re.compile(rf"^func\b[ \t]*(?:\([^()\n]*\)[ \t]*)?(?P<name>{NAME})", _FLAGS)),
    ],
    "Rust": [({"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Interface"}, re.compile(rf'^[ \t]*(?:pub\b(?:\([^)\n]*\))?[ \t]*)?(?:(?:const|async|unsafe|default|extern(?:[ \t]+"[^"\n]*")?)[ \t]+)*(?P<word>fn|struct|enum|trait)[ \t]+(?P<name>{NAME})', _FLAGS))],
}
for _other in ("TypeScript", "JavaScriptReact", "TypeScriptReact"):
    DECLARATIONS[_other] = DECLARATIONS["JavaScript"]
LANGUAGES = (*DECLARATIONS, "CSharp")
#: Words that stand where a type or name could, but begin a statement.
_STATEMENT = frozenset("return new else throw if for while switch catch do try case await yield assert package import using lock foreach in is instanceof".split())
_AFTER_NAME = re.compile(r"\s*(?:<[^();{}]*>|\[[^\]\n]*\])?\s*\(")


def declared(language: str, text: str) -> list[Symbol]:
    """The declarations of a text in one of the languages read so."""
    out = []
    plain = blanked(text, language)[0]
    for kinds, pattern in DECLARATIONS[language]:
        for m in pattern.finditer(plain):
            g = m.groupdict()
            if g["name"] in _STATEMENT or g.get("type") in _STATEMENT:
                continue
            kind = kinds if isinstance(kinds, str) else kinds[g["word"]]
            if language == "Python" and kind == "Function" and g["indent"]:
                kind = "Method"
            signature = None
            if kind in ("Function", "Method"):
                opened = _AFTER_NAME.match(plain, m.end("name"))
                if opened:
                    end = closing(plain, opened.end() - 1)
                    signature = g["name"] + " ".join(text[opened.end() - 1 : end + 1].split())
                elif language not in ("JavaScript", "TypeScript", "JavaScriptReact", "TypeScriptReact"):
                    continue
            out.append(Symbol(kind, g["name"], m.start("name"), m.start("name"), signature=signature))
    return sorted(out, key=lambda s: s.start)


_HIDDEN = {
    "Python": re.compile(r'#[^\n]*|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''),
    "CSharp": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|\$*"""[\s\S]*?"""|(?:@\$?|\$@)"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\''),
    "": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)\'|`[^`]*`'),
}
_INK = re.compile(r"[^\n]")


def blanked(text: str, language: str) -> tuple[str, list[tuple[int, str]]]:
    """The text with strings and comments blanked, line by line as long as before, and the strings with their places."""
    strings: list[tuple[int, str]] = []

    def blank(m: re.Match[str]) -> str:
        if m[0][:1] not in "/#":
            strings.append((m.start(), m[0]))
        return _INK.sub(" ", m[0])

    return _HIDDEN.get(language, _HIDDEN[""]).sub(blank, text), strings


# -- C# ----------------------------------------------------------------------------------------------------------

_MODIFIERS = frozenset("public private protected internal static sealed abstract partial readonly virtual override async extern unsafe new const volatile ref required file event".split())
_TYPE = re.compile(rf"(?P<word>class|interface|struct|enum)\s+(?P<name>{NAME})\s*(?P<generic><[^{{]*?>)?\s*(?:\([^)]*\))?\s*(?::\s*(?P<bases>.*?))?(?:\s+where\b.*)?$", re.S)
_TYPE_KIND = {"class": "Class", "interface": "Interface", "struct": "Struct", "enum": "Enum"}
_NAMESPACE = re.compile(r"(?:^|\s)namespace\s+([\w.]+)\s*$")
_MEMBER = re.compile(rf"^(?P<type>.*?)(?P<name>{NAME})\s*(?P<generic><[^()]*>)?\s*$", re.S)
_CALL = re.compile(rf"(?<![\w.])(?P<target>{NAME}(?:\s*\??\.\s*{NAME})*)\s*(?:<[^<>();{{}}]*>)?\s*\(")
_NO_CALL = frozenset(CSHARP_KEYWORDS)
_DOC_TAG = re.compile(r"</?\w[^>]*>")
_PARAMETER_WORDS = ("this", "ref", "out", "in", "params", "scoped", "readonly")
_SPECIAL = re.compile(rf"(?<![.\w])(?:System\.)?({'|'.join(SPECIAL_TYPES)})\b")
_PRIMITIVE = frozenset(SPECIAL_TYPES) | frozenset(SPECIAL_TYPES.values())


def canonical(type_: str) -> str:
    """A type as written, special names in full, without blanks that mean nothing."""
    return _SPECIAL.sub(lambda m: SPECIAL_TYPES[m[1]], re.sub(r"\s*([<>,\[\]?.])\s*", r"\1", " ".join(type_.split())))


def _without_attributes(header: str) -> str:
    header = header.strip()
    while header.startswith("["):
        header = header[closing(header, 0) + 1 :].strip()
    return header


def _modifiers(header: str) -> tuple[list[str], str]:
    out = []
    while (m := re.match(r"([a-z]+)\s+", header)) and m[1] in _MODIFIERS:
        out.append(m[1])
        header = header[m.end() :]
    return out, header


def _parameters(text: str) -> list[str]:
    """Types of the parameters."""
    out = []
    for p in apart(text):
        p = apart(_without_attributes(p), "=")[0] if p else p
        words = p.split()
        while words and words[0] in _PARAMETER_WORDS:
            words = words[1:]
        if words:
            out.append(" ".join(words[:-1] if len(words) > 1 else words))
    return out


def _type_edge(symbol: Symbol, kind: str, type_: str, at: int) -> None:
    bare = canonical(type_).rstrip("?")
    if bare and bare.removesuffix("[]") not in _PRIMITIVE and bare != "var":
        symbol.edges.append((kind, bare, at))


class _Walk:
    """One pass over the blanked text; `open` holds a symbol, or None, for every brace that is open."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.plain, self.strings = blanked(text, "CSharp")
        self.symbols: list[Symbol] = []
        self.open: list[Symbol | None] = []
        self.outer: Symbol | None = None  # a namespace that holds the rest of the file

    def _parent(self) -> Symbol | None:
        return next((s for s in reversed(self.open) if s is not None), self.outer)

    def _add(self, kind: str, name: str, at: int, inside: str, header: str, modifiers: list[str]) -> Symbol:
        parent = self._parent()
        s = Symbol(kind, name, at, at, parent, f"{parent.qualified}.{inside}" if parent and parent.qualified else inside, " ".join(header.split()) or None, self._documentation(at), modifiers)
        self.symbols.append(s)
        return s

    def _documentation(self, at: int) -> str | None:
        """The /// lines above a declaration, attributes between them passed over."""
        lines = self.text[: self.text.rfind("\n", 0, at) + 1].split("\n")[:-1]
        while lines and lines[-1].strip().startswith("["):
            lines.pop()
        out = []
        while lines and lines[-1].strip().startswith("///"):
            out.append(_DOC_TAG.sub("", lines.pop().strip()[3:]).strip())
        return "\n".join(x for x in reversed(out) if x) or None

    def run(self) -> list[Symbol]:
        begin, i, n, round_ = 0, 0, len(self.plain), 0
        while i < n:
            c = self.plain[i]
            if c in "([":
                round_ += 1
            elif c in ")]":
                round_ -= 1
            elif round_ <= 0 and c in "{};":
                header, first = self.plain[begin:i], begin + len(self.plain[begin:i]) - len(self.plain[begin:i].lstrip())
                round_ = 0
                if c == "}":
                    if self.open and (s := self.open.pop()) is not None:
                        s.end = i
                else:
                    s = self._declare(header, first, c, i)
                    if c == "{":
                        if s is not None and s.kind in ("Field", "Property") and re.search(r"=(?!>)", header):
                            s = None  # an initialiser's brace
                        self.open.append(s)
                begin = i + 1
            i += 1
        for s in self.open:
            if s is not None:
                s.end = n
        if self.outer is not None:
            self.outer.end = n
        for at, raw in self.strings:
            holders = [s for s in self.symbols if s.kind != "Namespace" and s.start <= at <= s.end]
            if holders:
                inner = min(holders, key=lambda s: s.end - s.start)
                inner.literals.extend(t for t in tokens_of(raw) if t not in inner.literals)
        self._name_targets()
        return self.symbols

    def _name_targets(self) -> None:
        """Targets that this file declares under one qualified name get it: types by name, calls among the members of the own type."""
        types: dict[str, set[str]] = {}
        members: dict[tuple[int, str], set[str]] = {}
        for s in self.symbols:
            if s.kind in ("Class", "Interface", "Struct", "Enum"):
                types.setdefault(s.name, set()).add(s.qualified or s.name)
            elif s.kind == "Method":
                members.setdefault((id(s.parent), s.name), set()).add(s.qualified or s.name)
        for s in self.symbols:
            for k, (kind, target, at) in enumerate(s.edges):
                known = members.get((id(s.parent), target), set()) if kind == "Calls" else types.get(target, set())
                if len(known) == 1:
                    s.edges[k] = (kind, next(iter(known)), at)

    def _declare(self, header: str, first: int, mark: str, at: int) -> Symbol | None:
        bare = _without_attributes(header)
        first += len(header.lstrip()) - len(bare) if header.lstrip().startswith("[") else 0
        if m := _NAMESPACE.search(bare):
            s = self._add("Namespace", m[1], first, m[1], bare, [])
            if mark == ";":
                self.outer = s
            return s
        modifiers, rest = _modifiers(bare)
        top = self.open[-1] if self.open else self.outer
        if (self.open and top is None) or (top is not None and top.kind not in ("Namespace", "Class", "Interface", "Struct")):
            return None
        if (m := _TYPE.match(rest)) and mark == "{":
            s = self._add(_TYPE_KIND[m["word"]], m["name"], first, m["name"] + re.sub(r"\s", "", m["generic"] or ""), bare, modifiers)
            for k, base in enumerate(apart(m["bases"] or "")):
                last = base.rsplit(".", 1)[-1]
                inherits = m["word"] == "class" and k == 0 and not re.match(r"I[A-Z]", last)
                s.edges.append(("Inherits" if inherits else "Implements", canonical(base), first))
            return s
        if top is None or top.kind == "Namespace" or not rest or rest.startswith(("record ", "delegate ")) or "event" in modifiers:
            return None
        return self._member(top, modifiers, rest, bare, first, mark, at)

    def _member(self, top: Symbol, modifiers: list[str], rest: str, bare: str, first: int, mark: str, at: int) -> Symbol | None:
        arrow = rest.find("=>")
        assigned = re.search(r"(?<![=!<>])=(?![=>])", rest)
        head = rest[: min(arrow if arrow >= 0 else len(rest), assigned.start() if assigned else len(rest))]
        opened = head.find("(")
        if opened >= 0:  # defaults of parameters are within the brackets
            end = closing(rest, opened) + 1
            head, assigned = rest[:end], re.search(r"(?<![=!<>])=(?![=>])", rest[end:])
        if opened >= 0 and (m := _MEMBER.match(head[:opened])):
            types = _parameters(head[opened + 1 : closing(head, opened)])
            constructor = m["name"] == top.name and not m["type"].strip()
            if not constructor and (not m["type"].strip() or m["type"].split()[0] in _STATEMENT):
                return None
            generic = re.sub(r"\s", "", m["generic"] or "")
            s = self._add("Constructor" if constructor else "Method", m["name"], first, f"{m['name']}{generic}({','.join(map(canonical, types))})", bare[: len(bare) - len(rest)] + head, modifiers)
            if not constructor:
                _type_edge(s, "Returns", m["type"], first)
            for t in types:
                _type_edge(s, "TypeOf", t, first)
            s.end = at
            if mark == "{":  # a block body; expressions have no calls of their own
                body = self.plain[at : closing(self.plain, at)]
                for c in _CALL.finditer(body):
                    target = re.sub(r"\s|\?", "", c["target"])
                    if target.split(".")[0] not in _NO_CALL - {"this", "base"} and not re.search(r"\bnew\s+$", body[: c.start()][-20:]):
                        s.edges.append(("Calls", target.removeprefix("this.").removeprefix("base."), at + c.start()))
            return s
        if opened < 0 and (mark == "{" or arrow >= 0) and not assigned and (m := _MEMBER.match(head)) and m["type"].strip():
            s = self._add("Property", m["name"], first, m["name"], bare[: len(bare) - len(rest)] + head, modifiers)
            _type_edge(s, "TypeOf", m["type"], first)
            s.end = at
            return s
        if opened < 0 and (mark == ";" or assigned) and (m := _MEMBER.match(apart(head)[0] if apart(head) else "")) and m["type"].strip() and m["type"].split()[0] not in _STATEMENT:
            names = [m["name"], *(n for p in apart(rest)[1:] if (n := p.split("=")[0].strip()).isidentifier())]
            for name in names:
                s = self._add("Field", name, first, name, bare[: len(bare) - len(rest)] + head, modifiers)
                _type_edge(s, "TypeOf", m["type"], first)
                s.end = at
            return s
        return None


# -- files to rows -----------------------------------------------------------------------------------------------

SCHEMA = (
    "id string, repo_id string, branch_name string, commit_sha string, file_path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, start_column int, end_column int, "
    "parent_symbol_id string, signature string, documentation string, modifiers array<string>, literal_tokens array<string>, edges array<struct<kind:string,target:string,line:int>>"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split("edges array")[0].rstrip(", ").split(", ")] + ["edges"]


def extract(language: str, text: str) -> list[Symbol]:
    return _Walk(text).run() if language == "CSharp" else declared(language, text) if language in DECLARATIONS else []


def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """files (scope, language, content) to symbols with their edges."""
    import bisect

    for b in batches:
        out = []
        for f in b.itertuples(index=False):
            starts = [0, *(m.end() for m in re.finditer("\n", f.content))]
            line = lambda at: bisect.bisect_right(starts, at)  # noqa: E731, B023
            scope = (f.repo_id, f.branch_name, f.commit_sha, f.file_path)
            ids: dict[int, str] = {}
            for k, s in enumerate(extract(f.language, f.content)):
                ids[id(s)] = hashlib.sha1("|".join(map(str, (*scope, s.kind, s.qualified or s.name, s.start, k))).encode()).hexdigest()
                first, last = line(s.start), line(max(s.start, s.end))
                width = (starts[last] if last < len(starts) else len(f.content) + 1) - starts[last - 1] - 1
                column = s.start - starts[first - 1] + 1 if f.language == "CSharp" else 1
                edges = [{"kind": kind, "target": target, "line": line(at)} for kind, target, at in s.edges]
                out.append((ids[id(s)], *scope, f.language, s.kind, s.name, s.qualified, first, last, column, width, ids.get(id(s.parent)) if s.parent else None, s.signature, s.documentation, s.modifiers, s.literals, edges))
        yield pd.DataFrame(out, columns=_COLUMNS)
