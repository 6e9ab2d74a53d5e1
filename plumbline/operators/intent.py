"""What a query string asks for, decided on the driver from its words.

An intent is told by the grammar of the question, not by a list of phrases: verbs that name a link between
symbols in a form that asks for the link, words that ask for meaning, for samples, or for a place. Inflected forms come from
their stems by rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import STOP_WORDS

#: Verbs that say how one symbol is linked to another.
LINK_VERBS = ("call", "invoke", "use", "reference", "depend", "import", "require", "implement", "extend", "inherit", "derive", "override", "instantiate")
#: Nouns that stand for the far end of a link, and whether that end is where the link begins.
LINK_NOUNS = {"caller": True, "user": True, "usage": True, "consumer": True, "dependent": True, "implementer": True, "subclass": True, "child": False, "callee": False, "dependency": False, "superclass": False, "ancestor": False, "parent": False}
#: Words that ask what something means, for a sample of it, or to be taken to it.
MEANING = frozenset("explain describe document documentation docs meaning means purpose overview summary summarise summarize why understand learn about".split())
SAMPLES = frozenset("example examples sample samples demo snippet snippets tutorial walkthrough recipe".split())
PLACE = frozenset("find show where locate open goto jump go view definition declaration declared defined lookup".split())
#: Words for code in general; with the endings of abstract nouns they make a query one about a concept.
GENERAL = frozenset("code logic algorithm module component routine feature class method function interface struct enum type helper service".split())
ABSTRACT = re.compile(r"(?:tion|sion|ment|ance|ence|ity|ness|ing|ism|age|ure|ery|ler|ger|ser|tor|der)s?$")

_SIMILAR = re.compile(r"\s*similar:\s*(\S*)\s*(.*)", re.I | re.S)
_WORD = re.compile(r"[^\W_][\w.]*")
_CAPITALS = re.compile(r"\b[A-Z]\w*")
_ASKING = frozenset("what who which where whatever anything everything anyone".split())


def _third(verb: str) -> str:
    return verb + ("es" if verb.endswith(("s", "sh", "ch", "x")) else "s")


def _past(verb: str) -> str:
    return verb + ("d" if verb.endswith("e") else "ed")


def _plural(noun: str) -> str:
    special = {"child": "children", "dependency": "dependencies"}
    return special.get(noun, noun + ("es" if noun.endswith("ss") else "s"))


_THIRD = {_third(v) for v in LINK_VERBS}
_PAST = {_past(v) for v in LINK_VERBS}
_BASE = set(LINK_VERBS)
_NOUN = {form: begins for n, begins in LINK_NOUNS.items() for form in (n, _plural(n))}


@dataclass(frozen=True)
class Parsed:
    query: str
    intent: str
    keywords: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    include_related: bool = False
    incoming: bool = False
    seed: str | None = None
    terms: list[str] = field(default_factory=list)


def _link(words: list[str]) -> str | None:
    """in or out, the direction of the link the words ask for; None if they ask for none."""
    for i, w in enumerate(words):
        before, after = words[:i], words[i + 1 : i + 3]
        asked = any(b in _ASKING for b in before)
        if w in _NOUN and ("of" in after or not before or before[-1] in PLACE or before[-1] in ("all", "the")):
            return "in" if _NOUN[w] else "out"
        if w in _PAST and "by" in after:
            # what is it called by: the link comes in; what is called by it: it goes out
            return "in" if after[-1:] == ["by"] or words[i + 1 :] == ["by"] else "out"
        if w in _THIRD:
            # "what calls it" has the question as its subject, "it calls what" has not; a noun is told by what follows
            if after[:1] in (["of"], ["to"]):
                return "in"
            if not before or all(b in STOP_WORDS or b in _ASKING or b in ("code", "files", "symbols") for b in before):
                return "in"
            return "out"
        if w in _BASE and ({"do", "does", "did"} & set(before)) and asked:
            return "out"
        if w in ("chain", "graph", "hierarchy", "tree") and before and before[-1] in _BASE | {"inheritance", "dependency", "class"}:
            return "out"
    return None


def detect(q: str) -> str:
    """Similar, Relations, Documentation, Examples, Search or Navigation; the first that fits."""
    if _SIMILAR.match(q):
        return "Similar"
    words = [w.lower() for w in _WORD.findall(q)]
    have = set(words)
    if _link(words):
        return "Relations"
    shown_how = "how" in have and have & {"use", "using", "show"}
    if have & SAMPLES or shown_how:
        return "Examples"
    if have & MEANING or words[:2] in (["what", "is"], ["what", "are"], ["what", "does"], ["how", "does"], ["how", "do"], ["tell", "me"]):
        return "Documentation"
    general = [w for w in words if w in GENERAL or (w not in STOP_WORDS and w not in PLACE and len(w) > 5 and ABSTRACT.search(w))]
    if have & GENERAL and have & {"that", "which", "for"}:
        return "Search"
    if have & PLACE:
        names = [m for m in _CAPITALS.findall(q) if m.lower() not in PLACE and m.lower() not in STOP_WORDS]
        return "Search" if len(general) >= 2 and not names else "Navigation"
    return "Search"


def _distinct(items) -> list[str]:
    return list(dict.fromkeys(items))


def parse(q: str) -> Parsed:
    """The intent with the query's keywords, symbol names, paths, direction, and for similar: seed and terms."""
    kind = detect(q)
    words = _distinct(w.lower() for w in re.split(r"\W+", q) if len(w) > 2 and w.lower() not in STOP_WORDS)
    names = _distinct(m for m in re.findall(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:_[a-z]+)+)\b", q) if len(m) > 2)
    seed, terms = None, []
    if kind == "Similar":
        m = _SIMILAR.match(q)
        seed, terms = m[1], m[2].split()
    lower = q.lower()
    incoming = _link([w.lower() for w in _WORD.findall(q)]) == "in"
    return Parsed(q, kind, words, names, _distinct(re.findall(r"\b[\w/\\]+\.\w+\b", q)), kind == "Relations" or "related" in lower or "context" in lower, incoming, seed, terms)


def route(p: Parsed, profile: str) -> list[str]:
    """The searches to try, in order, until one has results; rerank last where results are re-ranked."""
    full = "fast" if profile == "Fast" else "full_text"
    steps = {"Similar": ["similar"], "Navigation": ["navigation", full], "Relations": ["relations", full]}.get(p.intent, [full])
    related = p.intent == "Relations" or (profile == "Fast" and p.include_related and steps == ["fast"])
    return [*steps, *(["rerank"] if related else [])]
