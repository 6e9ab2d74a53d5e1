"""Functions and methods paired with their documentation.

One recursive pattern of the regex library takes the comment block, the attributes, the signature and the
balanced body together; strings and comments inside the body are passed over, so braces in them do not
count. A documentation column that says something is preferred to the comment found in the content.

Defined results: rows whose kind is neither Method nor Function are left out, unless it is Unknown and the
signature is a function's; null or blank ids and contents give nothing; a text is no description if it is
blank, a placeholder, only tags, only the words of the function's own name, disabled code, a divider or a
licence notice; a comment counts only directly above the function (attributes may stand between) or as the
docstring in it; repeated rows of an id give one pair; whole contents are searched, whatever their length;
an empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("method", "function")

# Strings, the special ones first: verbatim ("" is a quote), raw between three quotes, raw after r and r#, plain, one character, templates with code inside.
_DEFINE = r"(?(DEFINE)(?P<template>`(?:[^`\\$]++|\\.|\$(?!\{)|\$(?&inner))*+`)(?P<inner>\{(?:[^`{}]++|(?&template)|(?&inner))*+\}))"
_STRING = (
    r'(?<=@|@\$)"(?:[^"]|"")*+"|"""(?s:.*?)"""|(?<=\bb?r)"[^"]*+"|(?<=\bb?r\#)"(?s:.*?)"\#|(?<=\bb?r\#\#)"(?s:.*?)"\#\#'
    r'|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)\'|(?&template)'
)
_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
_ABOVE = r"(?P<doc>(?:^[ \t]*+(?://[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/[ \t]*+\r?)\n)++)?(?P<attributes>(?:^[ \t]*+(?:\[[^\n]*\]|@\w[^\n]*|\#\[[^\n]*\])[ \t]*+\r?\n)*+)"
_BODY = rf"(?P<body>\{{(?:{_STRING}|{_COMMENT}|[^{{}}\"'`/]++|[\"'`/]|(?&body))*+\}})"
_ARGUMENTS = rf"(?P<arguments>\((?:[^()\"'`]++|{_STRING}|[\"'`]|(?&arguments))*+\))"
#: Matched from the first comment or attribute above a known declaration; a body cut off at the chunk's end leaves its group unset.
_BRACES = regex.compile(_DEFINE + _ABOVE + rf"(?P<signature>^[^\n(]*+(?:\([^()\n]*\)[^\n(]*+)??{_ARGUMENTS}[^;{{}}\n]*+)(?:\s*+{_BODY})?", regex.M)
_PYTHON = regex.compile(
    _DEFINE + rf"(?P<doc>(?:^[ \t]*+\#[^\n]*+\n)++)?(?P<attributes>(?:^[ \t]*+@\w[^\n]*+\n)*+)(?P<signature>^(?P<indent>[ \t]*+)(?:async[ \t]+)?def[ \t]+\w+[ \t]*+{_ARGUMENTS}[^\n:]*+:[^\n]*+)"
    r"(?:\n\s*+[rRuU]?(?P<quote>\"\"\"|''')(?P<docstring>(?s:.*?))(?P=quote))?(?P<body>(?:\n(?:[ \t]*+$|(?P=indent)[ \t]+[^\n]*+))*+)",
    regex.M,
)
_LAST_NAME = regex.compile(r"([\w$]+)\W*$")
_CALLED = regex.compile(r"([\w$]+)\s*(?:<[^>()]*>)?\s*\(")
_OPENED = regex.compile(r"[ \t]*(?:<[^()\n]*>)?\(")
_FUNCTION = regex.compile(r"^\s*(?:func\s*\([^)]*\)\s*)?(?!.*\b(?:class|interface|struct|enum|record)\b)(?:[\w<>\[\],.?:&*\s]+\s)?[\w$]+\s*(?:<[^>()]*>)?\s*\(")
_WORD = regex.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SPLIT = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\dA-Za-z_]+")
_TAG = regex.compile(r"</?[A-Za-z][^<>]*>|^\s*[@\\]\w+\b.*$|^\s*:(?:param|returns?|rtype|raises|type)\b.*$", regex.M)
_MARKS = regex.compile(r"^[ \t]*(?://[/!]?|/\*+!?|\*+/|\*(?!/)|#+!?|--)[ \t]?|[ \t]*\*+/[ \t\r]*$", regex.M)
_PLACEHOLDER = regex.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|n/?a|none|null|placeholder|stub)\b\W*(?:(?:add|write|document|fill|docs?|documentation|description|comments?|later|here|in|this|me|the|missing|needed)\b\W*)*"
    r"|(?:add|write|insert|put)?\W*(?:a |the )?(?:description|documentation|docs?|comment|summary)\W*(?:goes |to be |comes )?(?:here|added|missing|needed|later)?\W*|no (?:description|documentation|docs?|comment)\W*(?:available|provided|yet)?\W*|(?:see above|see below|inheritdoc|description here)\W*)$",
    regex.I,
)
_LICENCE = regex.compile(r"\bcopyright\b|\(c\)\s*\d{4}|©|spdx-license|\blicen[cs]ed?\b|all rights reserved|governed by the", regex.I)
_DIVIDER = regex.compile(r"^\W*$|^\W{3,}.*\W{3,}$")
_SECTION = regex.compile(r"^\W*(?:section|part|region|endregion|helpers?|private|public|internals?|utils?|misc)?\W*\d*\W*$", regex.I)
_CALL = r"[\w.$?!]*\w(?:::\w+)*[?!]?\("
#: Lines that only code has: closing brackets, an opened block, a call or an assignment that fills the line.
_CODE_LINE = regex.compile(
    rf"^[\]}})]+[;,)]*$|\{{$|^(?:(?:await|return|throw|raise|go|defer|yield|new)\s+)*{_CALL}.*\)[;:?]*$|^(?:(?:var|let|const|auto|final|int|string|bool)\s+)?(?:mut\s+)?[\w.\[\]$\"']+(?:,\s*\w+)*(?:\s*:\s*[\w<>\[\]]+)?\s*(?::=|(?:\?\?|[-+*/|&?])?=(?![=>]))\s*\S"
)
#: Lines that begin like code and are code if they also have a sign that prose hasn't.
_CODE_WORD = regex.compile(r"^(?:if|elif|else|while|for|foreach|switch|case|catch|except|try|finally|with|return|throw|raise|import|using|from|package|use|var|let|const|public|private|protected|internal|static|func|fn|def|async)\b")
_CODE_SIGN = regex.compile(rf"[;:{{}}]$|==|!=|:=|=>|->|&&|\|\||{_CALL}|\w\.\w+\W*$|\w_\w|[a-z][A-Z]\w*\W*$")
_PLAIN_STATEMENT = regex.compile(r"^[^\s]+(?:\s+[\w.<>\[\]]+)?\s*[^\w\s]*[^\n]*[()=\[\]][^\n]*;$|^[\w.]+;$|^(?:break|continue|pass)$")
#: Six plain words on end are prose, however the line ends.
_PROSE = regex.compile(r"(?:\b[^\W\d_]+[,']?\s+){5}[^\W\d_]+")


def _is_code(line: str) -> bool:
    if _CODE_LINE.search(line):
        return True
    if _PROSE.search(line):
        return False
    return bool(_PLAIN_STATEMENT.match(line) or (_CODE_WORD.match(line) and _CODE_SIGN.search(line)))


#: Words that add nothing to a function's name.
_FILLERS = frozenset("a an the this that method function func of for to it does is new given its".split())


def _same_word(word: str, name: str) -> bool:
    """Whether word is name, give or take an ending."""
    if word == name or (word.startswith(name) and word[len(name) :] in ("s", "es", "ed", "d", "ing")):
        return True
    stem = name[:-1] if len(name) > 3 and name[-1] in "ey" else name
    return len(stem) >= 2 and word.startswith(stem) and word[len(stem) :] in ("s", "es", "ed", "d", "ing", "e", "y", "ies", "ied", "er", "or", stem[-1] + "ed", stem[-1] + "ing")


def describes(text: str | None, name: str) -> str | None:
    """What text says about the function called name, or None if that is nothing."""
    if not text or not text.strip():
        return None
    bare = _TAG.sub("", _MARKS.sub("", text.replace("\r", "")))
    lines = [x for x in (y.strip() for y in bare.split("\n")) if x]
    ruled = sum(bool(regex.match(r"^[=\-*#~_+/ ]{3,}$", x)) for x in lines)
    lines = [x for x in lines if not _DIVIDER.match(x) and not (ruled and _SECTION.match(x))]
    if any(_LICENCE.search(x) for x in lines):
        lines = []  # a notice is one block
    code = [_is_code(x) for x in lines]
    if code and 2 * sum(code) >= len(code):
        return None
    lines = [x for x, c in zip(lines, code) if not c]
    said = " ".join(lines).strip()
    if not said or _PLACEHOLDER.match(said) or all(_PLACEHOLDER.match(x) for x in lines):
        return None
    words = [w.lower() for x in _WORD.findall(said) for w in _SPLIT.findall(x)]
    if not words:
        return None
    own = [w.lower() for w in _SPLIT.findall(name)]
    if all(w in _FILLERS or any(_same_word(w, n) for n in own) for w in words):
        return None
    return said


def function_name(signature: str | None, symbol_name: str | None) -> str | None:
    """The bare name, from the signature if there is one, else the last part of the symbol's."""
    if signature:
        body = regex.sub(r"^\s*func\s*\([^)]*\)", "func", signature)
        if m := _CALLED.search(body):
            return m[1]
    m = _LAST_NAME.search((symbol_name or "").split("(")[0])
    return m[1] if m else None


def _declared(text: str, signature: str | None, name: str) -> int:
    """Start of the line on which the function is declared, or -1."""
    if signature and (at := text.find(signature.strip())) >= 0:
        return text.rfind("\n", 0, at) + 1
    at = text.find(name)
    while at >= 0:
        end = at + len(name)
        if _OPENED.match(text, end) and not (at and (text[at - 1] in ".:>_$" or text[at - 1].isalnum())):
            start = text.rfind("\n", 0, at) + 1
            line = text[start : (text.find("\n", at) + 1 or len(text) + 1) - 1].strip()
            if not line.endswith((";", ",")) and "=" not in text[start:at] and not regex.match(r"(?:return|await|if|for|while|//|\*|#|/\*)", line):
                return start
        at = text.find(name, end)
    return -1


def _first_above(text: str, at: int, python: bool) -> int:
    """Start of the comment and attribute lines that stand, without a gap, above the line at."""
    comments = False
    while at:
        before = text.rfind("\n", 0, at - 1) + 1
        line = text[before : at - 1].strip()
        if python:
            if line.startswith("#"):
                comments = True
            elif not (line.startswith("@") and not comments):
                break
        elif line.startswith("//"):
            comments = True
        elif line.endswith("*/") and (opened := text.rfind("/*", 0, at)) >= 0:
            before = text.rfind("\n", 0, opened) + 1
            if text[before:opened].strip():
                break
            comments = True
        elif comments or not (line.startswith(("[", "@", "#["))):
            break
        at = before
    return at


def capture(content: str | None, signature: str | None, symbol_name: str | None, python: bool) -> tuple[str, str] | None:
    """The function's text (attributes, signature, body) and the comment that belongs to it, '' without one."""
    name = function_name(signature, symbol_name)
    if not content or not name:
        return None
    text = content.replace("\r\n", "\n")
    at = _declared(text, signature, name)
    if at < 0:
        return None
    m = (_PYTHON if python else _BRACES).match(text, _first_above(text, at, python))
    if not m:
        return None
    doc = m.groupdict().get("docstring") or ""
    if not doc.strip():
        doc = m["doc"] or ""
    return text[m.start("attributes") : m.end()], doc


def is_function(kind: str | None, signature: str | None) -> bool:
    kind = (kind or "unknown").strip().lower()
    return kind in KINDS or (kind in ("unknown", "") and bool(signature) and bool(_FUNCTION.match(signature)))


def is_python(language: str | None, signature: str | None) -> bool:
    return (language or "").lower() == "python" or bool(signature and regex.match(r"\s*(?:async\s+)?def\s", signature))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if not is_function(r.kind, r.signature):
                continue
            name = function_name(r.signature, r.symbol_name) or ""
            found = capture(r.content, r.signature, r.symbol_name, is_python(r.language, r.signature))
            said, source = describes(r.documentation, name), "column"
            if said is None and found:
                said, source = describes(found[1], name), "content"
            if said is not None:
                out.append((r.chunk_id, r.signature, found[0] if found else r.content, said, source))
        yield pd.DataFrame(out, columns=["chunk_id", "signature", "code", "description", "source"])


def pairs(chunks: DataFrame) -> DataFrame:
    """chunk_id, signature, code, description, source (column or content), one row per id."""
    kind = F.lower(F.trim(F.coalesce("symbol_kind", F.lit("unknown"))))
    rows = chunks.where(F.col("id").isNotNull() & (F.trim("id") != "") & kind.isin(*KINDS, "unknown", ""))
    rows = rows.select(F.col("id").alias("chunk_id"), F.col("symbol_kind").alias("kind"), "language", "symbol_name", "signature", "content", "documentation")
    said = rows.mapInPandas(_pairs, "chunk_id string, signature string, code string, description string, source string")
    return said.groupBy("chunk_id").agg(F.min(F.struct("description", "signature", "code", "source")).alias("p")).select("chunk_id", "p.signature", "p.code", "p.description", "p.source")


def described(chunks: DataFrame) -> DataFrame:
    """chunk_id of each pair."""
    return pairs(chunks).select("chunk_id")
