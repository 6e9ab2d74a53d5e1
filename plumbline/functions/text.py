"""Text functions as JVM expressions: tokens, trigrams, snippets, names, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no identifiers of interest.
CSHARP_KEYWORDS = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else "
    "enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock "
    "long namespace new null object operator out override params private protected public readonly ref return sbyte sealed "
    "short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort "
    "using virtual void volatile while "
    "add alias and ascending async await by descending dynamic equals file from get global group init into join let "
    "managed nameof not notnull on or orderby partial record remove required select set unmanaged value var when where with yield"
).split()
# Words that are no keywords of a query.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would should could may might can find show where what how why when who"
).split()
# Special type names and what they stand for.
SPECIAL_TYPES = {
    "bool": "System.Boolean",
    "byte": "System.Byte",
    "sbyte": "System.SByte",
    "short": "System.Int16",
    "ushort": "System.UInt16",
    "int": "System.Int32",
    "uint": "System.UInt32",
    "long": "System.Int64",
    "ulong": "System.UInt64",
    "float": "System.Single",
    "double": "System.Double",
    "decimal": "System.Decimal",
    "char": "System.Char",
    "string": "System.String",
    "object": "System.Object",
    "nint": "System.IntPtr",
    "nuint": "System.UIntPtr",
    "void": "System.Void",
}
# Languages by file extension.
EXTENSIONS = {
    "CSharp": "cs csx cake",
    "JavaScript": "js mjs cjs",
    "JavaScriptReact": "jsx",
    "TypeScript": "ts mts cts",
    "TypeScriptReact": "tsx",
    "Python": "py pyw pyi",
    "Java": "java",
    "C": "c h",
    "CPlusPlus": "cpp cc cxx hpp hh hxx",
    "Go": "go",
    "Rust": "rs",
    "Ruby": "rb rake",
    "PHP": "php phtml",
    "Shell": "sh bash zsh",
    "Kotlin": "kt kts",
    "Swift": "swift",
    "Scala": "scala sc",
    "R": "r",
    "Lua": "lua",
    "Perl": "pl pm",
    "Haskell": "hs",
    "Elixir": "ex exs",
    "Clojure": "clj cljs cljc",
    "FSharp": "fs fsx fsi",
    "Dart": "dart",
    "SQL": "sql",
    "HTML": "html htm",
    "CSS": "css",
    "SCSS": "scss",
    "LESS": "less",
    "XML": "xml",
    "JSON": "json",
    "YAML": "yaml yml",
    "TOML": "toml",
    "Markdown": "md markdown",
}
# Languages by interpreter, in the order they are looked for.
INTERPRETERS = {"python": "Python", "python2": "Python", "python3": "Python", "node": "JavaScript", "nodejs": "JavaScript", "ruby": "Ruby", "perl": "Perl", "php": "PHP", "bash": "Shell", "sh": "Shell", "zsh": "Shell", "fish": "Shell", "lua": "Lua"}
# Files known by name, languages that are not indexed, kinds that are chunked.
FILE_NAMES = {"rakefile": "Ruby", "gemfile": "Ruby", "vagrantfile": "Ruby"}
NOT_INDEXED = ("Unknown", "Markdown", "JSON", "YAML", "TOML", "XML", "HTML", "CSS", "SCSS", "LESS")
CHUNKED_KINDS = ("Class", "Interface", "Struct", "Enum", "Method", "Function", "Constructor", "Property")

TOKEN = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_tokens(c: Column | str) -> Column:
    """Lower-case parts of the identifiers in a text, of two characters or more, repeats kept."""
    parts = F.regexp_extract_all(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z0-9]+", " "), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 2)


def tokens(c: Column | str) -> Column:
    """all_tokens, each once, in order of first occurrence."""
    return F.array_distinct(all_tokens(c))


def identifier_tokens(c: Column | str, max_chars: int = 4000, max_tokens: int = 256) -> Column:
    """Parts of identifiers in the first characters of a text: no keywords, no numbers, three characters or more; repeats of an identifier kept."""
    words = F.regexp_extract_all(F.substring(F.coalesce(_col(c), F.lit("")), 1, max_chars), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    words = F.filter(words, lambda w: ~F.lower(w).isin(CSHARP_KEYWORDS))
    parts = F.flatten(F.transform(words, tokens))
    return F.slice(F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(CSHARP_KEYWORDS)), 1, max_tokens)


def keywords(c: Column | str) -> Column:
    """Distinct lower-case words of a query over two characters that are no stop words."""
    words = F.transform(F.split(_col(c), r"(?U)\W+"), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def symbol_names(c: Column | str) -> Column:
    """Capitalised and snake_case words of a query."""
    names = F.regexp_extract_all(_col(c), F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:_[a-z]+)+)\b"), F.lit(1))
    return F.array_distinct(F.filter(names, lambda w: F.length(w) > 2))


def file_paths(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"\b[\w/\\]+\.\w+\b"), F.lit(0)))


def trigrams(c: Column | str) -> Column:
    """Distinct trigrams of a text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(0.0)).otherwise(both / every)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def line_count(c: Column | str) -> Column:
    """0 for an empty text, else one more than its line ends."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, "\n", -1)))


def line_window(c: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start to end, counted from 1 and held to the text; null for a blank text."""
    lines = F.split(_col(c), "\n", -1)
    n = F.size(lines)
    first = F.least(F.greatest(_col(start), F.lit(1)), n)
    last = F.least(F.greatest(_col(end), first), n)
    return F.when(F.trim(F.regexp_replace(_col(c), r"\s", " ")) != "", F.array_join(F.slice(lines, first, last - first + 1), "\n"))


def byte_size(c: Column | str) -> Column:
    return F.octet_length(_col(c))


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(_col(c)) / 4).cast("int")


def normalize_qualified(c: Column | str, strip: bool = True) -> Column:
    """Trimmed and lower case; with strip without what follows the first bracket."""
    t = F.trim(_col(c))
    return F.lower(F.trim(F.substring_index(t, "(", 1)) if strip else t)


def simple_name(c: Column | str) -> Column:
    """What follows the last dot, or the whole name if nothing does."""
    t = _col(c)
    last = F.substring_index(t, ".", -1)
    return F.when(last == "", t).otherwise(last)


def is_guid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.lit(False))


def canonical_types(c: Column | str) -> Column:
    """Special type names, bare or after System., by their full names."""
    out = _col(c)
    for name, full in SPECIAL_TYPES.items():
        out = F.regexp_replace(F.regexp_replace(out, rf"\bSystem\.{name}\b", full), rf"(?<![.\w]){name}\b", full)
    return out


def detect_language(path: Column | str, content: Column | str | None = None) -> Column:
    """By extension, else by the interpreter of a first line #!, else by file name, else Unknown."""
    p = _col(path)
    by_ext = F.create_map(*[F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)])
    ext = F.lower(F.regexp_extract(p, r"\.([^./\\]+)$", 1))
    name = F.lower(F.regexp_extract(p, r"([^/\\]*)$", 1))
    found = F.element_at(by_ext, ext)
    if content is not None:
        first = F.lower(F.substring_index(_col(content), "\n", 1))
        line = F.when(first.startswith("#!"), first)
        tool = F.lit(None).cast("string")
        for k, v in reversed(INTERPRETERS.items()):
            tool = F.when(line.contains(k), F.lit(v)).otherwise(tool)
        found = F.coalesce(found, tool)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv]), name)
    return F.coalesce(found, known, F.lit("Unknown"))


def is_indexed_language(c: Column | str) -> Column:
    return F.coalesce(~_col(c).isin(*NOT_INDEXED), F.lit(False))


def all_terms_in(terms: Column, *cols: Column | str) -> Column:
    """Whether every term that isn't blank occurs, in any case, in the columns joined by blanks."""
    text = F.lower(F.concat_ws(" ", *[_col(c) for c in cols]))
    return F.forall(terms, lambda t: (F.trim(t) == "") | text.contains(F.lower(t)))


def fallback_content(snippet: Column, signature: Column, kind: Column, name: Column) -> Column:
    return F.coalesce(snippet, signature, F.concat_ws(" ", kind, name))
