"""Files that nobody wrote by hand: generated, minified or bundled, copied from third parties, data as code.

Layout comes first: longest line, mean line of the head and of the whole file, shares of white space and
alphanumerics, numeric literals and long encoded runs meet thresholds tuned per language. Files of ordinary
layout are told by general conventions of paths and of generators' banners. Banners no convention covers are
found in the collection itself: a line of the comment that opens a file is foreign if its word triples
stand, across all files, where layout, paths or conventions have already told a file to be so.

Defined results: the row of a file is judged with the head of the same id, or without one; null path,
language or sizes count as unknown and prove nothing; sizes below 1 or fewer bytes than lines are
impossible and ignored; repeated rows give one result; a very long head is measured as a whole, and so is the
comment that opens it; an empty table gives an empty result. Only the named columns are read, so clashing
extra ones do no harm.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


class Layout(NamedTuple):
    """Limits of hand-written text in a language.

    Dense text has a longest and a mean line over the limits, less white space, and, unlike prose, less
    alphanumerics. Data has more digits and numeric literals (per 100 characters), or is mostly encoded runs,
    which are more alphanumeric than code.
    """

    longest: float
    head_mean: float
    file_mean: float
    white: float
    dense_alnum: float
    digits: float
    numbers: float
    runs: float
    run_alnum: float


_NEVER = float("inf")
#: Between what hand-written and other heads show: hand-written code has lines to 355, means to 95, white space from 0.10,
#: alphanumerics to 0.85, digits to 0.05, 2.4 numbers; minified heads have lines from 300, white space to 0.07; tables of data digits from 0.13.
LAYOUT = {
    "default": Layout(2000, 400, 400, 0.02, 0.95, 0.20, 4.0, 0.5, 0.60),
    "javascript": Layout(250, 120, 300, 0.08, 0.80, 0.20, 4.0, 0.5, 0.60),
    "typescript": Layout(250, 120, 300, 0.08, 0.80, 0.20, 4.0, 0.5, 0.60),
    "css": Layout(200, 100, 200, 0.06, 0.85, _NEVER, _NEVER, 0.5, 0.85),
    "python": Layout(1000, 200, 400, 0.06, 0.80, 0.20, 4.0, 0.5, 0.60),
    "csharp": Layout(1000, 200, 400, 0.06, 0.80, 0.20, 4.0, 0.5, 0.60),
    "java": Layout(1000, 200, 400, 0.06, 0.80, 0.20, 4.0, 0.5, 0.60),
    "go": Layout(1000, 200, 400, 0.06, 0.80, 0.20, 4.0, 0.5, 0.60),
    "rust": Layout(1000, 200, 400, 0.06, 0.80, 0.20, 4.0, 0.5, 0.60),
    "shell": Layout(2000, 400, 1000, 0.02, 0.90, _NEVER, _NEVER, 0.5, 0.85),
    # Formats of data and prose: their literals and long lines are what they are for.
    **dict.fromkeys(("json", "html", "xml", "sql", "yaml"), Layout(5000, 5000, 5000, 0.0, 0.0, _NEVER, _NEVER, _NEVER, _NEVER)),
    "markdown": Layout(100_000, 100_000, 100_000, 0.0, 0.0, _NEVER, _NEVER, _NEVER, _NEVER),
}
#: Characters of encoded text on end that make a run.
RUN = 60

EXTENSIONS = {"cs": "csharp", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust", "css": "css", "json": "json", "md": "markdown", "html": "html", "xml": "xml", "sql": "sql", "yaml": "yaml", "yml": "yaml", "sh": "shell"}

# General conventions of paths.
GENERATED_PATH = (
    r"(^|/)(__generated__|generated|generated-sources|generated-src|gen|obj/(debug|release))/"
    r"|\.designer\.cs$|\.g(\.i)?\.cs$|\.assemblyinfo\.cs$|(^|/)bindings\.rs$"
    r"|\.generated\.[a-z]+$|\.pb(\.gw)?\.go$|\.pb\.(cc|h)$|_pb2(_grpc)?\.pyi?$|(^|/)zz_generated\.[^/]*$"
)
LOCK_PATH = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|composer\.lock|gemfile\.lock|go\.sum|packages\.lock\.json)$|\.lock\.json$"
MINIFIED_PATH = r"[.-]min\.(js|css|mjs)$|\.bundle\.(js|css)$|\.chunk\.js$"
VENDORED_PATH = r"(^|/)(vendor|vendored|third_party|thirdparty|third-party|node_modules|bower_components|site-packages)/|(^|/)external/[^/]+-\d+(\.\d+)+/"
# General conventions of generators' banners: the tag of .NET tools, the line of Go's, the mark of review tools, and a plain order not to edit that ends its line.
GENERATED_BANNER = (
    r"<auto-?generated\b|@generated\b|code generated .*do not edit\.?\W*$|\bgenerated (on|by|from|at|with)\b.*\bdo not (edit|modify)\b"
    r"|\bdo not (edit|modify)( this file)?( by hand| manually)?\s*[.!]?\W*$|\bchanges (to this file )?will be (lost|overwritten)\b"
)
_COMMENT = r"^\s*(//|#|/\*|\*|--|<!--|;|%|'''|\"\"\")"
#: Files that a word triple is taken to stand in beside those it is seen in: few prove little.
DOUBT = 2.0
#: Share of files already told, averaged over a line's triples, from which the line is foreign. Over 15,000 and 150,000 files
#: no line of hand-written files comes over 0.05, none of the others' banners under 0.21.
FOREIGN = 0.12


def _either(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters of text that match pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def statistics(files: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per distinct row of files and its head: file_id, path, kind, the layout statistics, opening (lines of the comment the head opens with), known."""
    f = files.select(F.col("id").alias("file_id"), F.col("file_path").alias("path"), F.col("language").alias("said"), F.col("size_bytes").alias("bytes"), F.col("line_count").alias("lines")).where("file_id is not null")
    h = heads.where("file_id is not null").groupBy("file_id").agg(F.max("head").alias("head"))
    x = f.distinct().join(h, "file_id", "left")

    x = x.withColumn("path", F.lower(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/")))
    kinds = F.create_map(*[F.lit(v) for kv in EXTENSIONS.items() for v in kv])
    ext = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    said = F.lower(F.coalesce("said", F.lit("")))
    x = x.withColumn("kind", F.coalesce(F.element_at(kinds, ext), F.when(said.isin(list(LAYOUT)), said), F.lit("default")))

    lines = F.split(F.regexp_replace("head", "\r", ""), "\n", -1)
    x = x.withColumn("ls", F.filter(lines, lambda s: F.length(F.trim(s)) > 0))
    code_at = F.array_min(F.transform("ls", lambda s, i: F.when(~s.rlike(_COMMENT), i)))  # null: nothing but comments
    x = x.withColumns(
        {
            "known": F.coalesce(F.length("head") > 0, F.lit(False)),
            "longest": F.coalesce(F.array_max(F.transform("ls", F.length)), F.lit(0)),
            "head_mean": F.length("head") / F.greatest(F.size("ls"), F.lit(1)),
            "file_mean": F.when((F.col("bytes") > 0) & (F.col("lines") > 0) & (F.col("bytes") >= F.col("lines")), F.col("bytes") / F.col("lines")),
            "white": _share(F.col("head"), r"\s"),
            "alnum": _share(F.col("head"), r"[\p{L}\p{N}]"),
            "digits": _share(F.col("head"), r"0[xX][0-9a-fA-F]+|\d"),
            "numbers": F.size(F.regexp_extract_all("head", F.lit(r"(?<![\w.])(0[xX][0-9a-fA-F]+|\d+(\.\d+)?)(?![\w])"), F.lit(0))) * 100 / F.greatest(F.length("head"), F.lit(1)),
            "runs": _share(F.col("head"), rf"[A-Za-z0-9+/=_-]{{{RUN},}}"),
            "opening": F.transform(F.slice("ls", 1, F.coalesce(code_at, F.size("ls"))), F.lower),
        }
    )
    return x.drop("ls", "head", "said")


def by_layout(x: DataFrame) -> Column:
    """data, minified or null, from the statistics alone."""
    limits = F.create_map(*[v for name, t in LAYOUT.items() for v in (F.lit(name), F.struct(*[F.lit(float(n)).alias(f) for f, n in t._asdict().items()]))])
    limit = F.element_at(limits, F.col("kind"))
    known = F.col("known")
    tight = (F.col("white") < limit["white"]) & (F.col("alnum") < limit["dense_alnum"])
    dense = known & tight & (F.col("longest") > limit["longest"]) & (F.col("head_mean") > limit["head_mean"])
    # Without a head only the mean over the whole file is left; with one, its lines must agree.
    packed = F.col("file_mean").isNotNull() & (F.col("file_mean") > limit["file_mean"]) & (~known | tight)
    table = (F.col("digits") > limit["digits"]) & (F.col("numbers") > limit["numbers"])
    encoded = (F.col("runs") > limit["runs"]) & (F.col("alnum") > limit["run_alnum"])
    return F.when(known & (table | encoded), "data").when(F.coalesce(dense, F.lit(False)) | F.coalesce(packed, F.lit(False)), "minified")


def _plain(line: Column) -> Column:
    """The words of a line, every word with a digit as 0."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(line, r"\w*\d[\w.:-]*", " 0 "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def foreign_lines(told: DataFrame, doubt: float = DOUBT, share: float = FOREIGN) -> DataFrame:
    """told: lines (array), against (whether the file is already told). The lines that stand mostly in such files.

    Files are counted per distinct line before anything else, so a line that a third of all files share is one row.
    """
    lines = told.select(F.explode("lines").alias("line"), F.col("against").cast("long").alias("against")).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("against").alias("e"))
    words = F.concat(F.array(F.lit("<")), F.split("line", " "), F.array(F.lit(">")))
    lines = lines.withColumn("words", words).withColumn("of", F.size("words") - 2)
    triples = lines.select("line", "n", "e", "of", F.explode(F.transform(F.sequence(F.lit(1), F.col("of")), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)))).alias("triple"))
    rate = triples.groupBy("triple").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).where("e > 0").select("triple", (F.col("e") / (F.col("n") + doubt)).alias("rate"))
    seen = triples.select("line", "of", "triple").join(rate, "triple")
    return seen.groupBy("line", "of").agg(F.sum("rate").alias("rate")).where(F.col("rate") / F.col("of") >= share).select("line")


def judge(files: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per row of files and its head: file_id, path, kind, the statistics, and the reason (null: hand-written)."""
    x = statistics(files, heads)
    path = lambda pattern: _either(F.col("path"), pattern)
    convention = F.coalesce(F.exists("opening", lambda s: s.rlike(GENERATED_BANNER)), F.lit(False))
    told = F.coalesce(
        by_layout(x),
        F.when(path(LOCK_PATH), "lock file").when(path(VENDORED_PATH), "third party path").when(path(GENERATED_PATH), "generated path").when(path(MINIFIED_PATH) & ~F.col("known"), "minified path"),
        F.when(convention, "generated banner"),
    )
    lines = F.filter(F.array_distinct(F.transform("opening", _plain)), lambda s: s != "")
    x = cut(x.withColumn("told", told).withColumn("lines", F.coalesce(lines, F.array().cast("array<string>"))).drop("opening"), "heads")
    foreign = foreign_lines(x.select("lines", F.col("told").isNotNull().alias("against")))
    open_ = x.where("told is null").select("file_id", F.explode("lines").alias("line"))
    shared = open_.join(foreign, "line", "left_semi").select("file_id").distinct().withColumn("shared", F.lit("shared banner"))
    judged = x.join(shared, "file_id", "left")
    return judged.withColumn("reason", F.coalesce("told", "shared")).drop("told", "shared", "lines")


def not_written(files: DataFrame, heads: DataFrame) -> DataFrame:
    """file_id of each file that is generated, minified, third-party or data."""
    return judge(files, heads).where("reason is not null").select("file_id").distinct()


def written(files: DataFrame, heads: DataFrame) -> DataFrame:
    """file_id, path and kind of each file no row of which is anything but hand-written."""
    judged = judge(files, heads).groupBy("file_id").agg(F.max("path").alias("path"), F.max("kind").alias("kind"), F.count("reason").alias("against"))
    return judged.where("against = 0").select("file_id", "path", "kind")


def reasons(files: DataFrame, heads: DataFrame) -> DataFrame:
    """reason (null: hand-written) and its number of files; a file with several rows counts under its first reason."""
    one = judge(files, heads).groupBy("file_id").agg(F.min("reason").alias("reason"))
    return one.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))
