"""Items over a size limit cut into pieces under it, at natural boundaries, with overlap.

A text is handled in ranges, each with a halo of one limit: workers find the line starts of their range, and the
halo shows them every line that a piece can hold whole; the tables of line starts are stitched per item, prefix
sums give lengths and line numbers, one streaming pass over the line table (numbers only) decides the cuts, and
each piece is taken by offset from the one range and halo it lies in. Table cells are cut into ranges as they are
read, files (`file_pieces`) are read range by range; nothing after that holds more of a text than one range and its halo.

A member is a function or method directly in the class that the text shows, with the comment and attribute
lines directly above it. Cuts fall before a member; where a member or line alone is over the limit, at a
blank line, else at a line, else inside the line. Pieces hold as many whole members as fit with the overlap;
overlap is shortened before a member is split.

Defined results: items with a null id or text are left out; repeated rows of an id count once, of different
texts of an id the one with the smallest hash; sizes are in characters, in files in bytes; CRLF stays as it is;
items within the limit give no pieces; a null first line counts as 1; what a line over the limit is, its first
limit characters tell, as no piece can hold it whole; an empty table gives an empty result. Only named columns
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, partitions
from ..sources import files as source_files

#: Characters of a range of a table's text, and bytes of one of a file; the halo is one more than the limit.
RANGE, FILE_RANGE = 1 << 12, 8 << 20

BLANK, COMMENT, ATTRIBUTE, MEMBER, CLASS, CLOSE, OTHER = range(7)

_CLASS = re.compile(r"\s*(?:export\s+|default\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|sealed\s+|abstract\s+|final\s+|partial\s+|pub(?:\([^)]*\))?\s+|unsafe\s+|readonly\s+|ref\s+|data\s+|open\s+)*(?:class|struct|interface|enum|record|trait|impl(?:<[^>]*>)?|object|module|mod|type)\s+\w")
_MEMBER = re.compile(
    r"\s*(?:(?:async\s+)?def\s+\w+\s*\(|(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"\w+\"\s+)?)*fn\s+\w+|func\s*(?:\([^)]*\)\s*)?\w+\s*[(\[]|(?:(?:export|default|async|static)\s+)*function\b"
    r"|(?!(?:return|if|for|foreach|while|switch|catch|else|using|await|throw|new|lock|do|try|case|yield|assert|raise|print|elif|with|match|defer|go|select)\b)(?:[\w$<>\[\],.?:&*]+\s+)*[*#]?[\w$~]+\s*(?:<[^>=]*>)?\s*\([^;=]*(?:=\s*[^;=)]+[^;=]*)*(?:$|\{|\)|,|=>))"
)
_ATTRIBUTE = re.compile(r"\s*(?:\[[^\]]*\]\s*$|@\w|#!?\[)")
_COMMENT = re.compile(r"\s*(?://|/\*|\*(?:\s|/|$)|#(?!!?\[)|--|<!--)")


def kind_of(line: str) -> int:
    """What a line is, from its beginning."""
    bare = line.strip()
    if not bare:
        return BLANK
    if _ATTRIBUTE.match(line):
        return ATTRIBUTE
    if _COMMENT.match(line):
        return COMMENT
    if bare in ("}", "};", "})", "end"):
        return CLOSE
    if _CLASS.match(line):
        return CLASS
    if _MEMBER.match(line) and not bare.endswith((";", "):", ",")) or re.match(r"\s*(?:async\s+)?def\s", line):
        return MEMBER
    return OTHER


def _lines(size: int, halo: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                base, text = r.part * size, r.text if isinstance(r.text, str) else r.text.decode("latin-1")
                starts = [0] if r.part == 0 else []
                at = text.find("\n", 0, size)
                while at >= 0:
                    starts.append(at + 1)
                    at = text.find("\n", at + 1, size)
                for s in starts:
                    if base + s >= r.chars:
                        continue  # what follows the last line end is no line
                    end = text.find("\n", s)
                    line = text[s : min(end if end >= 0 else len(text), s + halo)].rstrip("\r")
                    indent = len(line) - len(line.lstrip())
                    out.append((r.item, r.chars, r.shown, base + s, len(line[:indent].expandtabs(4)), kind_of(line)))
            yield pd.DataFrame(out, columns=["item", "chars", "shown", "off", "indent", "kind"])

    return run


def line_table(parts: DataFrame, size: int, halo: int) -> DataFrame:
    """parts: item, chars, shown, part, text (range and halo). Per line: item, chars, shown, off, indent, kind, found range by range."""
    return parts.select("item", "chars", "shown", "part", "text").mapInPandas(_lines(size, halo), "item string, chars long, shown boolean, off long, indent int, kind int")


def _cuts(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Cutter | None = None
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False):
                if now is None or now.item != r.item:
                    if now is not None:
                        now.end(out)
                    now = _Cutter(r.item, r.chars, limit, overlap)
                now.line(out, r.off, r.len, r.no, r.unit, r.kind, r.indent, r.deep)
            yield pd.DataFrame(out, columns=_CUT_COLUMNS)
        if now is not None:
            out = []
            now.end(out)
            yield pd.DataFrame(out, columns=_CUT_COLUMNS)

    return run


_CUT_COLUMNS = ["item", "piece", "at", "until", "first", "last", "from", "members", "over", "natural"]
_CUT_TYPES = "item string, piece int, at long, until long, first long, last long, `from` long, members int, over int, natural int"


class _Cutter:
    """Decides one item's cuts while its lines go by; holds the lines of at most one piece and its overlap."""

    def __init__(self, item: str, chars: int, limit: int, overlap: int) -> None:
        self.item, self.chars, self.limit, self.overlap = item, chars, limit, overlap
        self.lines: list[tuple[int, int, int, bool, bool]] = []  # off, len, no, unit, blank
        self.before: list[tuple[int, int]] = []  # lines ahead of the piece: off, len
        self.piece, self.at, self.first = 0, 0, 0
        self.natural = True  # whether this piece began before a member
        self.members, self.over, self.unit_at = 0, 0, -1
        self.last_end = 0

    def _lead(self) -> int:
        return self.before[0][0] if self.before else self.at

    def _emit(self, out: list[tuple], until: int, last: int) -> None:
        out.append((self.item, self.piece, self.at, until, self.first, last, self._lead(), 0, 0, int(self.natural)))

    def line(self, out: list[tuple], off: int, length: int, no: int, unit: bool, kind: int, indent: int, deep: int) -> None:
        if unit:
            self._close_unit()
            self.unit_at = off
            self.members += 1
        blank = kind == BLANK
        if not blank and not (kind == CLOSE and indent < deep):
            self.last_end = off + length
        self.lines.append((off, length, no, unit, blank))
        if not blank:
            self._fit(out)

    def _close_unit(self) -> None:
        if self.unit_at >= 0 and self.last_end - self.unit_at - 1 > self.limit:
            self.over += 1

    def _size(self) -> int:
        off, length, *_ = self.lines[-1]
        return off + length - self._lead() - (off + length < self.chars)

    def _fit(self, out: list[tuple]) -> None:
        while self._size() > self.limit:
            inner = [i for i, x in enumerate(self.lines) if x[0] > self.at]
            units = [i for i in inner if self.lines[i][3]]
            if units:
                self._cut(out, units[-1] if self._ends_at(units[-1]) <= self.limit else units[0], True)
                continue
            if self.before:  # a shorter overlap before a split member
                self.before.pop(0)
                continue
            blanks = [i for i in inner if i and self.lines[i - 1][4]]
            if blanks or inner:
                self._cut(out, (blanks or inner)[-1], False)
                continue
            # One line over the limit.
            off, length, no, unit, blank = self.lines[-1]
            until = self.at + self.limit
            self._emit(out, until, no)
            self.piece, self.at, self.first, self.natural, self.before = self.piece + 1, until, no, False, []

    def _ends_at(self, i: int) -> int:
        return self.lines[i][0] - self._lead() - 1

    def _cut(self, out: list[tuple], i: int, natural: bool) -> None:
        off, _, no, *_ = self.lines[i]
        self._emit(out, off, self.lines[i - 1][2])
        ahead = self.before + [(x[0], x[1]) for x in self.lines[:i]]
        self.before = ahead[-self.overlap :] if self.overlap else []
        self.lines = self.lines[i:]
        self.piece, self.at, self.first, self.natural = self.piece + 1, off, no, natural

    def end(self, out: list[tuple]) -> None:
        self._close_unit()
        if self.at < self.chars:
            self._emit(out, self.chars, self.lines[-1][2] if self.lines else self.first)
        out.append((self.item, -1, 0, 0, 0, 0, 0, self.members, self.over, 0))


def text_ranges(chunks: DataFrame, limit: int, size: int) -> DataFrame:
    """Items over the limit as ranges: item, chars, start, shown, part, text (the range and a halo of limit + 1)."""
    over = chunks.where(F.col("id").isNotNull() & (F.length("content") > limit))
    kind = F.lower(F.trim(F.coalesce("symbol_kind", F.lit("unknown"))))
    shown = ~kind.isin("method", "function", "constructor", "property") & ~((kind == "unknown") & F.coalesce(F.col("signature").contains("("), F.lit(False)))
    head = F.struct(F.xxhash64("content").alias("digest"), F.length("content").cast("long").alias("chars"), F.coalesce("chunk_start_line", F.lit(1)).alias("start"), shown.alias("shown"))
    over = over.select(F.col("id").alias("item"), head.alias("head"), "content")
    one = over.groupBy("item").agg(F.min("head").alias("head"))
    # One pass of a pattern cuts a cell into ranges; substrings by position would each count from its beginning.
    over = over.select("item", "head", F.regexp_extract_all("content", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("cut"))
    more = -(-(limit + 1) // size)
    with_halo = F.transform("cut", lambda t, i: F.concat(t, F.left(F.array_join(F.slice("cut", i + 2, more), ""), F.lit(limit + 1))))
    parts = over.select("item", "head", F.posexplode(with_halo).alias("part", "text")).join(one, ["item", "head"], "left_semi")
    return parts.groupBy("item", "head", "part").agg(F.first("text").alias("text")).select("item", "head.chars", "head.start", "head.shown", F.col("part").cast("long").alias("part"), "text")


def cut_table(parts: DataFrame, limit: int, overlap: int, size: int) -> DataFrame:
    """The cuts of items given as ranges, with a row of piece -1 for each item."""
    lines = cut(line_table(parts, size, limit + 1), "lines")
    order = Window.partitionBy("item").orderBy("off")
    whole = Window.partitionBy("item")
    lines = lines.withColumn("open", F.min(F.when(F.col("kind") == CLASS, F.struct("off", "indent"))).over(whole))
    inside = F.col("shown") & (F.col("off") > F.col("open.off")) & (F.col("indent") > F.col("open.indent"))
    lines = lines.withColumn("deep", F.min(F.when(inside & (F.col("kind") == MEMBER), F.col("indent"))).over(whole))
    lines = lines.withColumn("member", F.coalesce(inside & (F.col("kind") == MEMBER) & (F.col("indent") == F.col("deep")), F.lit(False)))
    lines = lines.withColumns({"next": F.coalesce(F.lead("off").over(order), "chars"), "no": (F.row_number().over(order) - 1).cast("long")})
    # The line after the last one that is neither comment nor attribute begins the member.
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = ~F.col("kind").isin(COMMENT, ATTRIBUTE)
    begins = F.coalesce(F.max(F.when(breaks, F.col("next"))).over(ahead), F.lit(0).cast("long"))
    lines = lines.withColumn("begins", F.when(F.col("member"), begins))
    # From the end of the item: the nearest member at or after a line has that line as its beginning.
    after = Window.partitionBy("item").orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("unit", F.coalesce(F.last("begins", ignorenulls=True).over(after) == F.col("off"), F.lit(False)))
    lines = lines.select("item", "off", "chars", (F.col("next") - F.col("off")).alias("len"), "no", "unit", "kind", "indent", F.coalesce("deep", F.lit(0)).alias("deep"))
    return cut(lines.repartition(partitions(parts.sparkSession), "item").sortWithinPartitions("item", "off").mapInPandas(_cuts(limit, overlap), _CUT_TYPES), "cuts")


def _emitted(parts: DataFrame, cuts: DataFrame, size: int) -> DataFrame:
    """Each piece with the range it begins in, which with its halo holds it whole."""
    x = cuts.where("piece >= 0").withColumn("part", F.floor(F.col("from") / size)).join(parts.select("item", "start", "part", "text"), ["item", "part"])
    return x.withColumn("content", F.expr(f"substring(text, cast(`from` - part * {size} as int) + 1, cast(until - `from` as int))"))


def _columns(x: DataFrame) -> list:
    return [
        "piece",
        (F.col("start") + F.col("first")).cast("int").alias("start_line"),
        (F.col("start") + F.col("last")).cast("int").alias("end_line"),
        (F.col("at") - F.col("from")).cast("int").alias("overlap_chars"),
        "content",
        F.floor(F.length("content") / 4).cast("int").alias("token_count"),
    ]


def pieces(chunks: DataFrame, limit: int, overlap: int, *, size: int = RANGE) -> DataFrame:
    """chunk_id, piece, start_line, end_line (overlap not counted), overlap_chars, content, token_count (characters / 4)."""
    parts = cut(text_ranges(chunks, limit, size), "ranges")
    x = _emitted(parts, cut_table(parts, limit, overlap, size), size)
    return x.select(F.col("item").alias("chunk_id"), *_columns(x))


def file_pieces(paths: DataFrame, limit: int, overlap: int, *, size: int = FILE_RANGE) -> DataFrame:
    """paths: path, length. As pieces, of files over the limit read in byte ranges: path, and content as bytes; sizes are bytes."""
    over = paths.where(F.col("path").isNotNull() & (F.col("length") > limit)).select("path", F.col("length").cast("long").alias("length")).distinct()
    parts = source_files.ranges(paths.sparkSession, over, size, limit + 1).join(over, "path")
    parts = parts.select(F.col("path").alias("item"), F.col("length").alias("chars"), F.lit(1).alias("start"), F.lit(True).alias("shown"), "part", F.col("bytes").alias("text"))
    # The ranges are read once for the lines and once more for the pieces: they are not written a second time.
    x = _emitted(parts, cut_table(parts, limit, overlap, size), size)
    return x.select(F.col("item").alias("path"), *_columns(x))


def member_cuts(chunks: DataFrame, limit: int, overlap: int, *, size: int = RANGE) -> DataFrame:
    """chunk_id, cut_line of the items all of whose members fit the limit."""
    parts = cut(text_ranges(chunks, limit, size), "ranges")
    cuts = cut_table(parts, limit, overlap, size)
    fit = cuts.where("piece = -1 and members > 0 and over = 0").select("item")
    x = cuts.where("piece > 0 and natural = 1").join(fit, "item").join(parts.where("part = 0").select("item", "start"), "item")
    return x.select(F.col("item").alias("chunk_id"), (F.col("start") + F.col("first")).cast("int").alias("cut_line")).distinct()
