"""Documents as lines, chapters, chunks and tables."""

from __future__ import annotations

import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAPTER_SIZE, CHUNK_SIZE, OVERLAP = 30_000, 100_000, 2000
# What marks a place to cut, and its priority. Headings by number of marks, underlines, page marks, gaps.
HEADING = r"(?U)^(#{1,3})\s+([^\r\n]+)\z"
HEADING_PRIORITY = {1: 30, 2: 20, 3: 10}
UNDERLINE = {1: r"^={3,}$", 2: r"^-{3,}$"}
PAGE, PAGE_PRIORITY, GAP_PRIORITY = r"(?U)^--\s*\d+\s+of\s+\d+\s*--$", 15, 5
#: Chapters are cut at the points of the first of these least priorities that at least two points have.
TIERS = (20, 10, GAP_PRIORITY)


def line_marks(lines: Column) -> Column:
    """The lines (from 0) where a document may be cut, in order: array of line, priority, heading and level.

    Each line is classified by itself and its neighbours in one pass over the array of lines. A line with an underline
    below it is a heading unless it is marked itself; of two empty lines or more the second is a gap."""
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    edge = F.lit("-")
    after = F.slice(bare, F.lit(2), F.greatest(F.size(bare) - 1, F.lit(0)))
    near = {"line": lines, "own": bare, "last": F.concat(F.array(edge), bare), "other": F.concat(F.array(edge, edge), bare), "after": after}

    def mark(x: Column, i: Column) -> Column:
        level = F.length(F.regexp_extract(x["line"], HEADING, 1))
        row = lambda priority, heading, lv: F.struct(i.cast("int").alias("line"), F.lit(priority).cast("int").alias("priority"), heading.alias("heading"), F.lit(lv).cast("int").alias("level"))
        kinds = [(level == lv, row(priority, x["line"], lv)) for lv, priority in HEADING_PRIORITY.items()]
        kinds.append((x["own"].rlike(PAGE), row(PAGE_PRIORITY, x["own"], 0)))
        kinds += [((x["own"] != "") & x["after"].rlike(under), row(HEADING_PRIORITY[lv], F.concat(F.lit("#" * lv + " "), x["own"]), lv)) for lv, under in UNDERLINE.items()]
        kinds.append(((x["own"] == "") & (x["last"] == "") & (x["other"] != ""), row(GAP_PRIORITY, F.lit(""), 0)))
        return F.coalesce(*[F.when(held, value) for held, value in kinds])

    marks = F.transform(F.arrays_zip(*[c.alias(k) for k, c in near.items()]), mark)
    return F.filter(marks, lambda m: m.isNotNull())


def marked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 1), priority, heading and level of each place where a document may be cut."""
    rows = _marked(docs, id_col, text_col)
    return rows.select("doc_id", F.explode("marks").alias("m")).select("doc_id", (F.col("m.line") + 1).alias("line"), "m.priority", "m.heading", "m.level")


def is_structured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and whether a document has two places to cut or more."""
    return _marked(docs, id_col, text_col).select("doc_id", (F.size("marks") >= 2).alias("structured"))


def _pack(sizes: list[int], bounds: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring segments (numbers of the first and one past the last) that fit in `most` together, as few as can be.
    bounds: the segments' first lines and the end; sizes: characters before each line, line feeds included."""
    first = 0
    for k in range(1, len(bounds) - 1):
        if sizes[bounds[k + 1]] - sizes[bounds[first]] - 1 > most:
            yield first, k
            first = k
    yield first, len(bounds) - 1


def _cuts(sizes: list[int], marks: list[dict], lo: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
    """The lines lo to hi in parts of up to `most` characters, a line at least: each ends before the best mark in reach, the
    first of equal ones, or where no further line fits."""
    while sizes[hi] - sizes[lo] > most:
        end = max(lo + 1, bisect.bisect_right(sizes, sizes[lo] + most) - 1)
        near = [m for m in marks if lo < m["line"] <= end]
        at = max(near, key=lambda m: (m["priority"], -m["line"]))["line"] if near else end
        if at >= hi:
            break
        yield lo, at
        lo = at
    yield lo, hi


def _chapters(lines: list[str], marks: list[dict], most: int) -> Iterator[tuple[str, int, int, int, str]]:
    """(heading, level, first line, end, content) of a document's chapters."""
    if not marks:
        yield "Document", 0, 0, len(lines), "\n".join(lines)
        return
    least = next((t for t in TIERS if sum(m["priority"] >= t for m in marks) >= 2), 0)
    points = [m for m in marks if m["priority"] >= least]
    heads = [(m["heading"] or f"Segment {k}", m["level"]) for k, m in enumerate(points, 1)]
    bounds = [*(m["line"] for m in points), len(lines)]
    before = "\n".join(lines[: bounds[0]]).rstrip()
    if before:  # what precedes the first point, without the blank lines at its end
        heads, bounds = [("Preamble", 0), *heads], [0, *bounds]
    kept = before.count("\n") + 1 if before else 0
    blank = set(range(kept, points[0]["line"])) if before else set()
    sizes = list(itertools.accumulate((0 if i in blank else len(x) + 1 for i, x in enumerate(lines)), initial=0))
    if before:
        sizes = [min(s, len(before) + 1) if i <= points[0]["line"] else s - sizes[points[0]["line"]] + len(before) + 1 for i, s in enumerate(sizes)]
    text = lambda a, b: "\n".join(x for i, x in enumerate(lines[a:b], a) if i not in blank)
    for first, last in _pack(sizes, bounds, most):
        lo, hi = bounds[first], bounds[last]
        whole = sizes[hi] - sizes[lo] - 1 <= most
        for part, (a, b) in enumerate([(lo, hi)] if whole else _cuts(sizes, marks, lo, hi, most)):
            yield heads[first][0] + (" (continued)" if part else ""), heads[first][1], a, b, text(a, b)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    return docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).withColumn("marks", line_marks(F.col("lines")))


def overview(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, title, structure (an indented line for each heading) and chapters of each document of split_chapters(),
    with the title from sources (doc_id, path) where a document has no heading."""
    bare = F.regexp_replace("heading", r"^#+\s+", "")
    line = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("  "), F.col("level") - 1), bare)).when(F.col("heading") != "Preamble", F.col("heading"))
    rows = chapters.select("doc_id", "index", F.when(F.col("level") > 0, bare).alias("title"), line.alias("line"))
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("index"))).alias("title"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("index", "line")))).alias("x"))
    none = F.concat(F.col("chapters").cast("string"), F.lit(" segments (no heading structure detected)"))
    structure = F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda x: x["line"]), "\n")).otherwise(none)
    name = F.element_at(F.split("path", "[/\\\\]"), -1)
    return per.join(sources.select("doc_id", "path"), "doc_id", "left").select("doc_id", F.coalesce("title", name).alias("title"), structure.alias("structure"), "chapters")


def chunks(text: str, most: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(index, lines before it, numbered content): whole lines up to `most` characters; the next one starts far enough
    back to repeat `overlap` characters."""
    lines = text.split("\n")
    out, start, end, held = [], 0, 0, 0
    for i, line in enumerate(lines):
        if held + len(line) + 1 > most and end > start:
            out.append((start, end))
            back, seen = end, 0
            while back > start and seen < overlap:
                back -= 1
                seen += len(lines[back]) + 1
            start, held = back, sum(len(x) + 1 for x in lines[back:end])
        end, held = i + 1, held + len(line) + 1
    out.append((start, end))
    return [(k, a, "\n".join(f"{n + 1}\t{lines[n]}" for n in range(a, b))) for k, (a, b) in enumerate(out)]


def split_chapters(docs: DataFrame, most: int = CHAPTER_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, index, heading, level, line_start, line_end (lines from 1) and content of each chapter.

    Lines are marked by expressions; the marks of the first tier with two or more cut the text. Neighbours are joined while
    they fit in `most` characters; larger pieces are cut again at their best mark, or between lines. A heading keeps its
    marks; a null or empty text is one chapter."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, k, h, lv, a + 1, b, c) for i, lines, marks in zip(pdf["doc_id"], pdf["lines"], pdf["marks"]) for k, (h, lv, a, b, c) in enumerate(_chapters(list(lines), [m if isinstance(m, dict) else m.asDict() for m in marks], most))]
            yield pd.DataFrame(rows, columns=["doc_id", "index", "heading", "level", "line_start", "line_end", "content"])

    return _marked(docs, id_col, text_col).mapInPandas(run, "doc_id long, index int, heading string, level int, line_start int, line_end int, content string")


def split_chunks(docs: DataFrame, most: int = CHUNK_SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, index, line_offset and content of each overlapping chunk."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, *c) for i, t in zip(pdf["doc_id"], pdf["text"]) for c in chunks(t or "", most, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "index", "line_offset", "content"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, index int, line_offset int, content string")


# --- lines ----------------------------------------------------------------------------------------------------------


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 1) and content."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def read_lines(docs: DataFrame, first: int, last: int, **names: str) -> DataFrame:
    """Lines first to last of each document, as far as there are any."""
    return numbered_lines(docs, **names).where(F.col("line").between(max(1, first), last))


def span_text(text: Column, first: Column, last: Column) -> Column:
    """The lines first to last (from 1) of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def grep(docs: DataFrame, pattern: str, context: int = 2, most: int | None = None, **names: str) -> DataFrame:
    """doc_id, line, content and context (neighbouring lines) of the lines that match, case-insensitively; an
    invalid pattern is taken literally."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    text = names.get("text_col", "text")
    held = docs.select(F.col(names.get("id_col", "doc_id")).alias("doc_id"), F.split(F.col(text), "\n", -1).alias("lines"))
    hits = held.select("doc_id", "lines", F.posexplode("lines").alias("at", "content")).where(F.col("content").rlike("(?i)" + pattern))
    start = F.greatest(F.col("at") - context + 1, F.lit(1))
    out = hits.select("doc_id", (F.col("at") + 1).alias("line"), "content", F.array_join(F.slice("lines", start, F.col("at") + 1 + context - start + 1), "\n").alias("context"))
    return out if most is None else out.orderBy("doc_id", "line").limit(most)


def headings(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, line, level and heading of each ATX heading, with section_end: the line before the next heading of the
    same or a higher level (null: the document's end)."""
    found = numbered_lines(docs, **names).withColumn("m", F.regexp_extract("content", r"^(#{1,6})\s+\S", 1)).where("m <> ''")
    rows = found.select("doc_id", "line", F.length("m").alias("level"), F.trim(F.regexp_replace("content", r"^#{1,6}\s+", "")).alias("heading"))
    later = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(later) for k in range(1, 7)]
    nxt = F.element_at(F.array(*ends), F.col("level"))
    return rows.withColumn("section_end", nxt - 1)


def read_section(docs: DataFrame, title: str, most: int = 100, **names: str) -> DataFrame:
    """The lines, up to `most`, of the first section of each document whose heading holds the title."""
    hit = headings(docs, **names).where(F.contains(F.lower("heading"), F.lit(title.lower())))
    first = hit.groupBy("doc_id").agg(F.min_by(F.struct("line", "section_end"), "line").alias("s"))
    lines = numbered_lines(docs, **names).join(first, "doc_id")
    return lines.where((F.col("line") >= F.col("s.line")) & (F.col("line") < F.col("s.line") + most) & (F.col("s.section_end").isNull() | (F.col("line") <= F.col("s.section_end")))).drop("s")


# --- answers of a language model ------------------------------------------------------------------------------------


def salvage(text: str | None) -> str | None:
    """JSON text with entities and relationships from an answer that may be fenced or cut off: what follows the last
    complete object is dropped and the open arrays closed; null if nothing is left."""
    if not text:
        return None
    body = re.sub(r"^<think>.*?</think>\s*", "", text.strip(), flags=re.S | re.I)
    body = re.sub(r"^```(?:json)?\s*", "", body)
    body = re.sub(r"\s*```\s*$", "", body)
    fine = lambda d: isinstance(d, dict) and isinstance(d.get("entities"), list) and isinstance(d.get("relationships"), list)
    try:
        whole = json.loads(body)
        return json.dumps({k: whole[k] for k in ("entities", "relationships")}) if fine(whole) else None
    except ValueError:
        pass
    depth, end = 0, -1
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', body):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 1:
                end = m.end()
    if end <= 0:
        return None
    head = body[:end]
    try:
        got = json.loads(head + ("]}" if '"relationships"' in head else '], "relationships": []}'))
    except ValueError:
        return None
    return json.dumps({k: got[k] for k in ("entities", "relationships")}) if fine(got) and (got["entities"] or got["relationships"]) else None


@F.pandas_udf(T.StringType())
def salvaged(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(salvage, na_action="ignore")


# --- tables ---------------------------------------------------------------------------------------------------------


def markdown_tables(text: str) -> list[tuple[int, list[list[str]]]]:
    """(first line from 1, rows of cells) of each pipe table with a rule under its head."""
    lines, out, i = text.split("\n"), [], 0
    cells = lambda s: [c.strip() for c in s.strip().strip("|").split("|")]
    while i + 1 < len(lines):
        if "|" in lines[i] and re.fullmatch(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*", lines[i + 1]) and "|" in lines[i + 1]:
            rows, j = [cells(lines[i])], i + 2
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                rows.append(cells(lines[j]))
                j += 1
            out.append((i + 1, rows))
            i = j
        else:
            i += 1
    return out


def table_verdict(tables: list[tuple[int, list[list[str]]]], widths: list[int] | None = None) -> tuple[str, list[str]]:
    """clean, suspect or corrupt, and why. `widths`: the column counts of the document's tables as laid out."""
    serious, mild = [], []
    for k, (_, rows) in enumerate(tables):
        n = len(rows[0])
        ragged = sum(len(r) != n for r in rows[1:])
        if ragged:
            (serious if ragged * 2 >= len(rows) else mild).append(f"table {k}: {ragged} ragged rows")
        for c in range(n):
            column = [r[c] for r in rows[1:] if c < len(r) and r[c]]
            numbers = sum(bool(re.fullmatch(r"[-+]?[\d.,]+%?", x)) for x in column)
            if len(column) >= 4 and 0.3 < numbers / len(column) < 0.7:
                mild.append(f"table {k}: column {c} mixes numbers and texts")
    for (a, x), (b, y) in zip(tables, tables[1:]):
        if b - (a + len(x) + 1) <= 2 and len(x[0]) != len(y[0]):
            mild.append(f"fragments at lines {a} and {b}")
    if widths is not None:
        if len(widths) != len(tables):
            mild.append(f"{len(widths)} tables laid out, {len(tables)} found")
        for k, w in enumerate(widths[: len(tables)]):
            n = len(tables[k][1][0])
            if abs(w - n) >= 3 and max(w, n) >= 1.5 * min(w, n):
                serious.append(f"table {k}: {n} columns of {w}")
    return ("corrupt" if serious else "suspect" if mild else "clean"), serious + mild


def detect_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tables, verdict and reasons of each document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                found = markdown_tables(t or "")
                verdict, why = table_verdict(found)
                rows.append((i, len(found), verdict, "; ".join(why)))
            yield pd.DataFrame(rows, columns=["doc_id", "tables", "verdict", "reasons"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, tables int, verdict string, reasons string")
