"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight; the weights share a budget of words, and what a source cannot deliver (more than `most`
times its size) is shared anew among the others. Over the training run, from position 0 to 1, a source's weight moves
linearly from `first` to `last` times its mean; integrated, that is the cumulative demand for the source's words. The
source's copies of documents, laid end to end in an order by hash, are put where the demand reaches them: the
inverse of the integral (a quadratic) at the exact running sum of words before a copy gives its position, and rows are
range-sorted by it.

Whole documents are taken. With a target of r times the source's size, each document is taken floor(r) times, and once
more while the running sum of sizes in the order by hash is within the rest. Running sums over a source of any size
are made in three levels: within ranges of the hash, over the ranges of a block and over the blocks' totals, so no task
gets a whole source (a source of 5e10 documents has 5e4 blocks of 2,000 ranges of 500 rows).

Defined cases: a null or empty text has size 0 and is taken floor(r) times with 0 words; a null source is a source of
its own, ordered last; repeated rows and equal hashes follow in order of id and size and each count; a corpus without
words, or an empty table, takes nothing; extra columns are kept by mix() and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.llm.common import plain, size_checked, stored
from graphspark.operators.read import chunks

#: A range of hashes holds about this many rows of a table, a block this many ranges.
RANGE_ROWS, BLOCK_RANGES = 500, 2000
#: Up to so many sources are shared out on the driver (a name and a size each), more by jobs.
DRIVER_SOURCES = 10_000


def _size(text: Column) -> Column:
    """The number of maximal runs of characters other than U+0009-U+000D and U+0020."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(id_: str, text: str) -> Column:
    """h: a hash of id and text, so rows without an id, or of one, spread too."""
    return F.xxhash64(F.col(id_), F.col(text), F.lit("mix")).alias("h")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Words to take of each source: sources by code point, null last, weigh as `weights` repeats."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left = dict(order), share * sum(n for _, n in order)
    free, out = [s for s, _ in order], dict.fromkeys(size, 0.0)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def _shared(per: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, n, place (in the order of sources) and target of sources (source, n), by jobs: targets() for any number
    of sources."""
    named = per.withColumn("id", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")))
    rows = chunks(named, 1).select("source", "n", F.col("sequence").alias("place"))
    rows = stored(rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    rate = 0.0
    while True:
        full = F.col("weight") * F.lit(rate) > most * F.col("n")  # the rate only grows, so what is full stays full
        r = rows.agg(F.sum("n").alias("all"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")).first()
        new = (share * (r["all"] or 0) - most * (r["full"] or 0)) / r["w"] if r["w"] else rate
        if new <= rate * (1 + 1e-15):
            target = F.when(full, most * F.col("n")).otherwise(F.col("weight") * F.lit(rate))
            return rows.select("source", "n", "place", target.alias("target"))
        rate = new


def _source_table(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, slopes: tuple[float, ...]) -> DataFrame:
    """key, source_size, target, slope, and the target as whole rounds and words of a further one (more)."""
    per = stored(sized.groupBy("source").agg(F.sum("size").alias("n")), "sources")
    names = per.limit(DRIVER_SOURCES + 1).collect()
    if len(names) <= DRIVER_SOURCES:
        goal, size = targets([(r["source"], r["n"]) for r in names], weights, share, most), {r["source"]: r["n"] for r in names}
        rows = [(s, size[s], i, float(goal[s])) for i, s in enumerate(goal)]
        table = sized.sparkSession.createDataFrame(rows, "source string, n long, place long, target double")
    else:
        table = _shared(per, weights, share, most)
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("place") % len(slopes) + 1).cast("int"))
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n") + 1e-12)).otherwise(0).cast("int")
    out = table.select(F.to_json(F.struct("source")).alias("key"), F.col("n").alias("source_size"), "target", slope.alias("slope"), whole.alias("whole"))
    return out.withColumn("more", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))


def _ordered(rows: DataFrame, ranges: int) -> DataFrame:
    """rows (with their place h in the order by hash) with key (their source, never null), id as a string, and range."""
    rows = rows.withColumn("key", F.to_json(F.struct("source")))
    u = (F.col("h") / F.lit(2.0**64) + 0.5) * ranges
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.withColumn("range", F.least(F.floor(u), F.lit(ranges - 1)).cast("long"))


def _ranges(df: DataFrame, weights: tuple[int, ...], share: float, most: float, slopes: tuple[float, ...], id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The sizes by row; for each range of a source the words before it, with what is known of the source; and the
    number of ranges."""
    named = plain(df, ("doc_id", id_col), ("source", source_col), ("text", text_col))
    sized = stored(named.select("doc_id", F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), _place("doc_id", "text")), "sizes")
    goals = _source_table(sized, weights, share, most, slopes)
    ranges = max(1, sized.count() // RANGE_ROWS)
    totals = _ordered(sized, ranges).groupBy("key", "range").agg(F.sum("size").alias("total"))
    totals = stored(totals.withColumn("block", F.floor(F.col("range") / BLOCK_RANGES)), "totals")
    so_far = lambda of, by: F.sum(of).over(by) - F.col(of)
    blocks = totals.groupBy("key", "block").agg(F.sum("total").alias("sum"))
    blocks = blocks.select("key", "block", so_far("sum", Window.partitionBy("key").orderBy("block")).alias("earlier"))
    inner = so_far("total", Window.partitionBy("key", "block").orderBy("range"))
    before = totals.withColumn("inner", inner).join(size_checked(stored(blocks, "blocks")), ["key", "block"])
    before = before.select("key", "range", (F.col("earlier") + F.col("inner")).alias("before")).join(size_checked(goals), "key")
    return sized, stored(before, "ranges"), ranges


def _with_copies(rows: DataFrame, before: DataFrame, ranges: int) -> DataFrame:
    """rows (with doc_id, source and size) with copies and positions."""
    rows = _ordered(rows, ranges).join(size_checked(before), ["key", "range"])
    earlier = Window.partitionBy("key", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    # the running sum's middle grows from row to row, so the rows with a further copy are the first ones
    further = (F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= F.col("more"))
    rows = rows.withColumn("copies", (F.col("whole") + further.cast("int")).cast("int"))
    # copy c starts where c rounds over the source and the words before the row are done
    due = lambda c: F.least(F.lit(1.0), (c * F.col("source_size") + F.col("start")) / F.greatest(F.col("target"), F.lit(1.0)))
    # the root t of slope * t + (2 - 2 * slope) * t^2 / 2 = due
    a, b = F.col("slope"), 2 - 2 * F.col("slope")
    at = lambda c: F.when(b == 0, due(c)).otherwise((F.sqrt(a * a + 2 * b * due(c)) - a) / b)
    return rows.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>")))


def plan(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slopes: tuple[float, ...] = (0.5, 1.0, 1.5), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, start (words of the source before the row) and positions
    (one for each copy) of each row.

    slopes: a source's weight at the start as a multiple of its mean, by turns like the weights; in (0, 2)."""
    sized, before, ranges = _ranges(df, weights, share, most, slopes, id_col, text_col, source_col)
    rows = _with_copies(sized, before, ranges)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "start", "positions")


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slopes: tuple[float, ...] = (0.5, 1.0, 1.5), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training set: a row of df for each copy taken, range-sorted by position; same columns as df. Texts are
    shuffled twice: to their range, where the running sum is made, and for the sort."""
    spark = df.sparkSession
    _, before, ranges = _ranges(df, weights, share, most, slopes, id_col, text_col, source_col)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), _size(F.col(f"`{text_col}`")).alias("size"), _place(f"`{id_col}`", f"`{text_col}`"))
    taken = _with_copies(packed, before, ranges).select("row", "id", F.explode("positions").alias("at"))
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartitionByRange(many, "at", "id").sortWithinPartitions("at", "id").select("row.*")
