"""Planning of an indexing run: workers, costs, phases, samples, ranges, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.names import hash32
from graphspark.operators.read import chunks
from graphspark.plans.scratch import size_checked

PROMPT_TOKENS, CHARS_PER_TOKEN = 2000, 4
#: Workers that are broadcast; more are joined by shuffle.
WORKERS = 10_000
# Share of output to input tokens, and the needed capability, by type of document.
DENSITY = {"spec-sheet": 0.6, "om-manual": 0.3, "performance-handbook": 0.4, "troubleshooting": 0.35, "parts-catalog": 0.5, "general": 0.4}
NEEDS = {"spec-sheet": "structured-extraction", "om-manual": "prose-extraction", "performance-handbook": "prose-extraction", "troubleshooting": "prose-extraction", "parts-catalog": "structured-extraction", "general": "structured-extraction"}


def _lookup(c: Column, table: dict, default: object) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def tokens_of(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def assign_workers(docs: DataFrame, workers: DataFrame) -> DataFrame:
    """docs (source, type, tokens) with worker, chunks, input_tokens, output_tokens and cost.

    workers: name, capabilities, context_window, max_output, input_cost, output_cost (per million), ord. A worker needs
    the type's capability, and a large context for documents above 8000 tokens unless they fit; the fewest chunks go
    first, then the cheapest, then ord. Workers are configuration: up to WORKERS of them are broadcast."""
    need = _lookup(F.col("type"), NEEDS, NEEDS["general"])
    room = F.col("context_window") - PROMPT_TOKENS - F.col("max_output")
    pairs = docs.crossJoin(size_checked(workers, WORKERS))
    fits = F.array_contains("capabilities", need) & ((F.col("tokens") <= 8000) | F.array_contains("capabilities", "large-context") | (F.col("tokens") <= room))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.greatest(F.lit(1), room))).cast("long")
    scored = pairs.where(fits).withColumn("chunks", chunks).withColumn("room", room)
    best = scored.groupBy("source").agg(F.min_by(F.struct(F.col("name").alias("worker"), "chunks", "room", "input_cost", "output_cost"), F.struct("chunks", F.col("input_cost") + F.col("output_cost"), "ord")).alias("b"))
    out = docs.join(best, "source", "left")
    part = F.least("tokens", F.col("b.room"))
    density = _lookup(F.col("type"), DENSITY, DENSITY["general"])
    out = out.withColumn("input_tokens", (F.col("b.chunks") * (PROMPT_TOKENS + part)).cast("long")).withColumn("output_tokens", F.ceil(F.round(F.col("b.chunks") * part * density, 6)).cast("long"))
    cost = F.col("input_tokens") / 1e6 * F.col("b.input_cost") + F.col("output_tokens") / 1e6 * F.col("b.output_cost")
    return out.select("source", "type", "tokens", F.col("b.worker").alias("worker"), F.col("b.chunks").alias("chunks"), "input_tokens", "output_tokens", F.round(cost, 6).alias("cost"))


def reassign(failed: DataFrame, workers: DataFrame) -> DataFrame:
    """failed (source, worker, tried, error) with next_worker: of those not tried and more capable for the kind of
    error (a larger context; for bad output, also a higher price; else more capabilities), the cheapest."""
    now = workers.select(F.col("name").alias("worker"), F.col("context_window").alias("cw"), (F.col("input_cost") + F.col("output_cost")).alias("cc"), F.size("capabilities").alias("caps"))
    pairs = failed.join(size_checked(now, WORKERS), "worker").crossJoin(size_checked(workers, WORKERS)).withColumn("price", F.col("input_cost") + F.col("output_cost"))
    larger = F.col("context_window") > F.col("cw")
    error = F.lower(F.coalesce("error", F.lit("")))
    fits = F.when(error.rlike("context|too long|maximum.*token"), larger).when(error.rlike("json|parse|output|truncat"), larger | (F.col("price") > F.col("cc"))).otherwise(larger | (F.size("capabilities") > F.col("caps")))
    fresh = (F.col("name") != F.col("worker")) & ~F.array_contains(F.coalesce("tried", F.array().cast("array<string>")), F.col("name"))
    best = pairs.where(fits & fresh).groupBy("source").agg(F.min_by("name", F.struct("price", "ord")).alias("next_worker"))
    return failed.join(best, "source", "left")


def validation_cost(items: int, input_cost: float, output_cost: float, batch: int = 10, escalation: tuple[float, float] | None = None) -> dict[str, float]:
    """Batches, tokens and cost of checking items; with the prices of a second worker, a tenth goes there too."""
    tokens_in, tokens_out = 1500, 200
    cost = items * (tokens_in * input_cost + tokens_out * output_cost) / 1e6
    if escalation:
        cost += -(-items // 10) * (tokens_in * escalation[0] + tokens_out * escalation[1]) / 1e6
    return {"batches": -(-items // batch), "input_tokens": items * tokens_in, "output_tokens": items * tokens_out, "cost": round(cost, 2)}


def phase(sources: DataFrame, archives: bool = False) -> DataFrame:
    """One row with the phase that the sources' statuses imply."""
    s = F.col("status")
    some = lambda *names: F.coalesce(F.max(s.isin(*names)), F.lit(False))
    every = lambda name: F.coalesce(F.min(s == name), F.lit(False))
    active = sources.groupBy().agg(F.count(F.lit(1)).alias("n"))
    live = sources.where("status <> 'excluded'").groupBy().agg(
        F.count(F.lit(1)).alias("m"), every("validated").alias("validated"), some("needs-conversion", "converting").alias("converting"), some("pending", "extracting", "deduplicating").alias("open"), every("extracted").alias("extracted"), some("imported").alias("imported"), some("consolidated").alias("consolidated")
    )
    name = F.when(F.col("n") == 0, "prepare").when((F.col("m") == 0) | F.col("validated"), "complete").when(F.col("converting"), "prepare").when(F.col("open"), "extract").when(F.col("extracted"), "extraction-review").when(F.col("imported"), "import").when(F.col("consolidated"), "import" if archives else "consolidate").otherwise("complete")
    return active.crossJoin(live).select(name.alias("phase"))


def weighted_ranges(total: int, weights: list[float]) -> list[tuple[int, int]]:
    """(offset, count) for each weight: rounded half up; the last takes the rest."""
    out, at = [], 0
    for i, w in enumerate(weights):
        n = total - at if i == len(weights) - 1 else int(total * w / sum(weights) + 0.5)
        out.append((at, n))
        at += n
    return out


def assign_ranges(rows: DataFrame, weights: list[float], order: str = "id") -> DataFrame:
    """rows (order unique) with the number of the worker whose range they fall in."""
    ranges = weighted_ranges(rows.count(), weights)
    edges = rows.sparkSession.createDataFrame([(k, a, a + n) for k, (a, n) in enumerate(ranges)], "worker int, lo long, hi long")
    numbered = chunks(rows.withColumn("id", F.col(order).cast("string")) if order != "id" else rows, 1).withColumnRenamed("sequence", "at")
    return numbered.join(F.broadcast(edges), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).drop("lo", "hi", "is_last")


def sample(rows: DataFrame, percent: float = 20.0, keys: tuple[str, str] = ("source", "label")) -> DataFrame:
    """The share of rows with the smallest 32-bit hash of "source:label", rounded up."""
    n = -(-rows.count() * percent // 100)
    return rows.withColumn("hash", hash32(F.concat_ws(":", *keys))).orderBy("hash", *keys).limit(int(n))


def recent_context(entries: DataFrame, chapter: int, window: int = 6, most: int = 8000) -> DataFrame:
    """Entries (source, name, last_seen, text) seen in the last `window` chapters, the latest first, as many as fit
    in `most` characters of each source."""
    near = entries.where((F.col("last_seen") <= chapter) & (F.col("last_seen") > chapter - window))
    held = F.sum(F.length("text") + 1).over(Window.partitionBy("source").orderBy(F.desc("last_seen"), "name").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("held", held).where(F.col("held") <= most).drop("held")


def conversion_summary(rows: DataFrame) -> DataFrame:
    """Numbers of converted, skipped and failed documents, and bytes of the converted ones."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    return rows.agg(n("converted"), n("skipped"), n("failed"), F.coalesce(F.sum(F.when(F.col("status") == "converted", F.col("bytes"))), F.lit(0)).alias("bytes"))


def not_done(items: DataFrame, done: DataFrame, sources: list[str] | None = None, keys: tuple[str, ...] = ("source", "key")) -> DataFrame:
    """Items still to check: not among the done ones, of a source that holds one of the given texts."""
    left = items.join(done.select(*keys).distinct(), list(keys), "left_anti")
    if not sources:
        return left
    held = F.lit(False)
    for s in sources:
        held |= F.contains(F.col("source"), F.lit(s))
    return left.where(held)


def compare_workers(rows: DataFrame) -> DataFrame:
    """source and best worker of trials (source, worker, tier, coverage, orphan_percent, duplicates): the highest
    tier * 1000 + coverage - orphans - duplicates; ties by name."""
    score = F.col("tier") * 1000 + F.col("coverage") - F.col("orphan_percent") - F.col("duplicates")
    scored = rows.withColumn("score", score)
    return scored.groupBy("source").agg(F.min_by("worker", F.struct(-F.col("score"), F.col("worker"))).alias("worker"), F.max("score").alias("score"))
