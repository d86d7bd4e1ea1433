"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a target of words. Among all document rates between 0 and
MAX_COPIES that meet the targets, entropy balancing takes those closest to one
copy of everything in Kullback-Leibler divergence. The optimum is an exponential
tilt, rate = min(MAX_COPIES, exp(lambda * size / mean size)), with one multiplier
a source, the root of a monotone equation; it comes from Newton steps on the
convex dual, safeguarded by bisection. Rates depend only on source and size, so
the steps run over the table of distinct (source, size) with their counts.

Rates become whole copies: a document takes floor(rate) copies and one more where
a hash of its id falls below the rest of its rate plus a shift; the shift of each
source is searched until the words taken come as near the target as whole
documents allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2.0
NEWTON_STEPS, CLOSE = 30, 1e-9
#: A round of the search splits each source's interval of shifts in so many parts.
SHIFT_PARTS, SHIFT_ROUNDS = 64, 4


def word_count(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+``: white space removed from the ends, runs counted between."""
    return F.when(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) > 0, F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and size (0 for a null text) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, none above cap * source_size.

    Water-filling in closed form: sources are sorted by cap / weight, and the first
    ones are full as long as the level that the rest would need exceeds theirs.
    The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    w = w.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.lit(share) * F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that isn't full sets the level for all that follow; after it the column only falls.
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    return w.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _solve(histogram: DataFrame, state: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The multiplier of each source: (source, mean, target, lam, full)."""
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    state = scratch.save(state)
    for _ in range(NEWTON_STEPS):
        rate = F.least(F.lit(MAX_COPIES), tilt)
        words = F.col("n") * F.col("size")
        slope = F.when(tilt < MAX_COPIES, words * tilt * F.col("size") / F.col("mean")).otherwise(0.0)
        keys = ["source", "source_size", "mean", "target", "full", "lam", "low", "high"]
        got = histogram.join(state, histogram["s"].eqNullSafe(state["source"])).groupBy(*keys).agg(F.sum(words * rate).alias("got"), F.sum(slope).alias("slope"))
        got = got.withColumn("off", F.col("got") - F.col("target"))
        got = got.withColumn("low", F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.col("lam") - F.col("off") / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        near = F.abs("off") <= F.lit(CLOSE) * F.col("target")
        lam = F.when(near | F.col("full"), F.col("lam")).when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        new = scratch.save(got.withColumn("lam", lam).withColumn("done", near | F.col("full") | (F.col("high") - F.col("low") < 1e-12)).select(*keys, "done"), drop=[state])
        state = new
        if new.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "mean", "target", "full", "lam")


def draw():
    """A number in (0, 1) that depends on doc_id alone."""
    return (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def plan_mix(sized: DataFrame, scratch: common.Scratch) -> DataFrame:
    """What the copies follow from: one row a source of (source, source_size, target, mean, lam, full, shift)."""
    docs = scratch.save(sized.withColumn("u", draw()))
    histogram = scratch.save(docs.where("size > 0").groupBy(F.col("source").alias("s"), "size").agg(F.count(F.lit(1)).alias("n")))
    known = scratch.save(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))))
    full = F.col("target") >= F.lit(MAX_COPIES) * F.col("source_size") * (1 - 1e-12)
    means = histogram.groupBy("s").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = known.join(means, known["source"].eqNullSafe(means["s"])).drop("s").where("source_size > 0")
    state = state.select("source", "source_size", "mean", "target", full.alias("full"), F.lit(0.0).alias("lam"), (-50 * F.col("mean")).alias("low"), F.col("mean").alias("high"))
    solved = scratch.save(_solve(histogram, state, scratch))
    rates = docs.where("size > 0").alias("d").join(solved.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")))
    rows = rates.select("d.doc_id", F.col("d.source").alias("s"), "size", "u", _rate().alias("rate"), "full")
    shifts = _shifts(rows, solved, scratch)
    out = known.alias("k").join(solved.alias("m"), F.col("k.source").eqNullSafe(F.col("m.source")), "left").select("k.*", "m.mean", "m.lam", "m.full")
    out = out.alias("o").join(shifts.alias("h"), F.col("o.source").eqNullSafe(F.col("h.source")), "left").select("o.*", "h.shift")
    return scratch.save(out)


def _rate():
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(MAX_COPIES)).otherwise(F.least(F.lit(MAX_COPIES), tilt))


def mix_sources(documents: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document.

    Documents without words (null or empty texts) have size 0 and are never
    taken. A null source is a source of its own. Repeated rows count and are
    taken each by itself, alike. An empty table gives an empty result.
    """
    scratch = scratch or common.Scratch(documents.sparkSession)
    sized = scratch.save(sizes(documents))
    row = sized.alias("d").join(plan_mix(sized, scratch).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.mean", "p.lam", "p.full", "p.shift")
    out = row.withColumn("u", draw()).withColumn("rate", _rate()).withColumn("copies", _taken())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(documents: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it; texts are not shuffled."""
    plan = plan_mix(sizes(documents), scratch).select(F.struct("source", "mean", "lam", "full", "shift").alias("__plan"))
    rows = documents.select(F.struct("*").alias("__row")).join(plan, F.col("__row.source").cast("string").eqNullSafe(F.col("__plan.source")))
    text = F.coalesce(F.col("__row.text").cast("string"), F.lit(""))
    flat = rows.select("__row", F.col("__row.doc_id").cast("long").alias("doc_id"), word_count(text).alias("size"), "__plan.mean", "__plan.lam", "__plan.full", "__plan.shift")
    taken = flat.withColumn("u", draw()).withColumn("rate", _rate()).withColumn("copies", _taken()).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("__row.*")


def _taken():
    return F.when(F.col("size") > 0, _copies(F.coalesce("shift", F.lit(0.0)))).otherwise(0).cast("int")


def _copies(shift):
    whole = F.floor(F.col("rate") + (1 - F.col("u")) + shift)
    return F.greatest(F.lit(0), F.least(F.lit(int(MAX_COPIES)), whole)).cast("int")


def _shifts(rows: DataFrame, solved: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(source, shift): the shift whose whole copies come nearest the target.

    The words taken only grow with the shift, so each round counts them at
    SHIFT_PARTS points of the interval and goes on inside the best part.
    """
    state = scratch.save(solved.where("not full").select("source", "target", F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0.0).alias("shift"), F.lit(float("inf")).alias("off")))
    for _ in range(SHIFT_ROUNDS):
        width = (F.col("high") - F.col("low")) / SHIFT_PARTS
        at = [F.col("low") + width * i for i in range(SHIFT_PARTS + 1)]
        joined = rows.where("not full").join(state, rows["s"].eqNullSafe(state["source"]))
        sums = joined.groupBy("source", "target", "low", "high", "shift", "off").agg(F.array(*(F.sum(F.col("size") * _copies(x)) for x in at)).alias("got"))
        points = sums.withColumn("p", F.expr(f"transform(got, (g, i) -> named_struct('off', abs(g - target), 'low', g < target, 'at', low + (high - low) / {SHIFT_PARTS} * i))"))
        best = points.withColumn("b", F.expr("array_min(transform(p, x -> named_struct('off', x.off, 'at', x.at)))"))
        best = best.withColumn("new_low", F.expr("coalesce(array_max(transform(filter(p, x -> x.low), x -> x.at)), low)")).withColumn("new_high", F.expr("coalesce(array_min(transform(filter(p, x -> not x.low), x -> x.at)), high)"))
        better = F.col("b.off") < F.col("off")
        state = scratch.save(best.select("source", "target", F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.when(better, F.col("b.at")).otherwise(F.col("shift")).alias("shift"), F.when(better, F.col("b.off")).otherwise(F.col("off")).alias("off")), drop=[state])
    return state.select("source", "shift")
