"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Among all document rates between 0 and CAP that give every source its target number of words,
the ones closest to equal rates (least relative entropy) tilt exponentially with the
document's size: ``rate = min(CAP, exp(tilt * size / mean size of the source))``. The tilts are
the solution of a convex dual with one variable per source, found by Newton steps kept within a
shrinking bracket. The steps read a written table of (source, size, documents), not the documents,
and each is one grouped sum whose state is written.

Rates become copies by one shift per source: a document's copies are floor(rate), plus one
where its fixed draw lies below the fraction of its rate plus the shift. The words taken grow
with the shift, so a search over counted steps of it finds the shift whose words come closest
to the target. It is exact up to one step of DRAWS, that is, to about one document.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and share SHARE
percent of all words. No target exceeds CAP times its source's words; what is above is shared
again by weight, which is the water level of ``targets``.

Defined cases: a null or blank text has size 0, rate as its source's smallest, and takes no
words. A null source is a source of its own. A source without words has target 0. Rows
that repeat a doc_id share their draw. An empty table gives an empty result. Other columns are
ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.llm.support import materialize

CAP = 2
SHARE = 150
WEIGHTS = (3, 1, 2)
STEPS = 60
TOLERANCE = 1e-9
DRAWS = 1 << 20
FAN = 1 << 10  # parts that each pass of the search for the shift looks at

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(totals, share=SHARE, cap=CAP, weights=WEIGHTS):
    """(source, words, target) from (source, words): one row per source, so small windows.

    With sources ordered by cap * words / weight, those before the water level stop at their cap
    and the rest share what is left by weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("words") * float(cap))
    rows = rows.withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.sum("words").over(everything) * share / 100.0
    used = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    # the level if all sources before this one stop at their caps; the first that holds counts
    rows = rows.withColumn("water", (goal - used) / F.sum("weight").over(onward))
    held = F.when(F.col("water") <= F.col("level"), F.col("water"))
    rows = rows.withColumn("water", F.first(held, ignorenulls=True).over(everything))
    target = F.coalesce(F.least("most", F.col("weight") * F.col("water")), F.col("most"))
    return rows.select("source", "words", target.alias("target"))


def _rate(size, tilt, mean, cap=CAP):
    return f"least({cap}D, exp(least(50D, {tilt} * {size} / {mean})))"


def tilts(counted, wanted, cap=CAP, steps=STEPS):
    """(source, words, target, mean, tilt) for every source, from (source, size, n) counts.

    The dual of a source is solved on its own, all of them in the same grouped sums. A source at
    its cap gets the tilt at the end of the bracket, where all rates are CAP.
    """
    mean = counted.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(1))).alias("mean"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    state = wanted.join(mean, wanted["source"].eqNullSafe(mean["source"])).drop(mean["source"])
    # the bracket: at its upper end every document with words is at the cap
    state = state.withColumn("high", F.expr(f"coalesce(ln({cap}D) * mean / least_size, 0D)"))
    state = state.withColumn("low", F.lit(-700.0)).withColumn("tilt", F.lit(0.0)).withColumn("done", F.expr("target <= 0"))
    state = materialize(state.drop("least_size"), "tilt")
    for _ in range(steps):
        rows = counted.join(state.where("NOT done").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        rate = _rate("size", "tilt", "mean", cap)
        sums = rows.groupBy(F.col("s").alias("g")).agg(
            F.expr(f"sum(n * size * {rate})").alias("value"),
            F.expr(f"sum(IF(tilt * size / mean < ln({cap}D), n * size * (size / mean) * {rate}, 0D))").alias("slope"),
            F.count("*").alias("rows"),
        )
        state = state.join(sums, F.col("source").eqNullSafe(F.col("g")) & ~F.col("done"), "left")
        state = state.withColumn("gap", F.expr("value - target"))
        state = state.withColumn("low", F.expr("IF(gap < 0, tilt, low)")).withColumn("high", F.expr("IF(gap > 0, tilt, high)"))
        # at the end of the bracket the gap can be a rounding error below the cap
        state = state.withColumn("done", F.expr(f"done OR rows IS NULL OR abs(gap) <= {TOLERANCE} * target OR high - low <= 1e-14 * greatest(1D, abs(high))"))
        newton = F.expr("IF(slope > 0, tilt - gap / slope, high)")
        inside = newton.between(F.col("low"), F.col("high"))
        state = state.withColumn("next", F.when(inside, newton).otherwise(F.expr("(greatest(low, -64D) + high) / 2")))
        state = state.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).otherwise(F.col("next")))
        state = materialize(state.select("source", "words", "target", "mean", "low", "high", "tilt", "done"), "tilt")
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "words", "target", "mean", "tilt")


def shifts(drawn, wanted):
    """(source, shift, ...) that brings each source's words closest to its target.

    ``drawn``: (source, base, step, words): documents whose copies are ``base`` while the shift is
    at most ``step`` and one more beyond, with their words summed. Each pass splits the range of
    steps into FAN parts and goes on with the part that holds the target.
    """
    state = wanted.select("source", "target", F.lit(-DRAWS).cast("long").alias("from"), F.lit(0.0).alias("at"))
    fixed = drawn.groupBy(F.col("source").alias("g")).agg(F.sum(F.col("base") * F.col("words")).cast("double").alias("fixed"))
    state = state.join(fixed, F.col("source").eqNullSafe(F.col("g")), "left")
    state = materialize(state.select("source", "target", "from", F.coalesce("fixed", F.lit(0.0)).alias("at")), "shift")
    width = 2 * DRAWS
    while width > 1:
        part = max(1, width // FAN)
        s = state.select(F.col("source").alias("g"), "from")
        rows = drawn.join(s, F.col("source").eqNullSafe(F.col("g"))).where(f"step >= `from` AND step < `from` + {width}")
        cell = F.floor((F.col("step") - F.col("from")) / part)
        sums = rows.groupBy("g", cell.alias("cell")).agg(F.sum("words").alias("words"))
        run = Window.partitionBy("g").orderBy("cell")  # at most FAN rows each
        sums = sums.withColumn("upto", F.sum("words").over(run))
        s = state.select(F.col("source").alias("h"), "target", F.col("at").alias("start"))
        sums = sums.join(s, F.col("g").eqNullSafe(F.col("h")))
        within = sums.where("start + upto <= target").groupBy("g").agg(F.max("upto").alias("words"), F.max("cell").alias("cell"))
        beyond = sums.where("start + upto > target").groupBy(F.col("g").alias("k")).agg(F.min("cell").alias("over"))
        state = state.join(within, F.col("source").eqNullSafe(F.col("g")), "left").join(beyond, F.col("source").eqNullSafe(F.col("k")), "left")
        # the part that passes the target; if none does, the part after the last one
        state = state.select(
            "source",
            "target",
            F.expr(f"`from` + coalesce(over, {-(-width // part)}) * {part}").alias("from"),
            F.expr("at + coalesce(words, 0)").alias("at"),
        )
        state = materialize(state, "shift")
        width = part
    # steps below "from" are taken; the step itself too if that comes closer
    edge = drawn.withColumnRenamed("source", "g").join(state, F.col("source").eqNullSafe(F.col("g")) & (F.col("step") == F.col("from")))
    edge = edge.groupBy("g").agg(F.sum("words").alias("more"))
    state = state.join(edge, F.col("source").eqNullSafe(F.col("g")), "left")
    closer = F.expr("more IS NOT NULL AND at + more - target < target - at")
    return state.select("source", F.when(closer, F.col("from") + 1).otherwise(F.col("from")).alias("shift"))


def _placed(rows, share, cap, weights):
    """``rows`` (doc_id, source, size, ...) with words, target, rate and copies in a struct ``mix``.

    Only tables with a row per source, per (source, size) or per step are written or grouped;
    the rows themselves are read three times and never shuffled.
    """
    counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counted")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    wanted = materialize(targets(totals, share, cap, weights), "targets")
    solved = materialize(tilts(counted, wanted, cap), "solved")

    # one row per source: the optimizer broadcasts it while it is small
    sources = F.col("source").eqNullSafe(F.col("state.source"))
    rated = rows.join(solved.select(F.struct("*").alias("state")), sources)
    tilted = _rate("size", "state.tilt", "state.mean", cap)
    rate = F.expr(
        f"IF(state.target <= 0, 0D, IF(state.target >= {cap}D * state.words, {cap}D, {tilted}))"
    )
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "size"), F.lit(DRAWS))
    rated = rated.withColumn("rate", rate).withColumn("base", F.floor("rate"))
    # one copy more while draw < fraction + shift, so for every shift above this step
    step = F.ceil(draw - (F.col("rate") - F.col("base")) * DRAWS).cast("long")
    free = (F.col("base") < cap) & (F.col("size") > 0) & (F.col("rate") > 0)
    rated = rated.withColumn("step", F.when(free, step))
    drawn = rated.groupBy("source", "base", "step").agg(F.sum("size").alias("words"))
    shift = materialize(shifts(materialize(drawn, "drawn"), wanted), "shifts")
    moved = F.col("source").eqNullSafe(F.col("moved.source"))
    rated = rated.join(shift.select(F.struct("*").alias("moved")), moved)
    copies = F.col("base") + F.when(F.col("step") < F.col("moved.shift"), 1).otherwise(0)
    facts = F.struct(
        F.col("state.words").alias("words"),
        F.col("state.target").alias("target"),
        "rate",
        copies.cast("int").alias("copies"),
    )
    return rated.withColumn("mix", facts).drop("state", "moved", "rate", "base", "step")


def mixture(docs, share=SHARE, cap=CAP, weights=WEIGHTS):
    """(doc_id, size, source_size, target, rate, copies, taken) for every row of ``docs``
    (doc_id, text, source)."""
    sized = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    taken = F.col("mix.copies") * F.col("size")
    return _placed(sized, share, cap, weights).select(
        "doc_id",
        "size",
        F.col("mix.words").alias("source_size"),
        F.col("mix.target").alias("target"),
        F.col("mix.rate").alias("rate"),
        F.col("mix.copies").alias("copies"),
        taken.cast("long").alias("taken"),
    )


def repeated(docs, share=SHARE, cap=CAP, weights=WEIGHTS):
    """The whole rows of ``docs``, each as often as its copies say."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"),
        F.col("doc_id"),
        F.col("source"),
        size_of(F.col("text")).alias("size"),
    )
    mixed = _placed(rows, share, cap, weights)
    often = F.expr("CASE WHEN mix.copies > 0 THEN array_repeat(0, mix.copies) END")
    return mixed.select("kept", F.explode(often).alias("copy")).select("kept.*")
