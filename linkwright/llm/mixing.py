"""Mixing sources to target weights (operator 2): Pfair scheduling, with DataFrame functions only.

Sources have whole numbers w as target weights, W their sum. A source's j-th block (from 0) may run from slot floor(j * W / w)
and must have run by slot ceil((j + 1) * W / w). One block runs a slot: of the released ones that with the earliest deadline,
ties by the order of sources. The weights' shares sum to one, so every deadline is met, and each source's count of blocks
differs from its due share by less than one block at any slot.

The schedule is as long as the data, so it is made in epochs of ``EPOCH`` slots that run side by side. An epoch has to know
which sources have a released block waiting at its start (one each at the most). Of unit jobs that are served by priority, the
ones left at the end of an epoch are those of the lowest priority that its slots can't hold, whatever waited before it. So
every epoch is first run as if nothing waited; its idle slots and what it leaves make a row, from which a fold over epochs
finds what waits at each start: the latest deadlines that exceed the idle slots. ``GROUP`` epochs are folded to one such row
again, so the last fold sees a row per ``EPOCH * GROUP`` blocks. Then every epoch is run with what waits.

The mix lasts as long as every source has blocks (``in_mix``); blocks beyond that have no slot. ``continued`` goes on with
them by their deadlines, without the sources that have run out, so that a rare source ends nothing.

Defined results: a null source is a source of its own, ``""`` another; repeated rows and ids get places of their own; a
null id sorts first; rows of sources that given weights leave out, or give no positive weight, have no slot and no due slot
and are not in the mix; an empty table gives an empty table. Weights that aren't whole numbers, or whose sum is above
``PARTS``, are rounded to parts of ``PARTS``, one at least; at 9 * 10 ** 9 blocks whole numbers of 64 bits end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.common import ranked, written

BLOCK, ALPHA, PARTS = 8, 0.8, 1_000_000_000
EPOCH, GROUP = 4096, 1000


def order_key(id_col: str) -> Column:
    """A fixed random order of documents within a source."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def whole(a: Column, b: Column) -> Column:
    """a // b of positive whole numbers, exact."""
    return F.call_function("div", a, b)


def released(slot: Column, w: Column, total: Column) -> Column:
    """How many of a source's blocks are released before a slot."""
    return whole(slot * w + total - 1, total)


def deadline(j: Column, w: Column, total: Column) -> Column:
    return whole((j + 1) * total + w - 1, w)


def target_weights(counts: DataFrame, weights: dict[str | None, float] | None, block: int, alpha: float) -> DataFrame:
    """One row: names and sizes in blocks of the sources in order, their weights w, the sum (total), and a slot by which one has run out.

    Without ``weights`` a source of n documents weighs n ** alpha.
    """
    weigh = F.pow(F.col("n").cast("double"), F.lit(alpha))
    if weights is not None:
        given = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        counts = counts.join(given.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").where("weight > 0")
        weigh = F.col("weight")
    sizes = counts.select("source", F.ceil(F.col("n") / block).alias("blocks"), F.round(weigh, 6).alias("w"))
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "w"))).alias("s"), F.sum("w").alias("sum")).where(F.size("s") > 0)  # as many as there are sources
    exact = F.forall("s", lambda x: x["w"] == F.floor(x["w"])) & (F.col("sum") <= PARTS)
    part = lambda x: F.greatest(F.lit(1).cast("long"), F.round(x["w"] / F.col("sum") * PARTS).cast("long"))
    parts = F.when(F.col("exact"), F.transform("s", lambda x: x["w"].cast("long"))).otherwise(F.transform("s", part))
    one = one.withColumn("exact", exact).select(F.col("s.source").alias("source"), F.col("s.blocks").alias("blocks"), parts.alias("w"))
    one = one.withColumn("total", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x))
    ends = F.array_min(F.zip_with("blocks", "w", lambda b, w: deadline(b, w, F.col("total"))))  # of the blocks that a source lacks
    return one.withColumn("slots", ends)


def item(values: str | Column, i: Column) -> Column:
    return F.element_at(values, i + 1)


def nobody() -> Column:
    return F.transform("w", lambda _: F.lit(0))


def run_epoch(waiting: Column) -> Column:
    """Of a row with w, total, all, lo and hi: the sources that run in the slots from lo to hi - 1 (-1: none), and blocks done by source.

    ``waiting`` has 1 for a source of which a block that was released before ``lo`` waits, else 0.
    """
    first = F.zip_with("w", waiting, lambda w, x: released(F.col("lo"), w, F.col("total")) - x)
    start = F.struct(first.alias("done"), F.array().cast("array<int>").alias("ran"))

    def step(state: Column, slot: Column) -> Column:
        may = F.filter("all", lambda i: item(state["done"], i) * F.col("total") < (slot + 1) * item("w", i))
        due = F.transform(may, lambda i: F.struct(deadline(item(state["done"], i), item("w", i), F.col("total")).alias("d"), i.alias("i")))
        pick = F.coalesce(F.array_min(due)["i"], F.lit(-1))
        done = lambda p: F.transform(state["done"], lambda d, i: d + (i == p).cast("long"))
        after = lambda p: F.struct(done(p).alias("done"), F.concat(state["ran"], F.array(p)).alias("ran"))
        return item(F.transform(F.array(pick), after), F.lit(0))  # an array of one holds the pick, so that it is found once a slot

    return F.aggregate(F.sequence("lo", F.col("hi") - 1), start, step)


def fold(parts: str, waiting: Column) -> Column:
    """Over array<struct<lo, hi, idle, left>>, in order: what waits at the end, idle slots, and what waits at the start of each part."""
    at = F.array().cast("array<struct<lo:bigint,waiting:array<int>>>")
    start = F.struct(waiting.alias("waiting"), F.lit(0).cast("long").alias("idle"), at.alias("starts"))
    total = F.col("total")

    def step(state: Column, x: Column) -> Column:
        pending = F.filter("all", lambda i: item(state["waiting"], i) == 1)
        over = F.greatest(F.lit(0).cast("long"), F.size(pending) - x["idle"])
        last = F.filter("all", lambda i: (item(x["left"], i) == 0) & (released(x["hi"], item("w", i), total) > released(x["lo"], item("w", i), total)))
        entry = lambda edge: lambda i: F.struct(deadline(released(edge, item("w", i), total) - 1, item("w", i), total).alias("d"), i.alias("i"))
        due = F.reverse(F.array_sort(F.concat(F.transform(pending, entry(x["lo"])), F.transform(last, entry(x["hi"])))))
        out = F.transform(F.slice(due, F.lit(1), over.cast("int")), lambda d: d["i"])
        left = item(F.transform(F.array(out), lambda o: F.transform(x["left"], lambda y, i: F.greatest(y, F.array_contains(o, i).cast("int")))), F.lit(0))
        idle = state["idle"] + F.greatest(F.lit(0).cast("long"), x["idle"] - F.size(pending))
        starts = F.concat(state["starts"], F.array(F.struct(x["lo"].alias("lo"), state["waiting"].alias("waiting"))))
        return F.struct(left.alias("waiting"), idle.alias("idle"), starts.alias("starts"))

    return F.aggregate(parts, start, step)


def schedule(plan: DataFrame, epoch: int | None = None, group: int | None = None) -> DataFrame:
    """The blocks that run in the plan's slots: (i, block, slot), i the number of the source."""
    epoch, group = epoch or EPOCH, group or GROUP
    spread = max(8, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    setting = plan.withColumn("all", F.sequence(F.lit(0), F.size("w") - 1)).select("w", "total", "all", "slots")
    epochs = setting.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(epoch).cast("long")))).withColumn("hi", F.least(F.col("lo") + epoch, "slots")).drop("slots")
    epochs = epochs.repartition(spread, "lo")
    alone = epochs.withColumn("r", run_epoch(nobody()))
    left = F.zip_with("w", "r.done", lambda w, d: (released(F.col("hi"), w, F.col("total")) - d).cast("int"))
    alone = written(alone.select("lo", "hi", F.size(F.filter("r.ran", lambda p: p < 0)).cast("long").alias("idle"), left.alias("left")))
    part = F.array_sort(F.collect_list(F.struct("lo", "hi", "idle", "left"))).alias("parts")
    few = F.broadcast(setting.drop("slots"))  # a row
    groups = alone.groupBy(whole(F.col("lo"), F.lit(epoch * group).cast("long")).alias("g")).agg(part).crossJoin(few)
    ends = [item("parts", F.lit(0))["lo"].alias("lo"), F.element_at("parts", -1)["hi"].alias("hi")]
    summed = groups.withColumn("f", fold("parts", nobody())).select(*ends, F.col("f.idle").alias("idle"), F.col("f.waiting").alias("left"))
    starts = lambda folded: folded.select(F.explode("f.starts").alias("s")).select("s.*")
    tops = starts(summed.agg(part).crossJoin(few).withColumn("f", fold("parts", nobody())))
    by_group = groups.withColumn("_lo", item("parts", F.lit(0))["lo"]).join(tops.withColumnRenamed("lo", "_lo"), "_lo")
    known = starts(by_group.withColumn("f", fold("parts", F.col("waiting"))))
    ran = epochs.join(known, "lo").repartition(spread, "lo").withColumn("r", run_epoch(F.col("waiting")))
    first = F.zip_with("w", "waiting", lambda w, x: released(F.col("lo"), w, F.col("total")) - x)
    rows = ran.select("lo", first.alias("first"), F.posexplode("r.ran").alias("at", "i"))
    nth = F.row_number().over(Window.partitionBy("lo", "i").orderBy("at")) - 1
    return rows.select("i", (item("first", F.col("i")) + nth).alias("block"), (F.col("lo") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, alpha: float = ALPHA, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with the columns _block (number within the source), _place (in the block), _due (the slot by which the block has to
    have run), _slot (the one in which it runs; null beyond the mix) and _in_mix."""
    rows = docs.withColumn("_source", F.col(source_col).cast("string")).withColumn("_key", order_key(id_col))
    counts = rows.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    plan = written(target_weights(counts, weights, block, alpha))
    each = plan.select(F.posexplode(F.arrays_zip("source", "blocks", "w")).alias("_i", "s"), F.col("total").alias("_total"))
    sources = each.select("_i", F.col("s.source").alias("_of"), F.col("s.blocks").alias("_blocks"), F.col("s.w").alias("_w"), "_total")
    runs = written(schedule(plan))  # a row a block, read twice
    # The mix ends with the first slot that runs a block which its source lacks.
    end = runs.join(F.broadcast(sources), F.col("i") == F.col("_i")).where(F.col("block") >= F.col("_blocks")).agg(F.min("slot").alias("_end"))
    # Documents are ranked within a source by md5, in buckets of its first three digits: a hot source spreads over 4096.
    placed = ranked(rows, ["_source"], [F.col("_key"), F.col(id_col)], F.substring("_key", 1, 3), "_rank")
    placed = placed.withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_place", (F.col("_rank") % block).cast("long"))
    placed = placed.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_of")), "left")  # a row a source
    runs = runs.crossJoin(F.broadcast(end)).where("slot < _end").select(F.col("i").alias("_i"), F.col("block").alias("_block"), F.col("slot").alias("_slot"))
    out = placed.join(runs, ["_i", "_block"], "left").withColumn("_due", deadline(F.col("_block"), F.col("_w"), F.col("_total")))
    return out.select(*docs.columns, "_block", "_place", "_due", "_slot", F.col("_slot").isNotNull().alias("_in_mix"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, with their own columns.

    Within a source the mix takes a prefix of the fixed random order, so a row a source, its last key, decides; texts are
    filtered where they are read and never shuffled. Rows with equal id and source are in the mix together.
    """
    ids = mix(docs.select(id_col, source_col), id_col=id_col, source_col=source_col, **options).where("_in_mix")
    key = F.struct(order_key(id_col).alias("k"), F.col(id_col).alias("i"))
    last = ids.groupBy(F.col(source_col).cast("string").alias("_of")).agg(F.max(key).alias("_last"))
    return docs.join(F.broadcast(last), F.col(source_col).cast("string").eqNullSafe(F.col("_of"))).where(key <= F.col("_last")).select(*docs.columns)


def continued(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All documents in the order of the mix, with their own columns; only sources that given weights leave out are not there.

    After the mix the sources that have blocks left go on by their deadlines, at their weights. Rows with equal id and source
    stand together. Places are found on ids alone, so texts pass one shuffle to their places and one to the order.
    """
    placed = mix(docs.select(id_col, source_col), id_col=id_col, source_col=source_col, **options).where(F.col("_due").isNotNull())
    first = F.min(F.struct(F.col("_slot").isNull().alias("beyond"), F.col("_slot"), F.col("_due"), F.col(source_col).cast("string").alias("source"), F.col("_place")))
    at = placed.groupBy(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_of")).agg(first.alias("_at"))
    own = docs.join(at, F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("_of")))
    return own.orderBy("_at").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """What the query op2 returns: doc_id, source, block, place, due, slot, in_mix."""
    out = mix(docs.select("doc_id", "source"))
    return out.select("doc_id", "source", *[F.col(f"_{c}").alias(c) for c in ("block", "place", "due", "slot", "in_mix")])
