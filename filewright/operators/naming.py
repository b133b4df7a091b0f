"""Names that collide with nothing: ``a.pdf``, ``a_1.pdf``, ``a_2.pdf``, ...

Rows take their names one after the other in plan order, each the first name
that is still free. A *family* is the rows of one folder that want the same
name; its candidates are numbered slots, slot 0 being the name itself. A slot is
lost to a family when a file exists there, or when a *child* family, whose own
name is that slot (``a_1.pdf`` for ``a.pdf``), came first. Only a child's first
row matters for that: from then on the slot is taken, by whichever of the two.
So the j-th row of a family gets the j-th slot not lost when its turn comes.

A family of one row whose name meets no file and no other family has its name as
it is, and goes no further. For the others ranks, prefix sums and joins do the work, on
family and order alone; no group is ever gathered in one task. Which children come first is
read off each family's slots in ascending order, with one number carried from slot to slot. A child's loss of
its own name is known once its parent is done, so this takes one round for each
level of numbers in names (``a_1_1.pdf`` is of the second), however many rows and children there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions import paths
from filewright.operators.skew import rank_in_group, running_total
from filewright.session import cut_lineage

FAMILY = ["_folder", "_root", "_ext"]


def _family(df: DataFrame, folder: str, name: str) -> DataFrame:
    root, ext = paths.root_and_extension(F.col(name))
    return df.withColumns({"_folder": F.col(folder), "_root": root, "_ext": ext})


def _as_slot(df: DataFrame, separator: str) -> DataFrame:
    """Families (or files) whose name is a numbered slot of another: adds the
    parent's root as ``_parent`` and the ``_slot``; drops the others."""
    numbered = rf"(?s)^(.*){separator}([1-9][0-9]{{0,17}})\z"
    return (
        df.withColumn("_parent", F.regexp_extract("_root", numbered, 1))
        .withColumn("_slot", F.regexp_extract("_root", numbered, 2).try_cast("bigint"))
        .where(F.col("_slot").isNotNull() & (F.col("_parent") != ""))
    )


def _lost_to_files(existing: DataFrame, folder: str, name: str, separator: str) -> DataFrame:
    """Slots lost to existing files, for the family of that name and its parent."""
    files = _family(existing, folder, name).select(*FAMILY).distinct()
    own = files.select(*FAMILY, F.lit(0).cast("bigint").alias("_slot"))
    above = _as_slot(files, separator).select("_folder", F.col("_parent").alias("_root"), "_ext", "_slot")
    return own.unionByName(above)


def _children(families: DataFrame, own_lost: DataFrame | None, separator: str) -> DataFrame:
    """Child families whose parent may want their slot.

    A parent with one row and a free name never looks at another slot, so
    series such as ``scan_1``, ``scan_2`` next to one ``scan`` cost nothing.
    """
    child = _as_slot(families, separator).select(
        "_folder", "_ext", "_slot", F.col("_first").alias("_came"),
        F.col("_root").alias("_child"), F.col("_parent").alias("_root"))
    can_lose_name = _as_slot(families, separator).select(*FAMILY).withColumn("_numbered", F.lit(True))
    parent = families.join(can_lose_name, FAMILY, "left")
    needs_more = (F.col("_rows") > 1) | F.col("_numbered").isNotNull()
    if own_lost is not None:
        base = own_lost.where(F.col("_slot") == 0).select(*FAMILY).withColumn("_base_lost", F.lit(True))
        parent = parent.join(base, FAMILY, "left")
        needs_more = needs_more | F.col("_base_lost").isNotNull()
    parent = parent.where(needs_more).select(*FAMILY, "_rows")
    return child.join(parent, FAMILY)


def _level(root: Column, separator: str) -> Column:
    """How many numbers stand one after the other at the end of a name."""
    numbers = F.regexp_extract(root, rf"(?s)((?:{separator}[1-9][0-9]{{0,17}})*)\z", 1)
    return F.regexp_count(numbers, F.lit(separator)) if separator else F.lit(0)


def _walk(events: DataFrame) -> DataFrame:
    """(family, _slot, _child, _lost, _taken) of the children of families, from all their slots that may be lost.

    Of a family, row number ``_slot`` less the slots lost so far reaches a slot. It finds the slot lost to a child that came before
    that row, that is, one that at most as many rows were ahead of. Rows of a family stream past in order of slots; what is kept
    is the number lost.
    """
    columns = [*FAMILY, "_slot", "_child", "_ahead", "_rows"]

    def run(batches):
        import pyarrow as pa

        family, lost = None, 0
        for batch in batches:
            out = [[] for _ in range(7)]
            for folder, root, ext, slot, child, ahead, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if (folder, root, ext) != family:
                    family, lost = (folder, root, ext), 0
                if child is None:
                    lost += 1
                    continue
                turn = slot - lost
                is_lost = turn < rows and turn >= ahead
                for values, v in zip(out, (folder, root, ext, slot, child, is_lost, turn < ahead)):
                    values.append(v)
                lost += is_lost
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v, pa.string()) for v in out[:3]), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()),
                 *(pa.array(v, pa.bool_()) for v in out[5:])], [*columns[:5], "_lost", "_taken"])

    dealt = events.select(*columns).repartition(*FAMILY).sortWithinPartitions(*FAMILY, "_slot")
    return dealt.mapInArrow(run, "_folder string, _root string, _ext string, _slot long, _child string, _lost boolean, _taken boolean")


def _settle(children: DataFrame, rows: DataFrame, lost: DataFrame | None, seq: str, separator: str) -> DataFrame:
    """Slots lost in each family once parents and children agree."""
    if lost is not None:
        # A file that exists settles its slot for both families.
        children = children.join(lost, [*FAMILY, "_slot"], "left_anti")
    wanted = children.select(*FAMILY).distinct()
    # How many rows of the parent came before the child.
    both = rows.join(wanted, FAMILY, "left_semi").select(*FAMILY, F.col(seq).alias("_came"), F.lit(1).alias("_row")).unionByName(
        children.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    ahead = running_total(both, FAMILY, ["_came"], {"_ahead": F.col("_row")}).where("_row = 0").drop("_row")
    ahead = cut_lineage(ahead.withColumn("_level", _level(F.col("_root"), separator)))
    known = None if lost is None else lost.select(*FAMILY, "_slot")
    for level in sorted(r[0] for r in ahead.select("_level").distinct().collect()):
        here = ahead.where(F.col("_level") == level)
        events = here
        if known is not None:
            events = here.unionByName(known.join(here.select(*FAMILY).distinct(), FAMILY, "left_semi"), allowMissingColumns=True)
        done = cut_lineage(_walk(events))
        slots = done.where("_lost").select(*FAMILY, "_slot").unionByName(
            done.where("_taken").select("_folder", F.col("_child").alias("_root"), "_ext", F.lit(0).cast("bigint").alias("_slot")))
        known = slots if known is None else known.unionByName(slots)
    return known


def _skip_lost(ranked: DataFrame, lost: DataFrame, seq: str) -> DataFrame:
    """Slot of each row: its rank plus the lost slots it has to pass."""
    numbered = running_total(lost, FAMILY, ["_slot"], {"_nth": F.lit(1)})
    # The n-th lost slot (n from 0) has slot - n free ones before it: rows of
    # that rank and later pass it. Runs of lost slots become one weighted mark.
    marks = numbered.groupBy(*FAMILY, (F.col("_slot") - F.col("_nth") + 1).alias("_rank")).agg(
        F.count("*").alias("_weight"))
    affected = lost.select(*FAMILY).distinct()
    rows = ranked.join(affected, FAMILY, "left_semi").withColumn("_weight", F.lit(0).cast("bigint"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    passed = running_total(both, FAMILY, ["_rank", "_row"], {"_passed": F.col("_weight")})
    moved = passed.where(F.col("_row") == 1).withColumn("_slot", F.col("_rank") + F.col("_passed"))
    rest = ranked.join(affected, FAMILY, "left_anti").withColumn("_slot", F.col("_rank"))
    columns = [*ranked.columns, "_slot"]
    return moved.select(*columns).unionByName(rest.select(*columns))


def unique_names(
    plan: DataFrame, existing: DataFrame | None = None, folder: str = "category", name: str = "name",
    seq: str = "seq", separator: str = "_", out: str = "dest_name",
) -> DataFrame:
    """Add ``out``, a name no other row and no existing file of the folder has.

    ``seq`` is a unique whole number that gives the plan order. ``existing``
    has the columns ``folder`` and ``name``. The plan is written out first,
    since finding out which names meet reads it more than once.
    """
    stored = cut_lineage(_family(plan, folder, name))
    families = cut_lineage(stored.groupBy(*FAMILY).agg(F.count("*").alias("_rows"), F.min(seq).alias("_first")))
    lost = None
    if existing is not None:
        lost = _lost_to_files(existing, folder, name, separator)
        lost = cut_lineage(lost.join(families.select(*FAMILY), FAMILY, "left_semi").distinct())
    children = cut_lineage(_children(families, lost, separator))
    busy = families.where("_rows > 1").select(*FAMILY)
    if lost is not None:
        busy = busy.unionByName(lost.select(*FAMILY))
    meets = not children.isEmpty()
    if meets:
        busy = busy.unionByName(children.select(*FAMILY)).unionByName(children.select("_folder", F.col("_child").alias("_root"), "_ext"))
    rows = stored.select(*FAMILY, seq).join(busy.distinct(), FAMILY, "left_semi")
    ranked = rank_in_group(rows, FAMILY, seq, "_rank")
    if meets:
        lost = _settle(children, rows, lost, seq, separator).distinct()
    if lost is None:
        slotted = ranked.withColumn("_slot", F.col("_rank"))
    else:
        lost = cut_lineage(lost)
        slotted = _skip_lost(ranked, lost, seq)
    named = stored.join(slotted.select(seq, "_slot"), seq, "left")
    slot = F.coalesce("_slot", F.lit(0))
    return named.withColumn(out, numbered_name(F.col("_root"), F.col("_ext"), slot, separator)).select(*plan.columns, out)


def numbered_name(root: Column, ext: Column, slot: Column, separator: str = "_") -> Column:
    return F.when(slot == 0, F.concat(root, ext)).otherwise(F.concat(root, F.lit(separator), slot.cast("string"), ext))
