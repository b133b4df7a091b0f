"""Where files go: sorting moves, exports, and undoing earlier moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright import constants as C
from filewright.config import RetentionPolicy
from filewright.functions import paths
from filewright.operators.naming import unique_names
from filewright.operators.policy import with_disposition
from filewright.operators.skew import after, before, scan
from filewright.session import cut_lineage

EXPORTED, SKIPPED = "exported", "skipped_never_export"
RESTORED, MISSING = "restored", "missing"


def existing_names(listing: DataFrame, root: str) -> DataFrame:
    """(category, name) of files directly inside a folder below ``root``."""
    rel = paths.relative(F.col("path"), root)
    parts = listing.select(F.split(rel, "/").alias("p")).where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("category"), F.col("p")[1].alias("name"))


def move_plan(
    plan: DataFrame, target: str, existing: DataFrame | None = None,
) -> DataFrame:
    """Destination below ``target/<category>/`` of each known file that is no junk."""
    rows = plan.where(~F.col("category").isin(C.UNKNOWN, C.JUNK)).withColumn("name", paths.basename(F.col("path")))
    named = unique_names(rows, existing)
    dest = paths.join(F.lit(target.rstrip("/")), F.col("category"), F.col("dest_name"))
    return named.withColumn("dest", dest).drop("name", "dest_name")


def move_log(moves: DataFrame, run_id: str, moved_at) -> DataFrame:
    """Log rows of applied moves, in plan order."""
    return moves.select(
        F.lit(run_id).alias("run_id"), F.col("seq"), F.col("path").alias("original"), F.col("dest").alias("new"),
        "category", F.lit(moved_at).cast("timestamp").alias("moved_at"))


def export_plan(
    plan: DataFrame, policy: RetentionPolicy, destination: str, existing: DataFrame | None = None,
) -> DataFrame:
    """Rows to keep with their destination, and barred ones as skipped."""
    keep = with_disposition(plan, policy).where(F.col("disposition") == C.KEEP)
    keep = keep.withColumn("name", paths.basename(F.col("path")))
    barred = policy.barred & {c for c, d in policy.assigned if d == C.KEEP}
    named = unique_names(keep.where("exportable") if barred else keep, existing)
    dest = paths.join(F.lit(destination.rstrip("/")), F.col("category"), F.col("dest_name"))
    out = named.withColumns({"dest": dest, "status": F.lit(EXPORTED)})
    if barred:
        skipped = keep.where(~F.col("exportable")).withColumns(
            {"dest": F.lit(None).cast("string"), "status": F.lit(SKIPPED)})
        out = out.unionByName(skipped, allowMissingColumns=True)
    return out.drop("name", "dest_name", "disposition", "never_export", "exportable")


def _reached(links: DataFrame) -> DataFrame:
    """(_turn, _found) from links (_turn, _next, _found): found is what a found one leads to.

    Pointers jump twice a round, so chains of 4 to the power of r links take r rounds. What a pointer skips has been told
    by then: before a jump over n links, every mark has gone n links.
    """
    state = links
    while not state.where(F.col("_next").isNotNull()).isEmpty():
        for _ in range(2):
            told = state.where("_found AND _next IS NOT NULL").select(F.col("_next").alias("_turn"), F.lit(True).alias("_told")).distinct()
            far = state.where("_next IS NOT NULL").select(F.col("_turn").alias("_next"), F.col("_next").alias("_far"))
            state = state.join(told, "_turn", "left").join(far, "_next", "left").select(
                "_turn", F.col("_far").alias("_next"), (F.col("_found") | F.coalesce("_told", F.lit(False))).alias("_found"))
        state = cut_lineage(state)
    return state.select("_turn", "_found")


def _steps(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries with ``_found``, whether a file is at their new place when their turn comes, ``_free``, whether
    nothing is at the original place then, and ``_passing``, whether a later turn takes the file on from there.

    Taking a file empties a place; putting one back fills it, for the next turn that takes from there. So a turn finds a file if
    none took from its place before and one is listed there, or if some turn that puts a file there since the last taking found its own: links
    from each turn to at most one other, which pointers follow. Looks back and ahead along a place are scans; a place may hold any share of the log.
    """
    present = listing.select(F.col("path").alias("_place")).distinct().withColumn("_listed", F.lit(True))
    turns = entries.select((-F.col("seq")).alias("_turn"), "original", "new")
    events = turns.select("_turn", F.explode(F.array(
        F.struct(F.col("new").alias("_place"), F.lit(0).alias("_put")), F.struct(F.col("original").alias("_place"), F.lit(1).alias("_put")))).alias("_e")).select(
        "_turn", "_e.*").join(present, "_place", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    taking = F.when(F.col("_put") == 0, F.col("_turn"))
    seen = scan(events, ["_place"], ["_turn", "_put"], {"_taken": before(taking), "_next": after(taking)})
    seen = cut_lineage(seen)
    links = seen.groupBy("_turn").agg(
        F.max(F.when(F.col("_put") == 1, F.col("_next"))).alias("_next"),
        F.max((F.col("_put") == 0) & F.col("_listed") & F.col("_taken").isNull()).alias("_found"))
    found = cut_lineage(_reached(cut_lineage(links)))
    # A file that is not found leaves both places as they are.
    told = seen.select("_turn", "_place", "_put", "_listed").join(found, "_turn")
    leaves = F.when(F.col("_put") == 0, 0).when(F.col("_found"), 1)
    around = scan(told, ["_place"], ["_turn", "_put"], {"_there": before(leaves), "_after": after(leaves)}).where("_put = 1")
    there = F.coalesce(F.col("_there") == 1, F.col("_listed"))
    # The next to change the place takes from it: then the file goes on.
    steps = around.select("_turn", "_found", (~there).alias("_free"), (~there & F.coalesce(F.col("_after") == 0, F.lit(False))).alias("_passing"))
    return cut_lineage(entries.withColumn("_turn", -F.col("seq")).join(steps, "_turn"))


def undo_plan(log: DataFrame, listing: DataFrame) -> DataFrame:
    """Where each logged move goes back to, latest move first.

    Moves are undone one after the other: a file taken back leaves its place free, one put back can be taken on by
    an earlier move. A file that is not at its new place by then is missing. One whose original place is taken, by a
    file or by a move undone before it, gets a numbered name; a place that becomes free between two moves that want
    it counts as taken for both.
    """
    steps = _steps(log.where(
        F.coalesce(F.col("new") != "", F.lit(False)) & F.coalesce(F.col("original") != "", F.lit(False))), listing)
    gone = steps.where(~F.col("_found")).withColumns(
        {"restored_to": F.lit(None).cast("string"), "status": F.lit(MISSING)})
    passing = steps.where("_found AND _passing").withColumns({"restored_to": F.col("original"), "status": F.lit(RESTORED)})
    back = steps.where("_found AND NOT _passing").withColumns({
        "_dir": paths.dirname(F.col("original")), "_name": paths.basename(F.col("original"))})
    # Of the places that hold a file now, those are free that the first to come back finds free.
    first = back.groupBy(F.col("original").alias("path")).agg(F.min_by("_free", "_turn").alias("_free")).where("_free")
    held = listing.select("path").distinct().join(first, "path", "left_anti")
    taken = held.select(paths.dirname(F.col("path")).alias("_dir"), paths.basename(F.col("path")).alias("_name"))
    named = unique_names(back, taken, "_dir", "_name", "_turn", "_restored_", "_to")
    at_root = F.col("_dir") == ""
    to = F.when(at_root & ~F.startswith("original", F.lit("/")), F.col("_to")).otherwise(
        F.concat_ws("/", "_dir", "_to"))
    restored = named.withColumns({"restored_to": to, "status": F.lit(RESTORED)})
    columns = [*log.columns, "restored_to", "status"]
    return restored.select(*columns).unionByName(gone.select(*columns)).unionByName(passing.select(*columns))


def undo_counts(undone: DataFrame) -> DataFrame:
    return undone.agg(
        F.count_if(F.col("status") == RESTORED).alias("restored"),
        F.count_if(F.col("status") == MISSING).alias("missing"))
