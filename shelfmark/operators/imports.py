"""Bringing new files into a catalog: duplicates, name clashes, conversions still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .skew import HOT_ROWS, hot_keys, rank_in_group, skew_join
from ..session import checkpointed, stored

GROUP = ["__stem", "__ext"]
# Closed places told one by one in a row; ranks that share a task. Only speed rests on them.
CLOSED_BLOCK = 512
RANK_BLOCK = 65_536


def _first_per_hash(files: DataFrame, order: list[str]) -> DataFrame:
    return files.groupBy("hash").agg(F.min(F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("copies"))


def with_survivor(files: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each file with the name of the first file of equal content and a duplicate flag.

    ``order`` starts with the name and must be unique. Equal content may make up much of the
    table, so the survivor comes from a pre-aggregated minimum, joined back with salting.
    """
    joined = skew_join(files, _first_per_hash(files, order), ["hash"], "left", order, hot_rows)
    own = F.struct(*order)
    # A file without a hash could not be read; it has no copies.
    return joined.withColumn("survivor", F.col("__first")[order[0]]).withColumn(
        "is_duplicate", F.coalesce(own != F.col("__first"), F.lit(False))
    ).drop("__first")


def dedupe_exact(files: DataFrame, order: list[str]) -> DataFrame:
    """The first file per content hash, by aggregation alone (no join, no per-group sort).

    Files without a hash could not be read and are left out.
    """
    best = files.where("hash is not null").groupBy("hash").agg(F.min_by(F.struct(*files.columns), F.struct(*order)).alias("kept"))
    return best.select("kept.*")


def duplicate_report(files: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every dropped copy with the name of the file that stands for it."""
    flagged = with_survivor(files, order, hot_rows)
    return flagged.where("is_duplicate").select(*order, "hash", "survivor")


# ---- name clashes -------------------------------------------------------------------------
#
# Files take names in order; a taken name sends a file on to stem-1, stem-2, ... Each file thus
# has a list of wishes and an overall priority, and the outcome is the only stable assignment.
# Files with one target share one list, so within that group the n-th file simply gets the n-th
# name that is open to it. Names are closed by files already in the destination, or by a file of
# another group with priority. The latter are found in rounds: all groups choose, every loser's
# group learns the names it lost, and chooses again. A lost name stays lost, so rounds end by
# themselves, and only groups whose names can meet take part.


def _numbered(stem: Column) -> tuple[Column, Column]:
    """A stem read as base and copy number (null if it has none)."""
    pattern = r"(?s)^(.*)-([1-9][0-9]{0,17})$"
    number = F.regexp_extract(stem, pattern, 2)
    return F.regexp_extract(stem, pattern, 1), F.when(number != "", number.cast("bigint"))


def _claims(names: DataFrame) -> DataFrame:
    """The groups in whose list each name of (__stem, __ext, ...) occurs, with its place there."""
    rest = [c for c in names.columns if c not in GROUP]
    base, number = _numbered(F.col("__stem"))
    bare = names.withColumn("__k", F.lit(0).cast("bigint"))
    numbered = names.withColumn("__base", base).withColumn("__k", number).where(F.col("__k").isNotNull())
    return bare.unionByName(numbered.select(F.col("__base").alias("__stem"), "__ext", *rest, "__k"))


def _jumps(closed: DataFrame, hot_rows: int) -> DataFrame:
    """Per group, from which rank (__at) on how many names in all (__skipped) are passed over.

    ``closed`` has places (group, __k, __from), closed to ranks from ``__from`` on. With s places
    skipped before it, place k comes up at rank k - s: lower ranks than ``__from`` still take it,
    others skip it. Places stand in blocks of their order. A block needs of those before it only
    how many they skip: all of theirs is the first guess, and blocks are gone through again until
    no count changes, which the first blocks of a group reach first.
    """
    numbered = rank_in_group(closed, GROUP, [("__k", True)], "__i", hot_rows)
    cut = numbered.withColumn("__block", F.floor((F.col("__i") - 1) / CLOSED_BLOCK))
    places = F.sort_array(F.collect_list(F.struct("__k", "__from"))).alias("__closed")
    blocks = stored(cut.groupBy(*GROUP, "__block").agg(places), "closed-places")
    key = GROUP + ["__block"]
    in_order = Window.partitionBy(*GROUP).orderBy("__block")
    if blocks.where("__block > 0").isEmpty():
        alone = _skipped_places(F.col("__closed"), F.lit(0).cast("bigint"))
        return _furthest(blocks.select(*GROUP, F.inline(alone)))
    counts = blocks.select(*key, F.size("__closed").cast("bigint").alias("__skips"))
    while True:
        before = F.sum("__skips").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        begun = counts.select(
            *key, "__skips", F.coalesce(before, F.lit(0)).alias("__before"),
            F.lead("__block").over(in_order).isNotNull().alias("__followed"),
        )
        told = stored(
            blocks.join(begun, key).withColumn("__jumps", _skipped_places(F.col("__closed"), F.col("__before"))).drop("__closed"),
            "skipped-places",
        )
        if told.where(F.col("__followed") & (F.size("__jumps") != F.col("__skips"))).isEmpty():
            break
        counts = told.select(*key, F.size("__jumps").cast("bigint").alias("__skips"))
    return _furthest(told.select(*GROUP, F.inline("__jumps")))


def _skipped_places(places: Column, before: Column) -> Column:
    """The places of one block that are skipped: the rank that comes upon each, and how many are skipped with it."""
    def step(state: Column, place: Column) -> Column:
        reached = place["__k"] - state["skipped"]
        jump = F.struct(reached.alias("__at"), (state["skipped"] + 1).alias("__skipped"))
        further = F.struct((state["skipped"] + 1).alias("skipped"), F.concat(state["jumps"], F.array(jump)).alias("jumps"))
        return F.when(place["__from"] <= reached, further).otherwise(state)

    start = F.struct(before.alias("skipped"), F.array().cast("array<struct<__at:bigint,__skipped:bigint>>").alias("jumps"))
    return F.aggregate(places, start, step, lambda s: s["jumps"])


def _present_jumps(closed: DataFrame, hot_rows: int) -> DataFrame:
    """As ``_jumps`` for places closed to every rank: all are skipped, so their numbers say it."""
    numbered = rank_in_group(closed, GROUP, [("__k", True)], "__i", hot_rows)
    return _furthest(numbered.select(*GROUP, (F.col("__k") - F.col("__i") + 1).alias("__at"), F.col("__i").alias("__skipped")))


def _furthest(jumps: DataFrame) -> DataFrame:
    return jumps.groupBy(*GROUP, "__at").agg(F.max("__skipped").alias("__skipped"))


def _choose(files: DataFrame, jumps: DataFrame | None) -> DataFrame:
    """Each file's place in its group's list of names: its rank and what is skipped up to it.

    Files and jumps stand in one order of ranks, cut into blocks, so that no group lies in one
    task; each block is told what the blocks before it skip.
    """
    if jumps is None:
        return files.withColumn("__place", F.col("__rank"))
    key = GROUP + ["__block"]

    def block(rank: str) -> Column:
        return F.floor(F.col(rank) / RANK_BLOCK)

    steps = jumps.withColumn("__block", block("__at"))
    # Nothing comes before the first block.
    later = files.where(F.col("__rank") >= RANK_BLOCK)
    asked = later.select(*GROUP, block("__rank").alias("__block"), F.lit(None).cast("bigint").alias("__skipped"))
    ends = asked.unionByName(steps.select(*key, "__skipped")).groupBy(*key).agg(F.max("__skipped").alias("__skipped"))
    earlier = Window.partitionBy(*GROUP).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    begun = ends.select(*key, F.lit(-1).cast("bigint").alias("__rank"), F.max("__skipped").over(earlier).alias("__skipped"))
    rows = files.withColumn("__block", block("__rank")).withColumn("__file", F.lit(True))
    for others in (steps.withColumnRenamed("__at", "__rank"), begun):
        rows = rows.unionByName(others, allowMissingColumns=True)
    # Rows of one rank count together: a file sees the jump at its own rank.
    so_far = F.max("__skipped").over(Window.partitionBy(*key).orderBy("__rank"))
    placed = rows.withColumn("__place", F.col("__rank") + F.coalesce(so_far, F.lit(0))).where("__file")
    return placed.drop("__block", "__skipped", "__file")


def _chosen_stem() -> Column:
    suffix = F.concat(F.lit("-"), F.col("__place").cast("string"))
    return F.when(F.col("__place") == 0, F.col("__stem")).otherwise(F.concat("__stem", suffix))


def _lost(chosen: DataFrame, order: list[str]) -> DataFrame:
    """Names closed to a group from its first losing rank on, after one round of choices."""
    own = F.struct(*order)
    taken = chosen.select(
        _chosen_stem().alias("__taken"), "__ext", F.struct(own.alias("at"), F.col("__stem").alias("by")).alias("__who"),
        "__stem", "__rank", "__place",
    )
    holders = taken.groupBy("__taken", "__ext").agg(F.min("__who").alias("__holder"))
    beaten = taken.join(holders, ["__taken", "__ext"]).where(F.col("__who.at") > F.col("__holder.at"))
    # The first loser of a group cannot have any name that is held by a still earlier file, and
    # no later file of the group can: whole series of taken names are skipped in one round.
    losers = beaten.groupBy(*GROUP).agg(F.min("__rank").alias("__from"), F.min("__who.at").alias("__late"))
    held = _claims(holders.withColumnRenamed("__taken", "__stem"))
    foreign = held.where(F.col("__holder.by") != F.col("__stem"))
    out_of_reach = foreign.join(losers, GROUP).where(F.col("__holder.at") < F.col("__late"))
    lost = beaten.select(*GROUP, F.col("__place").alias("__k"), F.col("__rank").alias("__from"))
    return lost.unionByName(out_of_reach.select(*GROUP, "__k", "__from"))


def resolve_name_clash(
    files: DataFrame,
    order: list[str],
    existing: DataFrame | None = None,
    target: str = "target",
    out: str = "final_name",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the free name each file gets, as if files were written one by one in ``order``.

    ``existing`` has one column ``name``: what the destination already holds.
    """
    # A generator of one row: what is asked of the parts does not repeat the work of cleaning names.
    parts = F.struct(N.stem_of(F.col(target)).alias("__stem"), N.extension_of(F.col(target)).alias("__ext"))
    named = files.select("*", F.inline(F.array(parts)))
    hot = (hot_keys(named, GROUP, hot_rows),)
    ranked = rank_in_group(named, GROUP, [(c, True) for c in order], "__rank", hot_rows, known=hot)
    ranked = checkpointed(ranked.withColumn("__rank", F.col("__rank") - 1))
    root = F.regexp_replace("__stem", r"(-[1-9][0-9]{0,17})+$", "")

    present = None
    if existing is not None:
        taken = existing.select(N.stem_of(F.col("name")).alias("__stem"), N.extension_of(F.col("name")).alias("__ext"))
        closed = _claims(taken.distinct()).withColumn("__from", F.lit(0).cast("bigint"))
        targets = ranked.select(*GROUP).distinct()
        present = stored(closed.join(targets, GROUP, "left_semi"), "names-in-place")

    groups = ranked.select(*GROUP).distinct().withColumn("__root", root)
    meeting = groups.groupBy("__root", "__ext").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    contested = groups.join(meeting, ["__root", "__ext"], "left_semi").select(*GROUP)
    if contested.isEmpty():
        return _finish(_choose(ranked, None if present is None else _present_jumps(present, hot_rows)), out)

    # Every round reads the players several times: they are stored, with the few columns rounds need.
    places = ranked.select(*order, *GROUP, "__rank")
    players = stored(skew_join(places, contested, GROUP, "left_semi", order, known=hot), "contested-names")
    jumps = None if present is None else stored(_present_jumps(present, hot_rows), "jumps")
    lost, state = None, None
    while True:
        news = _lost(_choose(players, jumps), order)
        known = news if lost is None else news.unionByName(lost)
        merged = stored(known.groupBy(*GROUP, "__k").agg(F.min("__from").alias("__from")), "lost-names")
        # Rows are only added and ranks only fall, so equal totals mean that nothing changed.
        before, state = state, merged.agg(F.count(F.lit(1)), F.sum("__from")).first()
        if state[0] == 0 or state == before:
            break
        lost = merged
        closed = lost if present is None else lost.unionByName(present)
        jumps = stored(_jumps(closed, hot_rows), "jumps")
    return _finish(_choose(ranked, jumps), out)


def _finish(chosen: DataFrame, out: str) -> DataFrame:
    return chosen.withColumn(out, F.concat(_chosen_stem(), F.col("__ext"))).drop(*GROUP, "__rank", "__place")


def existing_duplicate(files: DataFrame, existing: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flag files whose bytes already lie under the target name or the numbered names that follow it.

    ``existing`` has name and hash. Only an unbroken series from the bare target counts: a file
    walks past taken names and stops at the first free one.
    """
    parts = existing.select(
        N.stem_of(F.col("name")).alias("__stem"), N.extension_of(F.col("name")).alias("__ext"), "hash"
    ).distinct()
    ranked = rank_in_group(_claims(parts), GROUP, [("__k", True), ("hash", True)], "__i", hot_rows)
    series = ranked.where(F.col("__k") == F.col("__i") - 1).select(*GROUP, "hash").distinct()
    named = files.withColumn("__stem", N.stem_of(F.col("target"))).withColumn("__ext", N.extension_of(F.col("target")))
    flagged = skew_join(
        named, series.withColumn("in_place", F.lit(True)), GROUP + ["hash"], "left", order, hot_rows
    )
    return flagged.withColumn("in_place", F.coalesce("in_place", F.lit(False))).drop(*GROUP)


# ---- the import as a whole ----------------------------------------------------------------


def clean_target(name: Column, trim_numbers: bool = True, normalize: bool = True) -> Column:
    if trim_numbers:
        name = N.trim_numbered_name(name)
    return N.normalize_filename(name) if normalize else name


def import_plan(
    files: DataFrame,
    existing: DataFrame | None = None,
    dedupe: bool = True,
    trim_numbers: bool = True,
    normalize: bool = True,
    types: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What an import would do with each file of (name, hash, ...): nothing is written.

    Columns: name, file_id, hash, target, final_name, status, renamed, survivor. ``existing``
    has name and hash of the destination's files. A null hash marks an unreadable file.
    """
    order = ["name", "file_id"]
    rows = files.where(N.has_extension(F.col("name"), types or N.IMPORT_TYPES)).select(*order, "hash")
    if dedupe:
        rows = with_survivor(rows, order, hot_rows).drop("copies")
    else:
        rows = rows.withColumn("survivor", F.lit(None).cast("string")).withColumn("is_duplicate", F.lit(False))
    rows = rows.withColumn("target", clean_target(F.col("name"), trim_numbers, normalize))
    if existing is not None:
        rows = existing_duplicate(rows, existing, order, hot_rows)
    else:
        rows = rows.withColumn("in_place", F.lit(False))
    status = (
        F.when(F.col("hash").isNull(), "error")
        .when(F.col("is_duplicate"), "duplicate")
        .when(F.col("in_place"), "duplicate_existing")
        .otherwise("imported")
    )
    rows = rows.withColumn("status", status).drop("is_duplicate", "in_place")
    rows = rows.withColumn(
        "renamed", F.col("status").isin("imported", "duplicate_existing") & (F.col("target") != F.col("name"))
    )
    rows = checkpointed(rows)
    taken = None if existing is None else existing.select("name")
    written = resolve_name_clash(rows.where("status = 'imported'"), order, taken, hot_rows=hot_rows)
    others = rows.where("status <> 'imported'").withColumn("final_name", F.lit(None).cast("string"))
    return written.unionByName(others)


def import_summary(plan: DataFrame) -> DataFrame:
    skipped = F.col("status").isin("duplicate", "duplicate_existing")
    return plan.agg(
        F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(skipped).alias("duplicates"),
        F.count_if("renamed").alias("renamed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def import_errors(plan: DataFrame) -> DataFrame:
    return plan.where("status = 'error'").select(F.col("name").alias("file"), F.lit("unreadable").alias("error"))


def _split(files: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Originals and converted files, each with its stem."""
    ending = F.lower(N.extension_of(F.col("filename")))
    stemmed = files.withColumn("stem", N.stem_of(F.col("filename")))
    originals = stemmed.where(ending.isin(["." + t for t in types if t != "webp"]))
    return originals, stemmed.where(ending == ".webp")


def pending_conversions(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Originals that have no converted file under their own stem yet."""
    originals, _ = _split(files, types or N.CONVERT_TYPES)
    made = files.select(F.col("filename").alias("converted_name"))
    wanted = originals.withColumn("converted_name", F.concat("stem", F.lit(".webp")))
    return wanted.join(made, "converted_name", "left_anti")


def orphaned_originals(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Originals whose converted file exists: what a cleanup would delete."""
    originals, converted = _split(files, types or N.CONVERT_TYPES)
    return originals.join(converted.select("stem"), "stem", "left_semi")


def conversion_savings(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Per original, how much smaller its converted file is, in percent."""
    originals, converted = _split(files, types or N.CONVERT_TYPES)
    sizes = converted.groupBy("stem").agg(F.max("size").alias("converted_size"))
    joined = originals.join(sizes, "stem")
    saved = F.when(F.col("size") > 0, F.round((1 - F.col("converted_size") / F.col("size")) * 100, 1))
    return joined.withColumn("saved_percent", saved)


def total_savings(savings: DataFrame) -> DataFrame:
    whole, now = F.sum("size"), F.sum("converted_size")
    return savings.agg(
        F.count(F.lit(1)).alias("files"), F.round((1 - now / whole) * 100, 1).alias("saved_percent")
    )
