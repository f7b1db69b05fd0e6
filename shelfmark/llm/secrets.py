"""Secret scans with multipart linking, in native functions only.

Strong spans are reported as found. Weak candidates (an identifier, a secret, an endpoint) are reported only
where the parts that complete a credential stand within the same scope: few code points lie between them, or they
stand in the same block of settings. The interval join is a frame over positions: each part asks, where its scope ends,
how far the parts of the other roles that started before reach, so that no pairs are made and no length is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.texts import with_row

# Fixed patterns of the base scan: kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
# Weak candidates: kind, pattern, least length, what else the match must hold.
WEAK = [
    ("identifier", r"[A-Z0-9]{16,}", ["[A-Z]", "[0-9]"]),
    ("secret", r"[A-Za-z0-9+/_-]{32,}", ["[A-Z]", "[a-z]", "[0-9]"]),
    ("endpoint", r"""[a-z][a-z0-9+]*://[^\x00-\x20"'<>]+""", []),
]
KINDS = [kind for kind, *_ in BASE] + [kind for kind, *_ in WEAK]
# Code points between the end of a part and the start of another that may belong to one credential.
SCOPE = 200
# A block of settings is a run of lines with a name, ":" or "=" and one value; this matches the lines between blocks.
BETWEEN = (
    r"""(?md)^(?![\x20\t]*(?:-[\x20\t]+)?["']?[A-Za-z_][A-Za-z0-9_.-]{0,63}["']?[\x20\t]*[:=](?!//)[\x20\t]*"""
    r"""(?:"[^"\n]*+"|'[^'\n]*+'|[^\x20\t\r\n]*+)[,;]?[\x20\t]*(?:#.*)?\r?$).*(?:\n|\z)"""
)
LINE = len(KINDS)
# Patterns that a scan may need on all texts start from a cheap one: a run that is long enough.
LONG_HEX = r"[0-9a-f]{16,}"


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, holds: list[str], weak: bool) -> Column:
    """Array of (kind, number, before, length, good, weak): the text between matches, each match, whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zipped = F.arrays_zip(
        F.sequence(F.lit(1), F.size(found)).alias("number"), F.slice(between, 1, F.size(found)).alias("before"),
        found.alias("found"), judged.alias("judged"),
    )

    def one(item: Column) -> Column:
        good = F.length(item["judged"]) >= least
        for part in holds:
            good = good & item["found"].rlike(part)
        return F.struct(
            F.lit(LINE if kind == "line" else KINDS.index(kind)).alias("kind"), item["number"].alias("number"), item["before"].alias("before"),
            F.length(item["found"]).alias("length"), good.alias("good"), F.lit(weak).alias("weak"),
        )

    return F.when(text.rlike(pattern), F.transform(zipped, one))


def parts_of(text: Column) -> Column:
    """All matches of all kinds in a text, or an empty array."""
    none = F.expr("array()").cast("array<struct<kind:int,number:int,before:int,length:int,good:boolean,weak:boolean>>")
    # A short run of hex digits is never reported and moves no other match, so only long runs are cut out.
    base = [(kind, LONG_HEX if kind == "hex" else pattern, group, least) for kind, pattern, group, least in BASE]
    arrays = [_matches(text, kind, pattern, group, least, [], False) for kind, pattern, group, least in base]
    arrays += [_matches(text, kind, pattern, 0, 0, holds, True) for kind, pattern, holds in WEAK]
    return F.concat(*[F.coalesce(found, none) for found in arrays])


def with_lines(text: Column, parts: Column) -> Column:
    """``parts`` and the lines between blocks of settings; those matter to texts with several parts only."""
    several = F.size(F.filter(parts, lambda p: p["good"])) > 1
    lines = F.when(several, _matches(text, "line", BETWEEN, 0, 0, [], False))
    return F.when(lines.isNull(), parts).otherwise(F.concat(parts, lines))


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """One row per document: ``carry`` columns and ``spans``, an array of (start, kind, end, weak) by start, then kind.

    ``kind`` is a number into KINDS, positions are code points, the end is exclusive. Null and empty texts have no
    spans. Of weak candidates only those that overlap no strong span are kept, and of these an identifier beside a
    secret, a secret beside an identifier, an endpoint beside both: with at most ``scope`` code points between them, or
    in one block of settings. ``carry`` columns must be few and narrow: they
    travel with the rows. An empty table gives an empty result; repeated rows are scanned one by one.
    """
    carry = ["doc_id"] if carry is None else carry
    kept = {f"__{i}": F.col(c) for i, c in enumerate(carry)}
    rows = with_row(docs, "__row").select("__row", *[c.alias(n) for n, c in kept.items()], F.col(text).alias("__text"), parts_of(F.col(text)).alias("__found"))
    rows = rows.select("__row", *kept, with_lines(F.col("__text"), F.col("__found")).alias("__parts"))
    parts = rows.select("__row", *kept, F.explode_outer("__parts").alias("part")).repartition("__row").select("__row", *kept, "part.*")

    run = Window.partitionBy("__row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(run).cast("int")
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    # Kinds by role; a match that fails its test keeps its place in the running sums but plays no part.
    counts = F.coalesce(F.col("good") & (F.col("kind") != LINE), F.lit(False))
    identifier = counts & F.col("kind").isin(KINDS.index("access"), KINDS.index("identifier"))
    secret = counts & F.col("kind").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("secret"))
    strong = counts & ~F.col("weak")
    by_start = Window.partitionBy("__row").orderBy("start")
    backwards = Window.partitionBy("__row").orderBy(F.desc("start"))
    # Each part is two rows: where it starts, and where its scope ends. Starts come first where both meet.
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("asks")), F.struct((F.col("end") + scope).alias("at"), F.lit(1).alias("asks")))
    events = placed.withColumns({"line": F.col("kind") == LINE, "id": identifier, "secret": secret, "event": F.explode(ends)})
    until = Window.partitionBy("__row").orderBy("event.at", "event.asks").rangeBetween(Window.unboundedPreceding, 0)
    reach = lambda role: F.max(F.when(F.col(role) & (F.col("event.asks") == 0), F.col("end"))).over(until)
    near = lambda role: F.coalesce(F.col(f"{role}_reach") >= F.col("start") - scope, F.lit(False))
    asked = events.withColumns({"id_reach": reach("id"), "secret_reach": reach("secret")}).where("event.asks = 1")
    # Blocks are numbered by the lines between them; a part on such a line is in none.
    before = Window.partitionBy("__row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    lines = asked.withColumns({"block": F.sum(F.col("line").cast("int")).over(before), "line_end": F.max(F.when(F.col("line"), F.col("end"))).over(before)})
    in_block = ~F.col("line") & (F.coalesce("line_end", F.lit(0)) <= F.col("start"))
    block = Window.partitionBy("__row", "block", "in_block")
    held = lambda role: F.col("in_block") & F.max(role).over(block)
    linked = lines.withColumn("in_block", in_block).withColumns({"ids": near("id") | held("id"), "secrets": near("secret") | held("secret")}).withColumns(
        {
            "strong_until": F.max(F.when(strong, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0)),
            "strong_from": F.min(F.when(strong, F.col("start"))).over(backwards.rangeBetween(Window.unboundedPreceding, 0)),
        }
    )
    free = (F.coalesce("strong_until", F.lit(0)) <= F.col("start")) & (F.coalesce("strong_from", F.col("end")) >= F.col("end"))
    kind = F.col("kind")
    completed = (
        F.when(kind == KINDS.index("identifier"), F.col("secrets"))
        .when(kind == KINDS.index("secret"), F.col("ids"))
        .otherwise(F.col("ids") & F.col("secrets"))
    )
    reported = strong | (counts & F.col("weak") & free & completed)
    span = F.when(reported, F.struct("start", "kind", "end", "weak"))
    grouped = linked.groupBy("__row").agg(*[F.first(n).alias(n) for n in kept], F.sort_array(F.collect_list(span)).alias("spans"))
    return grouped.select(*[F.col(n).alias(c) for n, c in zip(kept, carry)], "spans")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; overlapping spans become one.

    Texts without spans stay as they are, null ones too. Texts and spans meet by row number, so ``docs`` must be a
    scan of stored files.
    """
    found = scan(with_row(docs, "__at"), text, ["__at"]).where(F.size("spans") > 0)
    # Each span opens a mask where it starts behind all spans before it; text is kept from there to the next opening.
    spans = found.select("__at", F.explode("spans").alias("s")).select("__at", "s.start", "s.end")
    before = Window.partitionBy("__at").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(-1))
    chained = spans.withColumn("opens", (F.col("start") >= reach).cast("int"))
    run = Window.partitionBy("__at").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = chained.withColumn("n", F.sum("opens").over(run)).groupBy("__at", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    masks = merged.groupBy("__at").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__masks"))
    starts, ends = F.col("__masks.start"), F.col("__masks.end")
    froms = F.concat(F.array(F.lit(0)), ends)
    untils = F.concat(starts, F.array(F.length(text)))
    pieces = F.zip_with(froms, untils, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    cleaned = F.when(F.col("__masks").isNull(), F.col(text)).otherwise(F.array_join(pieces, mask))
    joined = with_row(docs, "__at").join(masks, "__at", "left")
    return joined.withColumn(text, cleaned).drop("__at", "__masks")
