"""Main text of pages by differencing with the nearest addresses.

A page is cut into lines, one per block of markup. Each page is paired with the pages before and after it in order of
address within its host; lines are aligned by longest common subsequence, and lines shared with either of them are
deleted: what pages of a host have in common is menus, notices and the like. Markup is a vote beside the alignment:
lines that it names as such things are deleted, too, and lines that it names as the article are never deleted, so that
copied articles stay whole.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import as_bytes, slices, with_row

# Fixed by HTML: elements without content, elements whose end tags may be left out, elements that start a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements, roles and words of class and id that mark what is not the main text.
LEFT_OUT = frozenset("head title script style noscript template nav footer aside form iframe object svg button select textarea dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = regex.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|nav\w*|menu|"
    r"breadcrumbs?|sidebar|footer|masthead|comments?|disqus|replies|respond|share|sharing|social|related|widget|toolbar|skip)(?:$|[\s_-])"
)
MAIN = frozenset(("article", "main"))
# How an element is left out: by words of its class or id, or by what it is.
NAMED, FIRM = 1, 2
# Headers outside an article; inside, they hold its title and stay.
HEADER = regex.compile(r"(?:^|[\s_-])header(?:$|[\s_-])")
SPACE = regex.compile(r"\s+")
# Addresses per range from which the bounds of ranges are taken.
PER_RANGE = 100


class Lines(HTMLParser):
    """Lines of a page: (text, whether it stands in the article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []
        self.lines: list[tuple[str, bool]] = []
        self.held: list[str] = []

    def _state(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def _break(self) -> None:
        text = SPACE.sub(" ", "".join(self.held)).strip()
        self.held.clear()
        if text:
            self.lines.append((text, self._state()[1]))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._break()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        if tag in CLOSED_BY_NEXT:
            self._close_left_open(tag)
        left_out, main = self._state()
        named = {k: (v or "").lower() for k, v in attrs}
        inside = main or tag in MAIN or named.get("role") in MAIN
        labels = [named.get(k, "") for k in ("class", "id")] if tag not in ("html", "body", "main") else []
        marked = any(MARKS.search(x) for x in labels) or (not main and (tag == "header" or any(map(HEADER.search, labels))))
        hidden = "hidden" in named or named.get("aria-hidden") == "true"
        own = tag in LEFT_OUT or named.get("role") in ROLES or marked or hidden
        # An article inside an element that only a name marks is left to the alignment: layouts are named after their parts.
        if left_out == NAMED and not own and (tag in MAIN or named.get("role") in MAIN):
            left_out, inside = 0, False
        unnamed = tag in LEFT_OUT or named.get("role") in ROLES or hidden
        self.open.append((tag, max(left_out, FIRM if unnamed else NAMED if own else 0), inside))

    def handle_startendtag(self, tag, attrs):
        # HTML knows no empty form of other elements: the stroke means nothing.
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def _close_left_open(self, tag: str) -> None:
        for name, *_ in reversed(self.open):
            if name == tag:
                return self._close(tag)
            if name in BLOCKS and name not in CLOSED_BY_NEXT:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._break()
        self._close(tag)

    def handle_data(self, data):
        if not self._state()[0]:
            self.held.append(data)


def lines_of(html: str | None) -> list[tuple[str, bool]]:
    """Lines of a page without what its markup names as something else."""
    reader = Lines()
    reader.feed(html or "")
    reader.close()
    reader._break()
    return reader.lines


def shared(lines: list[str], other: list[str]) -> set[int]:
    """Places of ``lines`` that belong to a longest common subsequence with ``other``."""
    # Lines at both ends that agree belong to one; only what lies between needs the table.
    found, start = set(), 0
    while start < min(len(lines), len(other)) and lines[start] == other[start]:
        found.add(start)
        start += 1
    end = 0
    while end < min(len(lines), len(other)) - start and lines[-1 - end] == other[-1 - end]:
        end += 1
        found.add(len(lines) - end)
    # Lines that the other side lacks belong to none.
    inner, both = range(start, len(lines) - end), set(lines[start : len(lines) - end]) & set(other[start : len(other) - end])
    left = [i for i in inner if lines[i] in both]
    right = [x for x in other[start : len(other) - end] if x in both]
    if left and right:
        matched = _subsequence([lines[i] for i in left], right)
        found.update(left[i] for i in matched)
    return found


def _subsequence(a: list[str], b: list[str]) -> list[int]:
    """Places of ``a`` in a longest common subsequence, in memory linear in the lengths (Hirschberg)."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    middle = len(a) // 2
    head, tail = _sizes(a[:middle], b), _sizes(a[middle:][::-1], b[::-1])[::-1]
    cut = max(range(len(b) + 1), key=lambda k: head[k] + tail[k])
    return _subsequence(a[:middle], b[:cut]) + [middle + i for i in _subsequence(a[middle:], b[cut:])]


def _sizes(a: list[str], b: list[str]) -> list[int]:
    """Sizes of the longest common subsequences of ``a`` with each beginning of ``b``."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            here = row[k]
            row[k] = before + 1 if x == y else max(here, row[k - 1])
            before = here
    return row


def main_text(lines: list[tuple[str, bool]], others: list[list[tuple[str, bool]]]) -> str:
    """Lines that no other page shares, and all lines of the article.

    A neighbour with just the same lines is a copy and tells nothing.
    """
    texts = [text for text, _ in lines]
    drop: set[int] = set()
    for other in others:
        if (theirs := [text for text, _ in other]) != texts:
            drop |= shared(texts, theirs)
    return "\n".join(text for i, (text, article) in enumerate(lines) if article or i not in drop)


def placed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``__host`` and ``__path``; a page without address has an empty host and path."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    return pages.withColumns({"__host": F.lower(F.substring_index(bare, "/", 1)), "__path": F.regexp_replace(bare, "^[^/]*", "")})


def extract(pages: DataFrame, html: str = "html", url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all but ``html``) and ``text``, the main text, for every page.

    Pages are dealt by ranges of (host, path, row) and read in that order, so that a large host spreads over many
    tasks; the first and last page of a range go to the ranges beside it, too, so that each page meets the one before
    and the one after it in its host. Of an only page of a host nothing is deleted. Null and empty pages have an empty
    text. Pages that share an address are neighbours like others. Columns named ``text`` are replaced; an empty
    table gives an empty result.
    """
    carry = [c for c in pages.columns if c not in (html, "text")] if carry is None else carry
    fields = [pages.schema[c] for c in carry]
    spark = pages.sparkSession
    numbered = placed(with_row(pages, "__row"), url)
    key = F.struct("__host", "__path", "__row")
    names = numbered.select(key.alias("key"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds from a bounded number of addresses; the bounds, and the first and last address per range, are few.
    sample = [r["key"] for r in names.orderBy(F.xxhash64("key")).limit(PER_RANGE * ranges).collect()]
    sample.sort()
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    place = _place(bounds, key)
    edges = names.groupBy(_place(bounds, F.col("key")).alias("range")).agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("range").collect()
    copies: dict[tuple, list[int]] = {}
    for left, right in zip(edges, edges[1:]):
        # Pages beside each other, whatever empty ranges lie between.
        copies.setdefault(tuple(left["last"]), []).append(right["range"])
        copies.setdefault(tuple(right["first"]), []).append(left["range"])
    guests = spark.createDataFrame([(*k, v) for k, v in copies.items()], "__host string, __path string, __row bigint, __to array<int>")
    rows = numbered.select("__host", "__path", "__row", place.alias("__own"), *[F.col(f"`{c}`") for c in carry], F.col(html).cast("string").alias("__html"))
    # At most two rows per range.
    sent = rows.join(F.broadcast(guests), ["__host", "__path", "__row"], "left")
    none = F.array().cast("array<int>")
    dealt = sent.withColumn("__range", F.explode(F.concat(F.array("__own"), F.coalesce("__to", none)))).drop("__to")

    def run(batches):
        # The last two pages read: (host, lines, batch, place, whether it is a guest); what comes next completes the second one.
        before = current = None
        done: list[tuple[pa.RecordBatch, int, str]] = []

        def finish(following):
            if not current[4]:
                near = [other[1] for other in (before, following) if other is not None and other[0] == current[0]]
                done.append((current[2], current[3], main_text(current[1], near)))

        def flush():
            for first, last in _runs(done):
                part = done[first:last]
                columns = [part[0][0].column(f.name).take(pa.array([at for _, at, _ in part])) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text for *_, text in part], pa.string())], names=[*carry, "text"])
            done.clear()

        for batch in slices(batches, "__html"):
            # Pages of several ranges may stand in one task: they are neighbours only within a range.
            hosts = list(zip(batch.column("__range").to_pylist(), batch.column("__host").to_pylist()))
            guest = [own != at for own, (at, _) in zip(batch.column("__own").to_pylist(), hosts)]
            kept = batch.select(carry) if carry else batch.select([])
            for at, value in enumerate(as_bytes(batch, "__html")):
                page = (hosts[at], lines_of(value.decode() if value else ""), kept, at, guest[at])
                if current is not None:
                    finish(page)
                before, current = current, page
            yield from flush()
        if current is not None:
            finish(None)
            yield from flush()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string"])
    order = ["__range", "__host", "__path", "__row"]
    return dealt.repartitionById(ranges, F.col("__range")).sortWithinPartitions(*order).mapInArrow(run, schema)


def _place(bounds: list[tuple], key: Column) -> Column:
    """Number of the range of a page: how many bounds its address reaches."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.struct(F.lit(host).alias("__host"), F.lit(path).alias("__path"), F.lit(row).cast("bigint").alias("__row")) for host, path, row in bounds])
    return F.size(F.filter(held, lambda bound: bound <= key))


def _runs(done: list[tuple]) -> list[tuple[int, int]]:
    """Bounds of runs of items that stand in the same batch."""
    edges = [i for i in range(len(done)) if not i or done[i][0] is not done[i - 1][0]]
    return list(zip(edges, [*edges[1:], len(done)]))
