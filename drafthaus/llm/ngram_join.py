"""Jaccard self-join on word shingles by vertical partitioning.

The shingles that several sets have are put into one global order, the rare ones first, and the order is cut into
fragments, of which the data decide how many.  Each set is cut along them into segments.  The overlap of two sets is
counted fragment by fragment, segment against segment, and the partial overlaps are summed per pair.  Everything is exact
for the threshold given (but for collisions of 64-bit hashes):

1. Texts with equal sets form a class, whose id is a digest of the set; from here on a class is one record.
2. Of each class the shingles whose hash is under a limit are tested: the limit depends on n alone and falls with n.
   A partner has n / t shingles at most, so each class sends those under the limit of t n, and what the two share of
   the tested ones is in both.  A shingle that one class alone has sent (its least and greatest sender agree) is
   missed by all others.  A class with a partner misses at most floor((1 - t) n) shingles, so a class with more of
   these is done.
3. The whole sets of the classes left (a fifth or so) are counted: frequencies, global order, fragments, segments.
   With s shingles that others have too, a class has overlaps of s at most.
4. Candidates by prefix filter in the global order.  Within each group of classes with a common prefix shingle, every
   class is first compared with the group's hub, the class with the fewest shingles of its own.  What is linked then is
   one component, however large, without its pairs ever being listed.
5. The pairs left are those of different components that share a prefix shingle and pass the bounds of size, of s and,
   if both have been compared with one hub, of their differences from it; all of them are verified.

No step brings all classes that have a shingle, or all members of a component, into one task: counts combine on the map
side, and what they are joined with is written first, since Spark splits a join's large partitions only where both
sides come straight from a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, connected_components, free, give_back, in_batches, mixed, shingles, small, written

#: Rows of ids that may be broadcast (16 bytes each); beyond that the texts are shuffled to them.
BROADCAST_ROWS = 4_000_000
#: Entries (a set's shingle each) of a fragment.
FRAGMENT = 500_000
LAST = 2**63 - 1


def _digest(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A digest of each set that doesn't depend on its order."""
    size = np.bincount(text, minlength=n)
    ends = np.concatenate([[0], np.cumsum(size)])
    sums = np.zeros((2, len(value) + 1), np.uint64)
    np.cumsum(mixed(value ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
    np.cumsum(mixed(value + np.uint64(0x14057B7EF767814F)), out=sums[1, 1:])
    part = sums[:, ends[1:]] - sums[:, ends[:-1]]
    return mixed(part[0] * np.uint64(0x2545F4914F6CDD1D) + mixed(part[1] + size.astype(np.uint64))).view(np.int64)


def _limit(size: np.ndarray, percent: int) -> np.ndarray:
    """Upper halves of hashes under this are tested: a twentieth more of a set than it may miss, and sqrt(size) more."""
    return np.ceil(np.minimum(1, (105 - percent) / 100 + 1 / np.sqrt(np.maximum(size, 1))) * 2.0**32).astype(np.uint64)


def _lists(text: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64)))


def _sets(words: int, percent: int | None = None):
    """Of (id, key, text) the rows (id, key, n, class, limit, shingles to send); without percent (n, class, whole set)."""

    def run(batches):
        for batch in batches:
            for first, data, at in chunks(batch.column(2)):
                rows = len(at) - 1
                text, value = shingles(data, at, words)
                size = np.bincount(text, minlength=rows)
                digest = pa.array(_digest(text, value, rows))
                if percent is None:
                    yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), digest, _lists(text, value, rows)], names=["n", "d", "hs"])
                    continue
                low = (value >> np.uint64(32)) < _limit(size * percent // 100, percent)[text]
                limit = pa.array(_limit(size, percent).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(size, pa.int64()), digest, limit, _lists(text[low], value[low], rows)], names=["doc_id", "key", "n", "d", "lim", "hs"])
        give_back()

    return run


def _fragments(bands: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first band, last band, first fragment, fragments) of (band, entries) in order: small bands are put together until
    they have FRAGMENT entries, a large one is cut into ranges of hashes."""
    out, base, begin, held = [], 0, None, 0
    for i, (band, entries) in enumerate(bands):
        begin, held = band if begin is None else begin, held + entries
        if held >= FRAGMENT or i == len(bands) - 1:
            ranges = min(1 << 30, held // FRAGMENT + 1) if begin == band else 1
            out.append((begin, band, base, ranges))
            base, begin, held = base + ranges, None, 0
    return out


def _segments(whole: DataFrame, misses) -> DataFrame:
    """d, n, s, frag, hs, prefix: each set's segments, of the shingles that several sets have, and their part of its prefix.

    The global order is that of the frequencies (over 64, of eighths of their logarithms), then of the hashes.
    """
    entries = whole.select("d", "n", F.explode("hs").alias("h"))
    counted = entries.groupBy("h").agg(F.count("*").alias("freq")).where("freq > 1")
    band = F.when(F.col("freq") < 64, F.col("freq")).otherwise(F.floor(F.log2("freq") * 8) + 16)
    known = written(counted.select("h", "freq", band.cast("int").alias("band")))
    bands = sorted(tuple(r) for r in known.groupBy("band").agg(F.sum("freq")).collect())  # some hundred rows, whatever the data
    frag, upper = F.lit(0).cast("long"), F.shiftrightunsigned("h", 32)
    for begin, end, base, ranges in _fragments(bands):
        frag = F.when(F.col("band").between(begin, end), F.lit(base) + F.shiftrightunsigned(upper * ranges, 32)).otherwise(frag)
    placed = entries.join(known.select("h", "band", frag.alias("frag")), "h").repartition("d")
    parts = placed.groupBy("d", "n", "frag").agg(F.sort_array(F.collect_list(F.struct("band", "h"))).alias("x"))  # a part of one set
    parts = parts.select("d", "n", "frag", F.col("x.h").alias("hs"))
    own = Window.partitionBy("d")
    parts = parts.withColumn("s", F.sum(F.size("hs")).over(own)).withColumn("upto", F.sum(F.size("hs")).over(own.orderBy("frag").rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.where(F.col("n") - F.col("s") <= misses)
    of_prefix = misses + 1 - (F.col("n") - F.col("s")) - (F.col("upto") - F.size("hs"))
    prefix = F.slice("hs", 1, F.greatest(F.lit(0), F.least(F.size("hs").cast("long"), of_prefix)).cast("int"))
    return written(parts.select("d", "n", "s", "frag", "hs", prefix.alias("prefix")))


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with both: the partial overlap in each fragment, segment against segment, summed per pair."""
    left = segments.select(F.col("d").alias("a"), "frag", F.col("hs").alias("xs"))
    right = segments.select(F.col("d").alias("b"), "frag", F.col("hs").alias("ys"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select(*pairs.columns, F.size(F.array_intersect("xs", "ys")).alias("part"))
    return partial.groupBy(*pairs.columns).agg(F.sum("part").alias("both"))


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    Returns one row per row of docs: id_col (a long), key (a hash of the text), n_shingles, set_id (equal for equal
    sets) and component_id, the smallest id that links lead to.  Two texts are linked when 100 * intersection >= percent * union.

    A text that is null, empty or only white space has no shingles, set_id null, and its own id as component_id.
    Rows with a null id count as texts and can join others; if a component has no other ids, component_id is null.
    Repeated rows come back as often; rows with equal texts are one set.  An empty table gives no rows.  Other
    columns of docs are not read, so their names can't clash.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent: 1 to 100")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    misses = F.floor(F.col("n") * (100 - percent) / 100)  # n * (100 - percent) is exact; so is the floor for n < 2**45
    i = F.coalesce("doc_id", F.lit(LAST))

    rows = written(in_batches(base).mapInArrow(_sets(words, percent), "doc_id long, key long, n long, d long, lim long, hs array<long>"))
    sets = written(rows.where("n > 0").groupBy("d", "n").agg(F.min(F.struct(i.alias("i"), "key")).alias("first")))
    sent = rows.select("d", "lim", F.explode("hs").alias("h")).select("h", "d", (F.shiftrightunsigned("h", 32) < F.col("lim")).alias("tested"))
    alone = sent.groupBy("h").agg(F.min("d").alias("d"), F.max("d").alias("other"), F.max("tested").alias("tested")).where("d = other and tested").groupBy("d").agg(F.count("*").alias("alone"))
    alive = written(sets.join(alone, "d", "left").where(F.coalesce("alone", F.lit(0)) <= misses).select(F.col("first.key").alias("key"), F.col("first.i").alias("i")))
    left = base.withColumn("i", i).join(small(alive, BROADCAST_ROWS), ["key", "i"], "left_semi").select("i", "key", "text")
    if rows.groupBy(i, "key").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["i", "key"])
    whole = written(left.mapInArrow(_sets(words), "n long, d long, hs array<long>"))

    segments = _segments(whole, misses)
    entries = segments.select("d", F.explode("hs").alias("h"))
    prefix = segments.select(F.explode("prefix").alias("h"), "d", "n", "s")
    by_class = Window.partitionBy("d")
    fits = lambda x, y: (F.col(f"{x}n") + F.col(f"{y}n")) * percent <= F.least(f"{x}s", f"{y}s") * (100 + percent)
    hubs = prefix.groupBy("h").agg(F.count("*").alias("many"), F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), F.col("d").alias("hub"), F.col("n").alias("hn"), F.col("s").alias("hs"))).alias("x")).where("many > 1")
    hubs = written(hubs.select("h", "x.hub", "x.hn", "x.hs"))
    votes = written(prefix.join(hubs, "h").where(F.col("d") != F.col("hub")).where(fits("", "h")).groupBy("d", "n", "s", "hub", "hn", "hs").agg(F.count("*").alias("votes")))
    # of the hubs with half of a class's most votes or more, the one that most classes have, so that families have one hub
    fame = written(votes.groupBy("hub").agg(F.count("*").alias("fame")))
    strong = votes.withColumn("most", F.max("votes").over(by_class)).where(F.col("votes") * 2 >= F.col("most")).join(fame, "hub")
    chosen = strong.groupBy("d", "n", "s").agg(F.max(F.struct("fame", "votes", "hub", "hn", "hs")).alias("x"))
    first = chosen.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("x.hub").alias("b"), F.col("x.hn").alias("nb"), (F.col("x.hn") - F.col("x.hs")).alias("lone"))

    similar = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
    compared = written(_overlaps(written(first), segments))
    links = compared.where(similar).select("a", "b")
    components = written(connected_components(links))
    # a family: the classes compared with one hub, and how many shingles each doesn't share with it; lone: those of the
    # hub that no other class has, which are in all of these differences but not in entries
    joined = components.withColumnsRenamed({"node": "d", "component": "c"})
    about = compared.select(F.col("a").alias("d"), F.col("na").alias("n"), F.col("sa").alias("s"), F.col("b").alias("hub"), (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("apart"), "lone")
    family = written(about.join(joined, "d", "left").withColumn("c", F.coalesce("c", "d")).withColumn("common", F.col("apart") - F.col("n") + F.col("s")))
    # Two of a family are similar only if they differ in (100 - percent) / (100 + percent) of their sizes' sum at most.
    # What their differences from the hub share is at most what of them no other class lacks or has: "common".
    spare = F.col("apart") * (100 + percent) - F.col("n") * (100 - percent)
    bounds = written(family.groupBy("hub").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(spare - F.col("common") * 2 * (100 + percent)).alias("low"), F.min(spare).alias("high")).where("c0 != c1").select("hub", "low", "high"))
    able = written(family.join(bounds, "hub").where((spare + F.col("low") <= 0) & (spare - F.col("common") * 2 * (100 + percent) + F.col("high") <= 0)).drop("low", "high"))
    x, y = (able.select("hub", *(F.col(c).alias(f"{p}{c}") for c in ("d", "n", "s", "c", "apart", "common", "lone"))) for p in "xy")
    close = (F.col("xapart") + F.col("yapart") - 2 * F.least("xcommon", "ycommon")) * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent)
    pair = [F.col("xd").alias("a"), F.col("yd").alias("b"), F.col("xn").alias("na"), F.col("yn").alias("nb")]
    within = x.join(y, "hub").where("xd < yd and xc != yc").where(fits("x", "y")).where(close).select(*pair, (F.col("xapart") + F.col("yapart")).alias("apart"), F.col("xlone").alias("lone"))
    # their differences from the hub, a tenth of their sets, are counted instead of the sets
    own = able.select("hub", "d")
    sides = own.join(entries, "d").select("d", "h", F.lit(1).alias("side")).union(own.join(entries.withColumnRenamed("d", "hub"), "hub").select("d", "h", F.lit(2).alias("side")))
    differ = sides.groupBy("d", "h").agg(F.sum("side").alias("sides")).where("sides != 3").groupBy("d").agg(F.collect_list("h").alias("hs"))  # a part of two sets
    differ = written(differ)
    left, right = differ.select(F.col("d").alias("a"), F.col("hs").alias("xs")), differ.select(F.col("d").alias("b"), F.col("hs").alias("ys"))
    alike = F.col("lone") + F.coalesce(F.size(F.array_intersect("xs", "ys")), F.lit(0))
    within = written(within).join(left, "a", "left").join(right, "b", "left").where((F.col("apart") - 2 * alike) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")

    # across families: prefix groups, but those of one component or one family are done
    member = prefix.join(joined, "d", "left").join(about.select("d", "hub"), "d", "left").select("h", "d", "n", "s", F.coalesce("c", "d").alias("c"), F.coalesce("hub", "d").alias("hub"))
    member = written(member)
    mixed_groups = written(member.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("hub").alias("h0"), F.max("hub").alias("h1"), F.min("n").alias("n0")).where("c0 != c1 and h0 != h1").select("h", "n0"))
    open_ = written(member.join(mixed_groups, "h").where((F.col("n") + F.col("n0")) * percent <= F.col("s") * (100 + percent)).drop("n0"))
    x, y = (open_.select("h", *(F.col(c).alias(f"{p}{c}") for c in ("d", "n", "s", "c", "hub"))) for p in "xy")
    across = x.join(y, "h").where("xd < yd and xc != yc and xhub != yhub and xhub != yd and yhub != xd").where(fits("x", "y")).select(*pair).distinct()
    more = written(within.union(_overlaps(written(across), segments).where(similar).select("a", "b")))
    if more.limit(1).count():
        components = written(connected_components(links.union(more)))

    # the smallest id of each component is found among classes, and then given to rows
    linked = sets.join(components.withColumnsRenamed({"node": "d", "component": "c"}), "d").select("d", "c", F.col("first.i").alias("i"))
    linked = written(linked)
    least = written(linked.groupBy("c").agg(F.min("i").alias("i")))
    alike_ = linked.select("d", "c").join(least, "c").select("d", "i")
    single = sets.join(linked.select("d"), "d", "left_anti").select("d", F.col("first.i").alias("i"))
    ends = written(alike_.unionByName(single))
    named = rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("d")).alias("d")).join(ends, "d", "left")
    return named.select(F.col("doc_id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.col("d").alias("set_id"), F.when(F.col("n") > 0, F.when(F.col("i") != LAST, F.col("i"))).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that come first (smallest id, nulls last, then hash of the text) in their component.

    Texts without words (null, empty, white space) all stay, as do components of one.  Of rows that are alike in id and
    text one stays.  A component without an id keeps one row of each distinct set.  An empty table gives none.  No
    name of a column of docs can clash.
    """
    found = ngram_jaccard_join(docs, words, percent, id_col, text_col)
    found = written(found.select(F.coalesce(id_col, F.lit(LAST)).alias("i"), "key", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "set_id")).alias("c")))
    first = written(found.where("c is not null").groupBy("c").agg(F.min(F.struct("i", "key")).alias("f")))
    # rows that go, and rows that are there more than once; both are a small part, so the texts needn't move
    gone = found.join(first, "c").where((F.col("i") != F.col("f.i")) | (F.col("key") != F.col("f.key"))).select("i", "key").distinct()
    i, key = free(docs, "i", "key")
    renamed = lambda df: df.select(F.col("i").alias(i), F.col("key").alias(key))
    gone, again = written(renamed(gone)), written(renamed(found.groupBy("i", "key").count().where("count > 1")))
    keyed = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), key: F.xxhash64(text_col)})
    left = keyed.join(small(gone, BROADCAST_ROWS), [i, key], "left_anti")
    if again.limit(1).count():
        again = small(again, BROADCAST_ROWS)
        left = left.join(again, [i, key], "left_anti").unionByName(left.join(again, [i, key], "left_semi").dropDuplicates([i, key]))
    return left.select(*docs.columns)
