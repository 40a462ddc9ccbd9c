"""N-gram Jaccard self-join: a size-aware join of light (small) and heavy (large) sets.

A document's set is that of its distinct word shingles; two link when their Jaccard similarity
is at least the threshold. Identical sets first become one class, held by its smallest id.

* Small sets enumerate their subsets of the sizes that an overlap needs: two small sets that link
  share such a subset. The largest small size is chosen by cost from the histogram of sizes.
* Large sets scan inverted lists. Only the first ``n - need + 1`` shingles of a set in one global
  order have to be listed, as two sets that link must share one of those.
* The order is that of the hashes, with shingles that are frequent in a sample of documents at its end.
  Shingles whose lists come out long move there too, and the
  documents of long lists are joined once more among themselves in the new order. Any order is
  exact, and every pair sharing a long list lies within those documents, so nothing is lost.

Lists are not expanded into all pairs. Each list first checks its members against one of them, its
hub; links become components. Of short lists, pairs that lie in different components and share enough of them
to be similar are checked then. Long lists that still hold several components are put together
by hub and compared in pairs of blocks of bounded size, which give one link for each two
components. Every check is over the whole texts, by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm._components import components
from axisloom.llm._io import drop_table, table, table_by, unbucketed
from axisloom.llm._shingles import SHINGLE_WORDS, shingle_hashes
from axisloom.llm._worker import state

PERCENT = 80
LONG_LIST = 32
LEVELS = 3
DEMOTED_MOST = 200_000
#: One in so many documents is sampled for frequent shingles: those that so many of the sample hold.
SAMPLE_SHARE = 16
SAMPLE_HOLD = 3
SMALL_MOST = 14
#: The largest set that can link with one of SMALL_MOST; so many hashes of a set are kept until the boundary is known.
SMALL_LIST = 17
#: What a list entry costs, against a subset key. Measured on 0.5 GB of documents, in task time: 1.1 us to count an entry or key,
#: 6.5 us for an entry's share of comparing candidates, and 0.9 us to hash a subset: 7.6 to 2.0.
LIST_COST = 3.8
#: Keys and classes with about so many rows or more are counted and joined by broadcast, so that no task gets all rows of one.
HOT_ROWS = 1_000
HOT_SAMPLE = 16
HOT_MOST = 100_000
#: Documents and shingles of a block, and columns of a matrix, where long lists are checked.
BLOCK_DOCS = 500
BLOCK_SHINGLES = 1_000_000
MATRIX_COLUMNS = 2048


def need(n: int, m: int, percent: int) -> int:
    """The least overlap with which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def sizes(n: int, percent: int) -> range:
    """Sizes of the sets that one of n can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    """How many of n shingles, in any global order, one linked set at least must meet."""
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, most: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of n enumerates: the overlaps needed with other small sets."""
    return sorted({c for m in sizes(n, percent) if m <= most and (c := need(n, m, percent)) <= min(n, m)})


def small_boundary(histogram: dict[int, int], list_cost: float, percent: int) -> int:
    """The largest size that enumerates subsets: the least total of keys made, a list entry costing ``list_cost``."""
    best, boundary = None, 0
    for most in range(SMALL_MOST + 1):
        cost = 0.0
        for n, docs in histogram.items():
            if n <= most:
                cost += docs * sum(comb(n, c) for c in subset_sizes(n, most, percent) if c <= n)
            if n > most or 100 * n // percent > most:
                cost += docs * prefix_length(n, percent) * list_cost
        if best is None or cost < best:
            best, boundary = cost, most
    return boundary


def _late(hashes: np.ndarray, demoted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(demoted, hashes), len(demoted) - 1)
    return demoted[at] == hashes


def _first(hashes: np.ndarray, count: int, demoted: np.ndarray) -> np.ndarray:
    """The first ``count`` hashes in the order that has demoted ones last."""
    if not len(demoted):
        return hashes[:count]
    near = hashes[: 2 * count + 8]  # mostly these hold enough
    found = near[~_late(near, demoted)]
    if len(found) < count:
        late = _late(hashes, demoted)
        found = np.concatenate([hashes[~late], hashes[late]])
    return found[:count]


def _keys(hashes: np.ndarray, most: int, percent: int, demoted: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """Join keys of a set, how many of them are listed shingles, and the rank of the last listed one.

    The rank is whether the shingle is demoted, then its hash shifted to a signed number.
    """
    n = len(hashes)
    listed = np.zeros(0, np.uint64)
    if n > most or 100 * n // percent > most:
        listed = _first(hashes, prefix_length(n, percent), demoted)
    subsets: list[int] = []
    if n <= most:
        for c in subset_sizes(n, most, percent):
            subsets += [xxhash.xxh3_64_intdigest(np.array(s, np.uint64).tobytes(), seed=c) for s in combinations(hashes.tolist(), c)]
    keys = np.concatenate([listed, np.array(subsets, np.uint64)])
    if n <= most or not len(listed):
        return keys, 0, 0, -(1 << 63)
    at = np.searchsorted(demoted, listed[-1])
    late = at < len(demoted) and demoted[at] == listed[-1]
    return keys, len(listed), int(late), int(listed[-1]) - (1 << 63)


SIGNED = "id long, n int, hi long, lo long, keys array<long>, listed int, late int, last long"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64())
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]


def _signed(slim: DataFrame, k: int, percent: int, most: int | None, demoted: np.ndarray) -> DataFrame:
    """Size, digest and join keys of each set. Where the boundary isn't known yet (None), small sets keep their hashes, with ``listed`` -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("ngrams")
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                rows = []
                for t in texts.slice(at, 512):
                    s = shingle_hashes(t.as_py(), k)
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    if most is None:
                        keys, *rest = (s, -1, 0, 0) if 0 < len(s) <= SMALL_LIST else _keys(s, SMALL_MOST, percent, demoted)
                    else:
                        keys, *rest = _keys(s, most, percent, demoted)
                    rows.append((len(s), (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), keys.view(np.int64), *rest))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *_columns(rows)], names=["id", "n", "hi", "lo", "keys", "listed", "late", "last"])

    return slim.mapInArrow(run, SIGNED)


def _with_small(signed: DataFrame, most: int, percent: int, demoted: np.ndarray) -> DataFrame:
    """Sets whose keys are still their hashes get the keys for a boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("ngrams")
        for batch in batches:
            rows = []
            for n, hi, lo, hashes in zip(*(batch.column(c).to_pylist() for c in ("n", "hi", "lo", "keys")), strict=True):
                keys, *rest = _keys(np.array(hashes, np.int64).view(np.uint64), most, percent, demoted)
                rows.append((n, hi, lo, keys.view(np.int64), *rest))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], names=batch.schema.names)

    return signed.filter("listed >= 0").unionByName(signed.filter("listed < 0").mapInArrow(run, SIGNED))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("ngrams")
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def shingles(t: bytes) -> np.ndarray:
            if t in kept:
                kept.move_to_end(t)
            else:
                kept[t] = shingle_hashes(t, k)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[t]

        for batch in batches:
            good = []
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for x, y in zip(ta, tb, strict=True):
                x, y = shingles(x.as_py()), shingles(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    # a hub stands in as many pairs as its lists have members
    a = unbucketed(texts).select(F.col("id").alias("a"), F.col("text").alias("ta"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _frequent(slim: DataFrame, k: int) -> np.ndarray:
    """Shingles that several documents of a sample hold, the most frequent first where there are too many.

    They say where the order is to begin only: any order gives the same links.
    """
    few = slim.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLE_SHARE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("ngrams")
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                h = shingle_hashes(t.as_py(), k)
                if len(h) > SMALL_LIST:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    held = few.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("held"))
    rows = held.filter(F.col("held") >= SAMPLE_HOLD).orderBy(F.desc("held"), "key").limit(DEMOTED_MOST).select("key").toArrow()
    return np.unique(rows["key"].to_numpy().view(np.uint64))


def _members(usable: DataFrame) -> DataFrame:
    """Each id with the digest of its set and the smallest id that has the same set: the class."""
    classes = table(usable.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1"), "classes")
    total = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") >= max(HOT_ROWS, total // HOT_MOST)  # at most HOT_MOST classes
    known = usable.join(F.broadcast(classes.filter(hot).select("hi", "lo", F.col("rep").alias("hot_rep"))), ["hi", "lo"], "left")
    rest = known.filter("hot_rep IS NULL").join(classes.filter(~hot), ["hi", "lo"], "left")
    found = known.filter("hot_rep IS NOT NULL").select("id", "hi", "lo", F.col("hot_rep").alias("rep"))
    return found.unionByName(rest.select("id", "hi", "lo", F.coalesce("rep", "id").alias("rep"))).distinct()


def _entries(signed: DataFrame) -> DataFrame:
    """Members of every list of two or more, with ``length``.

    ``own`` counts the shingles of a set that no other document lists, ``near`` those that another set may share without
    sharing a short list: the ones not listed, and those whose lists are long.
    Keys that come out frequent in a sample of documents are counted by partial sums; the sample decides about the plan only.
    """

    few = signed.filter(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("seen"))
    hot = table(few.filter(F.col("seen") * HOT_SAMPLE >= HOT_ROWS).orderBy(F.desc("seen")).limit(HOT_MOST).select("key"), "hot-keys")
    rows = signed.select(F.explode("keys").alias("key"), "id")
    counted = rows if hot.isEmpty() else rows.join(F.broadcast(hot), "key", "left_anti")
    counted = counted.withColumn("length", F.count("*").over(Window.partitionBy("key")))
    stale = [hot]
    if not hot.isEmpty():
        many = table(rows.join(F.broadcast(hot), "key", "left_semi"), "hot-entries")
        lengths = many.groupBy("key").agg(F.count("*").alias("length"))
        stale.append(many)
        counted = counted.unionByName(many.join(F.broadcast(lengths), "key").select(*counted.columns))
    shared = table(counted.filter("length > 1"), "entries")
    met = shared.groupBy("id").agg(F.count("*").alias("met"), F.count_if(F.col("length") >= LONG_LIST).alias("long"))
    own = F.greatest(F.lit(0), F.col("listed") - F.col("met")).cast("int").alias("own")
    near = (F.col("n") - F.greatest(F.lit(0), F.col("listed") - F.col("long"))).cast("int").alias("near")
    # an id on rows with different texts stands in each of its lists once for each of them, which adds candidates only
    known = signed.select("id", "n", "listed", "late", "last").join(met, "id").select("id", "n", own, near, "late", "last")
    out = table(shared.join(known, "id").select("key", "length", "id", "n", "own", "near", "late", "last"), "lists")
    drop_table(shared, *stale)
    return out


def _possible(x: str, y: str, percent: int):
    """Whether two members of a list can be similar.

    Of the two, take the one whose listed shingles end first: the other lists all of its own
    shingles up to there, so it has none of those that the first alone lists.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    return _enough(x, y, c(x, "n") - c(x, "own"), c(y, "n") - c(y, "own"), percent)


def _enough(x: str, y: str, of_x, of_y, percent: int):
    """Whether sets link that share at most so many shingles: ``of_x`` where the listed ones of x end first, else ``of_y``."""
    c = lambda side, name: F.col(f"{side}.{name}")
    first = (c(x, "late") < c(y, "late")) | ((c(x, "late") == c(y, "late")) & (c(x, "last") <= c(y, "last")))
    o = F.least(F.when(first, of_x).otherwise(of_y), c(x, "n"), c(y, "n"))
    return F.lit(100) * o >= F.lit(percent) * (c(x, "n") + c(y, "n") - o)


MEMBER = ("own", "n", "id", "near", "late", "last")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of those lists that still hold several components, with their component."""
    roots = components(links)
    placed = members.join(roots, members.id == roots.node, "left").select("list", "length", *MEMBER, F.coalesce("root", "id").alias("root"))
    several = placed.groupBy("list").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("list")
    return table(placed.join(several, "list", "left_semi"), "open-lists")


def _links(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links enough to connect whatever all links connect."""
    hubs = table(members.groupBy("list").agg(F.min(F.struct(*MEMBER)).alias("hub")), "hubs")
    star = members.join(hubs, "list").withColumn("me", F.struct(*MEMBER)).filter((F.col("id") != F.col("hub.id")) & _possible("me", "hub", percent))
    checked = table(star.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = table(_verified(checked, texts, k, percent), "links")

    left = _open(members, links)
    short = left.filter(F.col("length") < LONG_LIST)
    x, y = short.alias("x"), short.alias("y")
    apart = (F.col("x.list") == F.col("y.list")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root"))
    both = x.join(y, apart & _possible("x", "y", percent)).select(F.col("x.list.level").alias("level"), F.struct(*[F.col(f"x.{c}") for c in MEMBER]).alias("x"), F.struct(*[F.col(f"y.{c}") for c in MEMBER]).alias("y"))
    # in different components they share no list of one component, so what they share is near, or in the lists counted here;
    # sets that enumerate subsets share as few as one
    met = both.groupBy("level", "x", "y").agg(F.count("*").alias("shared"))
    sure = _enough("x", "y", F.col("x.near") + F.col("shared"), F.col("y.near") + F.col("shared"), percent)
    rest = met.filter(sure).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = table(rest.join(done, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(rest, texts, k, percent))

    # long lists with the same hub hold much the same documents: each such group is checked once, in blocks
    long = left.filter(F.col("length") >= LONG_LIST).join(hubs, "list").select(F.col("hub.id").alias("hub"), "id", "n", "root").distinct()
    return links.unionByName(_block_links(table(long, "groups"), texts, k, percent))


def _block_links(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the components of each group, one for each two components of a pair of blocks."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sized = groups.groupBy("hub").agg(parts.alias("parts"))
    dealt = groups.join(sized, "hub").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = copies.select("hub", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "root")

    def run(t: pa.Table) -> pa.Table:
        state("ngrams")
        ids, roots, blocks = (t[c].to_numpy() for c in ("id", "root", "block"))
        a, b = component_links([shingle_hashes(x.as_py(), k) for x in t["text"].combine_chunks().cast(pa.binary())], roots, blocks, t["b1"][0].as_py() != t["b2"][0].as_py(), percent)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return paired.join(texts, "id").groupBy("hub", "b1", "b2").applyInArrow(run, "a long, b long")


def component_links(sets: list[np.ndarray], roots: np.ndarray, blocks: np.ndarray, across: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked sets of different roots, one link for each two roots; ``across`` compares different blocks only.

    Overlaps are counted as products of 0/1 matrices over the shingles that several sets have.
    """
    n = np.array([len(s) for s in sets])
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    common = np.flatnonzero(np.bincount(of, minlength=len(values)) > 1)
    column = np.full(len(values), -1)
    column[common] = np.arange(len(common))
    col = column[of]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(common), MATRIX_COLUMNS):
        here = (col >= low) & (col < low + MATRIX_COLUMNS)
        m = np.zeros((len(sets), min(MATRIX_COLUMNS, len(common) - low)), np.float32)
        m[owner[here], col[here] - low] = 1
        both += m @ m.T
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    linked &= (roots[:, None] < roots[None, :]) & (both > 0)
    if across:
        linked &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(linked)
    _, once = np.unique(np.stack([roots[a], roots[b]]), axis=1, return_index=True)
    return a[once], b[once]


def linked_documents(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id that the document reaches by links, itself included. A
    null or empty text, or one without words, has an empty set and links with nothing. Rows with
    a null id link with nothing and keep a null component. Repeated rows are one class; an id on
    rows with different texts has the links of all of them. Very long texts are hashed whole, one at a time. An empty table gives an empty one;
    other columns are ignored, whatever their names. Ids must be whole numbers.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    demoted = _frequent(slim, k)
    signed = table(_signed(slim, k, percent, None, demoted), "signed")
    sized = table(signed.select("id", "n", "hi", "lo"), "sized")
    usable = sized.filter("id IS NOT NULL AND n > 0")
    member = table(_members(usable), "member")
    copies = member.filter("id <> rep").select("id", "hi", "lo")
    histogram = {n: c for n, c in usable.groupBy(F.least("n", F.lit(SMALL_LIST + 1)).alias("n")).count().collect()}
    most = small_boundary(histogram, LIST_COST, percent)
    reps = table(_with_small(signed.filter("id IS NOT NULL AND n > 0").join(copies, ["id", "hi", "lo"], "left_anti"), most, percent, demoted), "reps")
    drop_table(signed)
    entries = _entries(reps)
    drop_table(reps)
    texts = table_by(slim.join(entries.select("id").distinct(), "id", "left_semi"), "id", "texts")

    members, held = None, [entries]
    for level in range(LEVELS):
        long = entries.filter(F.col("length") >= LONG_LIST)
        last = level == LEVELS - 1 or long.isEmpty()
        kept = (entries if last else entries.filter(F.col("length") < LONG_LIST)).withColumn("list", F.struct(F.lit(level).alias("level"), "key"))
        members = kept if members is None else members.unionByName(kept)
        if last:
            break
        found = long.groupBy("key").agg(F.max("length").alias("length")).orderBy(F.desc("length"), "key").limit(DEMOTED_MOST).collect()
        demoted = np.union1d(demoted, np.array([r["key"] for r in found], np.int64).view(np.uint64))
        again = texts.join(long.select("id").distinct(), "id", "left_semi")
        signed = table(_signed(again, k, percent, most, demoted).filter("n > 0"), "signed")
        entries = _entries(signed)
        drop_table(signed)
        held.append(entries)

    links = _links(members.drop("key"), texts, k, percent)
    several = member.groupBy("id").agg(F.count_distinct("rep").alias("c")).filter("c > 1").select("id")
    bridges = member.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionByName(bridges))
    drop_table(texts, *held)
    one = member.groupBy("id").agg(F.min("rep").alias("rep"))
    placed = one.join(roots, one.rep == roots.node, "left").select("id", F.coalesce("root", "rep").alias("root"))
    return sized.join(placed, "id", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
