"""Benchmark decontamination, in DataFrame functions only.

Short test items are searched for inside long documents by containment: the share of an item's
distinct word shingles that a document holds. Items are partitioned by the size of their shingle
set, in powers of two. Each partition keeps, for every item, its smallest ``s`` hashes (bottom-s
MinHash), with ``s`` large enough for the partition's largest size: a document that holds
the required share of any item in the partition must hold one of these ``s``. So the partition sets how
many hashes of an item are looked for: those that its largest size may miss, and one more.
Documents are probed shingle by shingle: hashes above the largest sketch value of all partitions can't match and
are dropped before the join (about half of them, as short items keep large values). Candidates are
then verified by containment of whole sets. Shingles compare by 64-bit hashes throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.llm._io import table

SHINGLE_WORDS = 5
PERCENT = 80
#: Broadcast item tables of at most so many hashes (about 40 bytes each); larger ones are shuffled.
BROADCAST_MOST = 1_000_000
SPACE = "[\\x20\\x09-\\x0D]+"


def shingles(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of word shingles; a text of fewer words has its whole sequence as the one shingle."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, SPACE, -1), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j - 1) for j in range(k)]))
        return F.when(n >= k, F.array_distinct(runs)).when(n > 0, F.array(F.xxhash64(F.array_join(w, " "), n))).otherwise(F.array().cast("array<bigint>"))

    # the words are computed once, as the argument of a one-element transform
    return F.coalesce(F.get(F.transform(F.array(words), hashes), F.lit(0)), F.array().cast("array<bigint>"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_MOST else df


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it holds: ids, ``n_item``, ``n_shared``, ``containment``.

    ``n_item`` counts the item's distinct shingles, ``n_shared`` those in the document, and the
    document holds the item when ``100 * n_shared >= percent * n_item``. Letters A-Z count as
    a-z; words are separated by ASCII white space. Texts that are null, empty or without words
    match nothing, nor do rows with a null id. An item under ``k`` words matches documents that
    are that very sequence. Rows that repeat an id are one document whose shingles are those of
    all of them (so the size of one row excludes nothing), and rows that repeat an item's id one item. Very long texts are split whole, in their task. Empty tables give an
    empty result; other columns are ignored, whatever their names. Ids must be whole numbers.
    """
    item = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item IS NOT NULL")
    held = item.select("item", F.explode(shingles(F.col("text"), k)).alias("h")).distinct()
    sized = held.groupBy("item").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("h")).alias("hs"))
    # sizes in (2**(p-1), 2**p]; a set of n may miss n - need of its shingles, so the n - need + 1 smallest meet
    part = F.ceil(F.log2("n_item")).cast("int")
    most = F.pow(F.lit(2.0), F.col("part")).cast("int")
    sketch = F.least(F.col("n_item").cast("int"), most - F.ceil(most * percent / 100).cast("int") + 1)
    placed = table(sized.withColumn("part", part).select("item", "n_item", "part", F.slice("hs", F.lit(1), sketch).alias("sketch"), "hs"), "items")
    total, sketched = placed.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0)), F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()
    probes = placed.select("part", F.explode("sketch").alias("h"), "item")
    tops = [r["top"] for r in probes.groupBy("part").agg(F.max("h").alias("top")).collect()]  # one row for each power of two

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    seen = slim.select("id", F.explode(F.filter(shingles(F.col("text"), k), lambda h: h <= F.lit(max(tops, default=-(1 << 63))))).alias("h"))
    found = table(seen.join(_bounded(probes, sketched), "h").select("id", "item").distinct(), "candidates")

    whole = slim.join(found.select("id").distinct(), "id", "left_semi").select("id", F.explode(shingles(F.col("text"), k)).alias("h"))
    wanted = placed.select("item", "n_item", F.explode("hs").alias("h"))
    met = whole.join(_bounded(wanted, total), "h").select("id", "item", "n_item", "h").distinct()
    shared = met.groupBy("id", "item", "n_item").agg(F.count("*").alias("n_shared")).join(found, ["id", "item"], "left_semi")
    good = shared.filter(F.lit(100) * F.col("n_shared") >= F.lit(percent) * F.col("n_item"))
    return good.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item, columns as they are.

    Rows with a null id stay, and so do null and empty texts; all rows of an id that holds an item go. Without items
    all rows stay; an empty table gives an empty one.
    """
    leaks = contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("leak")).distinct()
    return docs.join(leaks, docs[id_col].cast("long") == leaks["leak"], "left_anti")


ORACLE = f"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
sets AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= {SHINGLE_WORDS}
    THEN list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s
  FROM words WHERE id IS NOT NULL),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n_item FROM sets WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM sets d JOIN items i ON d.s = i.s WHERE d.kind = 'd'
GROUP BY d.id, i.id, n_item HAVING 100 * count(*) >= {PERCENT} * n_item
"""
