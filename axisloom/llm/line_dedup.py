"""Site-relative line deduplication, in DataFrame functions only.

A line is boilerplate on a host when it is repeated there (two pages or more hold it) and the pages
that hold it, divided by all pages of the host, exceed a ratio. Each page counts a line once, so counts are summed before they are
shuffled and a hot host or line is spread over its lines and tasks. A host's boilerplate lines
number less than its mean count of lines a page divided by the ratio, however many pages it has;
they travel as one short array of hashes for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.llm._io import table

#: From the shares of repeated lines in the supplied tables: from about 1 % on nearly every page with such a line has a text of its own,
#: below that copies of whole pages make up a good part.
RATIO = 0.02
#: Broadcast at most so many line hashes (16 bytes each); beyond that, hosts are joined with salt.
BROADCAST_MOST = 200_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Two hashes of a line without the spaces, tabs and carriage returns around it."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2"))


def _shown(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\r"))) > 0


def boilerplate(docs: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text", copies: bool = True) -> DataFrame:
    """For each host with any: ``host`` and ``dropped``, the hashes of its boilerplate lines. Without ``copies``, a host's pages of one text count once."""
    slim = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    keys = F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _shown), _key))).alias("k")
    if copies:
        lines = slim.select("host", keys)
    else:
        slim = slim.select("host", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
        lines = slim.select("host", "t1", "t2", keys).distinct()
        slim = slim.select("host", "t1", "t2").distinct()
    pages = slim.groupBy("host").agg(F.count("*").alias("pages"))
    held = lines.groupBy("host", "k.h1", "k.h2").agg(F.count("*").alias("held")).filter("held > 1")
    over = held.join(pages, held.host.eqNullSafe(pages.host)).filter(F.col("held") > F.lit(ratio) * F.col("pages"))
    return over.groupBy(held.host).agg(F.collect_list(F.struct("h1", "h2")).alias("dropped"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text", copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_dropped``.

    A line is dropped where it stands on more than ``ratio`` of its host's pages, and on more than one. Lines compare without the spaces, tabs and carriage returns around them;
    blank lines are never counted nor dropped, and kept lines stay as they are, in order. Rows
    with a null host are one host of their own. A null text stays null, with 0 lines; an empty
    one stays empty; a very long one is split in its task, whole. Each row is a page, repeated rows too; without ``copies``, a host's rows of one
    text count as one page, so that a much copied page keeps its lines. An empty table gives an empty one. All columns of ``docs`` stay; columns
    already named ``n_lines`` or ``n_dropped``, in any case of letters, are replaced.
    """
    gone = table(boilerplate(docs, ratio, host_col, text_col, copies), "boilerplate")
    entries = gone.agg(F.coalesce(F.sum(F.size("dropped") + 1), F.lit(0))).first()[0]
    host, text = F.col(host_col).cast("string"), F.col(text_col).cast("string")
    known = F.concat(F.lit("h"), host)  # never null where a host is known
    page = F.struct(*[F.col(c) for c in docs.columns]).alias("page")
    slim = docs.select(page, F.coalesce(known, F.lit("n")).alias("site"), text.alias("body"))
    gone = gone.select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")).alias("site"), "dropped")
    if entries <= BROADCAST_MOST:
        joined = slim.join(F.broadcast(gone), "site", "left")
    else:
        salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = slim.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"], "left")
    lines = _lines(F.col("body"))
    shown = F.filter(lines, _shown)
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("dropped"), _key(x)) | ~_shown(x)))
    cut = joined.withColumn("kept", kept)
    out = cut.select(
        "page",
        F.array_join("kept", "\n").alias("new"),
        F.coalesce(F.size(shown), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    columns = [F.col("new").alias(c) if c == text_col else F.col("page")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*columns, F.when(F.col("new").isNull(), F.lit(0)).otherwise(F.col("n_lines")).alias("n_lines"), F.when(F.col("new").isNull(), F.lit(0)).otherwise(F.col("n_dropped")).alias("n_dropped"))


ORACLE = f"""
WITH pages AS (SELECT source AS host, count(*) AS pages FROM documents GROUP BY 1),
lines AS (
  SELECT source AS host, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: length(x) > 0))) AS line
  FROM documents),
held AS (SELECT host, line, count(*) AS held FROM lines GROUP BY 1, 2 HAVING count(*) > 1),
gone AS (SELECT held.host, list(line) AS dropped FROM held JOIN pages ON held.host IS NOT DISTINCT FROM pages.host
  WHERE held > {RATIO}::DOUBLE * pages GROUP BY 1),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(dropped, []::VARCHAR[]), trim(x, chr(32) || chr(9) || chr(13))) OR length(trim(x, chr(32) || chr(9) || chr(13))) = 0) AS kept
  FROM documents d LEFT JOIN gone ON d.source IS NOT DISTINCT FROM gone.host)
SELECT doc_id, array_to_string(kept, chr(10)) AS text,
  coalesce(len(list_filter(lines, lambda x: length(trim(x, chr(32) || chr(9) || chr(13))) > 0)), 0)::BIGINT AS n_lines,
  coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM cut
"""
