"""Secret scans with multipart credential linking, in DataFrame functions only.

Three strong kinds are reported wherever they stand. Three weak kinds (account names, endpoints
and mixed blobs) are common in clean text; a weak part is reported only when a complementary part
lies within its scope: an account or endpoint near a secret, a blob near an access identifier. Scopes are
intervals of code points; parts are matched by an interval join over buckets of the document,
as a semi-join, so no pairs are made, and a bucket's width bounds the parts that can stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.llm._io import table

SCOPE = 200
BUCKET = 512


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of each kind, in the order in which spans that start together are listed.
ASSIGN = rf"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = rf"({_either('user')}_?{_either('name')}|{_either('login')}|{_either('client')}_?{_either('id')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)"
ENDPOINT = r"(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
BLOB = r"[A-Za-z0-9+/_-]{32,}={0,2}"
KINDS = ("assign", "access", "hex", "account", "endpoint", "blob")
SECRET, IDENTIFIER = ("assign", "hex", "blob"), ("access", "account")
#: The role that must stand near a weak part.
NEEDS = {"account": "secret", "endpoint": "secret", "blob": "identifier"}
SPAN = "array<struct<start:int,no:int,end:int>>"


def _spans(text: Column, no: int, pattern: str, good=None, group: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap, by the lengths of the texts between them."""
    whole, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(whole, inner, lambda w, g: F.struct(F.length(w).alias("n"), (good(g) if good else F.lit(True)).alias("ok")))
    steps = F.zip_with(steps, F.slice(parts, F.lit(1), F.size(whole)), lambda s, gap: F.struct(s["n"].alias("n"), s["ok"].alias("ok"), F.length(gap).alias("gap")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,no:int,end:int,ok:boolean>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = (acc["at"] + s["gap"]).cast("int")
        end = (start + s["n"]).cast("int")
        one = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), s["ok"].alias("ok"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    found = F.filter(F.aggregate(steps, empty, step)["spans"], lambda s: s["ok"])
    slim = F.transform(found, lambda s: F.struct(s["start"], s["no"], s["end"]))
    return F.when(F.rlike(text, F.lit(pattern)), slim).otherwise(F.array().cast(SPAN))


def _mixed(s: Column) -> Column:
    return s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9]")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _role(names: tuple[str, ...]) -> Column:
    return F.col("no").isin([KINDS.index(n) for n in names])


def secret_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind:
    strong parts all, weak ones where a complementary part is at most ``scope`` code points away.
    ``base_sha256`` is of the strong parts alone, listed the same way. Null and empty texts have
    no spans; rows with a null id are scanned like others; repeated rows each give a row; very long texts are scanned whole; an
    empty table gives an empty one; other columns are ignored, whatever their names. Ids must be whole numbers.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("text"))
    found = slim.select(
        "id",
        F.xxhash64("text").alias("th"),
        F.length("text").alias("len"),
        _spans(F.col("text"), 0, ASSIGN, lambda g: F.length(g) >= 6, 2).alias("assign"),
        _spans(F.col("text"), 1, ACCESS).alias("access"),
        _spans(F.col("text"), 2, HEX).alias("hex"),
        F.concat(
            _spans(F.col("text"), 3, ACCOUNT, lambda g: F.length(g) >= 3, 2),
            _spans(F.col("text"), 4, ENDPOINT),
            _spans(F.col("text"), 5, BLOB, _mixed),
        ).alias("weak"),
    )
    scanned = table(found, "scanned")
    key = ["id", "th", "len"]
    base = F.concat("assign", "access", "hex")
    parts = scanned.filter(F.size("weak") > 0).select(*key, F.explode(F.concat(base, F.col("weak"))).alias("s")).select(*key, "s.*").distinct()
    low, high = F.col("start") - scope, F.col("end") + scope
    need = F.create_map(*[F.lit(x) for k, v in NEEDS.items() for x in (KINDS.index(k), v)])
    asks = parts.filter(F.col("no") > 2).select(*key, "start", "no", "end", low.alias("low"), high.alias("high"), F.get(F.map_values(need), F.col("no") - 3).alias("role"))
    asks = asks.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0)) / BUCKET), F.floor(F.col("high") / BUCKET))))
    gives = parts.withColumn("role", F.when(_role(SECRET), F.lit("secret")).when(_role(IDENTIFIER), F.lit("identifier"))).filter("role IS NOT NULL")
    gives = gives.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))))
    a, g = asks.alias("a"), gives.alias("g")
    same = F.col("a.id").eqNullSafe(F.col("g.id"))
    for c in ("th", "len", "role", "bucket"):
        same = same & (F.col(f"a.{c}") == F.col(f"g.{c}"))
    near = same & (F.col("g.start") <= F.col("a.high")) & (F.col("g.end") >= F.col("a.low")) & (F.col("g.no") != F.col("a.no"))
    kept = a.join(g, near, "left_semi").select(*key, "start", "no", "end").distinct()
    linked = kept.groupBy(*key).agg(F.collect_list(F.struct("start", "no", "end")).alias("linked")).alias("l")
    s = scanned.alias("s")
    same = F.col("s.id").eqNullSafe(F.col("l.id")) & (F.col("s.th") == F.col("l.th")) & (F.col("s.len") == F.col("l.len"))
    out = s.join(linked, same, "left")
    every = F.concat(base, F.coalesce(F.col("linked"), F.array().cast(SPAN)))
    return out.select(
        F.col("s.id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _oracle_kind(no: int, pattern: str, good: str = "true", group: int = 0) -> str:
    return f"""
  SELECT r, doc_id, {no} AS no, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS s, length(whole[i]) AS n
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT r, doc_id, regexp_extract_all(t, {_sql(pattern)}, 0) AS whole, regexp_extract_all(t, {_sql(pattern)}, {group}) AS inside, string_split_regex(t, {_sql(pattern)}) AS gaps FROM docs))
  WHERE {good}"""


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({
    " UNION ALL ".join((
        _oracle_kind(0, ASSIGN, "length(inside[i]) >= 6", 2), _oracle_kind(1, ACCESS), _oracle_kind(2, HEX),
        _oracle_kind(3, ACCOUNT, "length(inside[i]) >= 3", 2), _oracle_kind(4, ENDPOINT),
        _oracle_kind(5, BLOB, "regexp_matches(whole[i], '[a-z]') AND regexp_matches(whole[i], '[A-Z]') AND regexp_matches(whole[i], '[0-9]')"),
    ))
}),
parts AS (SELECT r, no, s, s + n AS e, ['assign', 'access', 'hex', 'account', 'endpoint', 'blob'][no + 1] || ':' || s || ':' || (s + n) AS shown FROM spans),
kept AS (
  SELECT * FROM parts WHERE no < 3
  UNION ALL
  SELECT * FROM parts a WHERE no >= 3 AND EXISTS (
    SELECT 1 FROM parts g WHERE g.r = a.r AND g.s <= a.e + {SCOPE} AND g.e >= a.s - {SCOPE} AND g.no <> a.no
      AND CASE WHEN a.no = 5 THEN g.no IN (1, 3) ELSE g.no IN (0, 2, 5) END)),
agg AS (
  SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(shown, ',' ORDER BY s, no) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN agg USING (r)
"""
