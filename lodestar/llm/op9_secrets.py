r"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each kind of secret is a regular expression. Matches and the pieces between them come from one scan of the text
(``regexp_extract_all`` and, only where there are matches, ``split``); lengths of pieces and matches give code-point
offsets. The texts are read once: what is kept is one narrow row a document with its matches, secrets as digests. Over
these, candidate digests are counted by distinct repositories and distinct owners: a value that many owners hold is a
copied example, one that stays with few owners looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import documents, written

VALUE = "[A-Za-z0-9+/_.=-]+"
#: kind, pattern, group that holds the secret, least characters of that group, literal that must occur (or none).
#: For access and hex a minimum inside the pattern finds the same matches as dropping the short ones afterwards:
#: either takes whole runs of its class. That isn't so for assign, whose short matches use up text.
KINDS = [
    ("assign", rf"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({VALUE})""", 2, 6, None),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, None),
    (
        "vendor",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
        r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        0, 1, None,
    ),
]
BASE = 3
#: Owners from which on a value counts as a copied example.
MANY_OWNERS = 3


def _matches(k: int) -> Column:
    """Matches of kind k, in order: kind, number, code points before it since the last match, its own, its secret's digest."""
    _, pattern, group, least, _ = KINDS[k]
    secret = F.col(f"s{k}") if group else F.col(f"m{k}")
    pieces = F.slice(F.split("text", pattern, -1), 1, F.size(f"m{k}"))
    rows = F.arrays_zip(pieces.alias("gap"), F.col(f"m{k}").alias("hit"), secret.alias("secret"))
    row = lambda x, i: F.struct(
        F.lit(k).alias("kind"), i.alias("nth"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("size"),
        F.when(F.char_length(x["secret"]) >= least, F.sha2(x["secret"], 256)).alias("secret"),
    )
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,secret:string>>")
    return F.when(F.size(f"m{k}") > 0, F.transform(rows, row)).otherwise(none)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", many_owners: int = MANY_OWNERS) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per input row (row, id) and one per secret found.

    The second has row, kind, start, end (code points, end exclusive), secret (SHA-256 of the value), n_repos, n_owners
    and verdict: ``example`` where ``many_owners`` owners or more hold the value, else ``live``. A null text counts as
    empty; a null repository or owner counts as one more; repeated rows are scanned each; an empty table gives two empty
    ones; other columns are ignored, whatever their names.
    """
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), named(repo_col).alias("repo"), named(owner_col).alias("owner"), text.alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    found = {}
    for k, (_, pattern, _, _, literal) in enumerate(KINDS):
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found[f"m{k}"] = F.when(F.contains("text", F.lit(literal)), hits).otherwise(F.array().cast("array<string>")) if literal else hits
    rows = rows.withColumns(found)
    groups = {f"s{k}": F.when(F.size(f"m{k}") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) for k, (_, pattern, group, _, _) in enumerate(KINDS) if group}
    rows = rows.withColumns(groups)
    rows = rows.select("row", "id", "repo", "owner", F.concat(*[_matches(k) for k in range(len(KINDS))]).alias("found"))
    rows, _ = written(rows, "secret-matches")

    so_far = W.partitionBy("row", "kind").orderBy("nth")
    each = rows.filter(F.size("found") > 0).select("row", "repo", "owner", F.inline("found"))
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    each = each.filter(F.col("secret").isNotNull())
    # pre-aggregated before each shuffle: a value that everyone copies makes one row for each owner or repository
    held = each.groupBy("secret").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    each = each.join(held, "secret")
    each = each.withColumn("verdict", F.when(F.col("n_owners") >= many_owners, "example").otherwise("live"))
    return rows.select("row", "id"), each.select("row", "kind", "start", "end", "secret", "n_repos", "n_owners", "verdict")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, each = secret_scan(documents(spark, sf_dir))
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    number = lambda c: F.count(F.when(c, 1))
    per = each.groupBy("row").agg(
        *[number(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        number(F.col("verdict") == "example").alias("n_example"), number(F.col("verdict") == "live").alias("n_live"), spans.alias("spans"),
    )
    name = F.array(*[F.lit(k[0]) for k in KINDS])
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])))
    per = per.withColumns({"spans": said(F.col("spans")), "base": said(F.filter("spans", lambda x: x["kind"] < BASE))})
    out = rows.join(per, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        F.col("id").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(none("base"), 256).alias("base_sha256"), none("spans").alias("spans"), zero("n_example"), zero("n_live"),
    )


def _sql() -> str:
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, (_, pattern, group, least, _) in enumerate(KINDS):
        if k == 0:
            words = "|".join(["password", "passwd", "secret", "token"])
            pattern = f"""({"|".join(map(either, words.split("|")))}|{either("api")}_?{either("key")})["']?\\x20*[:=]\\x20*["']?({VALUE})"""
        r = quote(pattern)
        parts.append(f"""
  SELECT rid, doc_id, source, {k} AS kind, unnest(range(1, len(m) + 1)) AS nth, unnest(list_transform(p[1:len(m)], lambda x: length(x))) AS gap,
         unnest(list_transform(m, lambda x: length(x))) AS size, unnest(g) AS val, {least} AS least
  FROM (SELECT rid, doc_id, source, regexp_extract_all(t, {r}) AS m, regexp_extract_all(t, {r}, {group}) AS g, string_split_regex(t, {r}) AS p
        FROM d WHERE regexp_matches(t, {r}))""")
    names = "[" + ",".join(quote(k[0]) for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS source, coalesce(text, '') AS t FROM documents),
each AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY nth)::BIGINT AS stop FROM each
),
kept AS (SELECT rid, doc_id, source, kind, stop - size AS start, stop, val FROM placed WHERE length(val) >= least),
held AS (SELECT val, count(DISTINCT source) AS owners FROM kept GROUP BY val),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {BASE}) AS base,
         string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (owners >= {MANY_OWNERS}) AS n_example, count(*) FILTER (owners < {MANY_OWNERS}) AS n_live
  FROM kept JOIN held USING (val) GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (rid)
"""


SQL = _sql()
