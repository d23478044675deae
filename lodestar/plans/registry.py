"""Named queries over the test tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.operators import json_docs, literal, records, regex, table
from lodestar.sources import datasource, storage
from lodestar.sources.collections import FlatCollection, JsonCollection, KVCollection, TableCollection
from lodestar.streaming.search import windowed_count

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))


def _flat(spark: SparkSession, sf_dir: str) -> FlatCollection:
    return FlatCollection.build(_docs(spark, sf_dir), "value", "key")


_PLACED = """
placed AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS record_id,
         coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM documents
)"""


def _split(word: str, size: str, keys: str, source: str) -> str:
    """Occurrences of a word that can't overlap itself: what precedes each, by splitting."""
    return f"""
  SELECT {keys}, (sum({size}(piece)) OVER (PARTITION BY {keys} ORDER BY i) + {len(word)} * (i - 1))::BIGINT AS "offset"
  FROM (SELECT {keys}, unnest(p[1:len(p) - 1]) AS piece, unnest(range(1, len(p))) AS i FROM (SELECT {keys}, string_split(text, '{word}') AS p FROM {source}))"""


# --- flat collection ---------------------------------------------------------------------------------------------


@query(f"WITH {_PLACED} SELECT record_id, pos AS global_offset FROM placed")
def flat_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).df.select("record_id", "global_offset")


@query("SELECT coalesce(sum(len(string_split(text, 'the')) - 1), 0)::BIGINT AS n FROM documents")
def flat_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal.count(_docs(spark, sf_dir), "the")


@query("SELECT sum(len(list_filter(range(1, length(c_name)), lambda i: substr(c_name, i, 2) = '00')))::BIGINT AS n FROM customer")
def flat_count_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of zeros, in which occurrences overlap."""
    return literal.count(_read(spark, sf_dir, "customer"), "00", "c_name")


@query(f"""WITH {_PLACED}, hits AS ({_split("the", "strlen", "pos", "placed")}) SELECT pos + "offset" AS "offset" FROM hits""")
def flat_search_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).search("the")


@query("SELECT substr(string_agg(c_name || chr(10), '' ORDER BY c_custkey), 1001, 300) AS content FROM customer")
def flat_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = FlatCollection.build(_read(spark, sf_dir, "customer"), "c_name", "c_custkey")
    return records.extract_global(flat.df, 1000, 300).select(F.col("content").cast("string").alias("content"))


@query(f"""WITH {_PLACED}, asked AS (SELECT event_id, user_id * 211 AS position FROM events)
SELECT event_id, position, record_id FROM asked JOIN placed ON position BETWEEN pos AND pos + strlen(coalesce(text, ''))""")
def offset_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 211).alias("position"))
    return _flat(spark, sf_dir).offset_to_record(asked)


@query(f"""WITH {_PLACED}, asked AS (SELECT event_id, user_id * 211 AS a, user_id * 211 + 700 AS b FROM events)
SELECT event_id, a, b, x.record_id = y.record_id AS same FROM asked
JOIN placed x ON a BETWEEN x.pos AND x.pos + strlen(coalesce(x.text, '')) JOIN placed y ON b BETWEEN y.pos AND y.pos + strlen(coalesce(y.text, ''))""")
def same_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 211).alias("a"), (F.col("user_id") * 211 + 700).alias("b"))
    return records.same_record(_flat(spark, sf_dir).df, asked)


@query("SELECT count(*) AS n_records, coalesce(sum(strlen(coalesce(text, '')) + 1), 0)::BIGINT AS n_bytes FROM documents")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.total_size(_docs(spark, sf_dir))


@query("""
SELECT ascii(c) AS symbol, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '' GROUP BY 1
""")
def alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.alphabet(_read(spark, sf_dir, "part"), "p_name")


@query("""
SELECT p_partkey, i - 1 AS "offset" FROM (SELECT p_partkey, p_type, unnest(range(1, length(p_type) + 1)) AS i FROM part)
WHERE substr(p_type, i, 2) >= 'ST' AND (substr(p_type, i, 2) <= 'TI' OR starts_with(substr(p_type, i, 2), 'TI'))
""")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.range_starts(_read(spark, sf_dir, "part"), "p_partkey", "ST", "TI", "p_type")


@query("SELECT doc_id AS record_id, text AS value FROM documents")
def flat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as saved and loaded; ids here are dense, as the documents' are."""
    path = storage.scratch(spark, "flat")
    _flat(spark, sf_dir).save(path)
    return FlatCollection.load(spark, path).df.select("record_id", "value")


@query(f"""
WITH {_PLACED}, n AS (SELECT count(*) AS rows, coalesce(sum(strlen(coalesce(text, '')) + 1), 0)::BIGINT AS bytes FROM documents),
new AS (
  SELECT row_number() OVER (ORDER BY page_id) - 1 AS record_id,
         coalesce(sum(strlen(url) + 1) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM pages
)
SELECT record_id, pos AS global_offset FROM placed UNION ALL SELECT record_id + rows, pos + bytes FROM new, n
""")
def bulk_append_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return _flat(spark, sf_dir).bulk_append(pages, "url", "page_id").df.select("record_id", "global_offset")


# --- keyed values ------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS key FROM documents WHERE contains(text, 'the')")
def kv_search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVCollection(_docs(spark, sf_dir)).search("the")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE contains(text, 'and')")
def kv_filter_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal.containing(_read(spark, sf_dir, "conversations"), "and", "text")


@query("SELECT coalesce(sum(len(string_split(text, 'er')) - 1), 0)::BIGINT AS n FROM documents")
def kv_count_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences in binary values."""
    binary = _docs(spark, sf_dir).withColumn("value", F.col("value").cast("binary"))
    return literal.count(binary, b"er", binary=True)


@query(f"""WITH hits AS ({_split("the", "length", "doc_id", "documents")}) SELECT doc_id AS key, "offset" FROM hits""")
def kv_search_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVCollection(_docs(spark, sf_dir)).search_offsets("the")


@query(f"""WITH hits AS ({_split("the", "strlen", "doc_id", "documents")}) SELECT doc_id AS key, "offset" FROM hits""")
def kv_search_offsets_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    binary = _docs(spark, sf_dir).withColumn("value", F.col("value").cast("binary"))
    return KVCollection(binary).search_offsets("the")


def _one(spark: SparkSession, schema: str, *values: object) -> DataFrame:
    """One row of what point lookups gave."""
    return spark.createDataFrame([values], schema)


def _priorities(spark: SparkSession, sf_dir: str) -> KVCollection:
    return KVCollection(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value")))


@query("SELECT o_orderpriority AS value, substr(o_orderpriority, 3, 4) AS part, NULL::VARCHAR AS missing FROM orders WHERE o_orderkey = 7")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's value, a part of it, and a key that isn't there."""
    kv = _priorities(spark, sf_dir)
    return _one(spark, "value string, part string, missing string", kv.get(7), kv.extract(7, 2, 4), kv.get(-1))


@query("SELECT doc_id AS key, encode(text) AS value FROM documents WHERE text IS NOT NULL")
def kv_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary values, saved and loaded."""
    path = storage.scratch(spark, "kv-bytes")
    KVCollection(_docs(spark, sf_dir).filter("value IS NOT NULL").withColumn("value", F.col("value").cast("binary"))).save(path)
    return KVCollection.load(spark, path).df


@query(f"""WITH {_PLACED}, whole AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer)
SELECT (SELECT substr(string_agg(c_name || chr(10), '' ORDER BY id), 1001, 1) FROM whole) AS at_1000,
       (SELECT c_name FROM whole WHERE id = 5) AS record, (SELECT substr(c_name, 4, 8) FROM whole WHERE id = 5) AS part""")
def flat_point_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character by global offset, a record by id, and a part of that record."""
    flat = FlatCollection.build(_read(spark, sf_dir, "customer"), "c_name", "c_custkey")
    return _one(spark, "at_1000 string, record string, part string", flat.char_at(1000), flat.get_record(5), flat.extract_record(5, 3, 8))


@query(f"WITH {_PLACED} SELECT record_id FROM placed WHERE contains(text, 'tion')")
def flat_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).record_ids("tion")


@query(f"WITH {_PLACED} SELECT record_id FROM placed WHERE regexp_matches(text, '(th|wh)(en|at)[ ,]')")
def flat_record_ids_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).record_ids_regex("(th|wh)(en|at)[ ,]")


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey IN (1, 7, 32, 999999999)")
def kv_multiget(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return KVCollection(orders).multiget([1, 7, 32, 999999999])


@query("SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def kv_multiget_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    keys = _read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("key"))
    return KVCollection(orders).multiget(keys)


@query("SELECT doc_id AS key, substr(text, 11, 40) AS value FROM documents")
def record_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("key", F.substring("value", 11, 40).alias("value"))


@query("SELECT doc_id AS key, substr(text, 6, 1) AS value FROM documents")
def char_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("key", F.substring("value", 6, 1).alias("value"))


@query("SELECT doc_id AS key, substr(text, 101, 50) AS content, 100 + length(substr(text, 101, 50)) AS next FROM documents")
def extract_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("key", t.resumable(F.col("value"), 100, 50).alias("r")).select("key", "r.*")


@query("SELECT page_id, split_part(substr(url, 9), '/', 1) AS host FROM pages")
def extract_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", t.until(F.col("url"), 8, "/").alias("host"))


@query("""
WITH b AS (SELECT c_custkey, list_transform(range(1, 9), lambda i: ascii(substr(c_name, i, 1))::BIGINT) AS c FROM customer)
SELECT c_custkey, (c[1] * 256 + c[2])::SMALLINT AS short, (((c[1] * 256 + c[2]) * 256 + c[3]) * 256 + c[4])::INT AS int,
       (((((((c[1] * 256 + c[2]) * 256 + c[3]) * 256 + c[4]) * 256 + c[5]) * 256 + c[6]) * 256 + c[7]) * 256 + c[8])::BIGINT AS long FROM b
""")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of a value as big-endian numbers."""
    data = F.col("c_name").cast("binary")
    return _read(spark, sf_dir, "customer").select("c_custkey", *[t.big_endian(data, 0, n).alias(name) for n, name in ((2, "short"), (4, "int"), (8, "long"))])


@query("SELECT doc_id AS key, text AS value FROM documents")
def kv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "kv")
    KVCollection(_docs(spark, sf_dir)).save(path, sort=True)
    return KVCollection.load(spark, path).df


@query("SELECT doc_id AS key, text AS value FROM documents UNION ALL SELECT -1 - page_id, url FROM pages")
def bulk_append_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("key"), F.col("url").alias("value"))
    return KVCollection(_docs(spark, sf_dir)).bulk_append(pages).df


@query("SELECT count(*) AS n FROM documents")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count("*").alias("n"))


# --- patterns ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS key FROM documents WHERE regexp_matches(text, '(the|and)ing')")
def regex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVCollection(_docs(spark, sf_dir)).regex_search("(the|and)ing")


@query(r"SELECT doc_id AS key FROM documents WHERE regexp_matches(text, 'the(?:.|\n)*tion')")
def regex_keys_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVCollection(_docs(spark, sf_dir)).regex_search("the.*tion")


@query("""
SELECT key, i AS "offset", (j + 3 - i)::INT AS length
FROM (SELECT doc_id AS key, strpos(text, 'the') - 1 AS i, length(text) - strpos(reverse(text), 'dna') - 2 AS j FROM documents WHERE contains(text, 'the') AND contains(text, 'and'))
WHERE j >= i + 3
""")
def regex_wildcard_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wildcard reaches from the first occurrence before it to the last one after it."""
    return KVCollection(_docs(spark, sf_dir)).regex_match("the.*and")


@query("""
SELECT doc_id AS key, i - 1 AS "offset", length(regexp_extract(substr(text, i), '^[0-9]+'))::INT AS length
FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE regexp_matches(text, '[0-9]'))
WHERE regexp_matches(substr(text, i, 1), '[0-9]') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[0-9]'))
""")
def regex_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of each run: what lies within the match before is left out."""
    return KVCollection(_docs(spark, sf_dir)).regex_match("[0-9]+")


@query(f"""
WITH a AS ({_split("the", "length", "doc_id", "documents")}), b AS ({_split("and", "length", "doc_id", "documents")})
SELECT doc_id AS key, "offset", 3 AS length FROM a UNION ALL SELECT doc_id, "offset", 3 FROM b
""")
def regex_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVCollection(_docs(spark, sf_dir)).regex_match("the|and")


@query()
def regex_matches_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats with longest matches, whose lengths SQL's leftmost-first engine doesn't give; tests hold it to brute force."""
    return regex.matches(_read(spark, sf_dir, "conversations"), "(th|er){2,4}(on|e)*", ["conv_id", "turn"], "text")


@query(f"""
WITH a AS ({_split("er", "length", "conv_id, turn", "conversations")}), b AS ({_split("ers", "length", "conv_id, turn", "conversations")})
SELECT conv_id, turn, "offset", 2 AS length FROM a UNION ALL SELECT conv_id, turn, "offset", 3 FROM b
""")
def regex_matches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start and length, not the longest only."""
    return regex.matches(_read(spark, sf_dir, "conversations"), "e(r|rs)", ["conv_id", "turn"], "text", greedy=False)


@query(f"""
WITH {_PLACED}, a AS ({_split("tion", "strlen", "pos", "placed")}) SELECT pos + "offset" AS "offset", 4 AS length FROM a
""")
def regex_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).regex_search("(tion)")


@query(f"""
WITH {_PLACED}, a AS ({_split("and", "strlen", "pos", "placed")}) SELECT pos + "offset" AS "offset", 3 AS length FROM a ORDER BY 1 DESC LIMIT 10
""")
def regex_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten last matches of the collection, as a report."""
    return _flat(spark, sf_dir).regex_search("(and)").orderBy(F.desc("offset")).limit(10)


# --- tables ------------------------------------------------------------------------------------------------------


def _table(name: str, source: str, columns: list[str], where: list[tuple[str, str, object]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return TableCollection(_read(spark, sf_dir, source)).scan(columns, where)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {source} WHERE {sql}")(run)


_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
_table("table_eq", "lineitem", _LINE, [("l_returnflag", "eq", "R")], "l_returnflag = 'R'")
_table("table_lt", "lineitem", _LINE, [("l_quantity", "lt", 10.0)], "l_quantity < 10")
_table("table_le", "lineitem", _LINE, [("l_quantity", "le", 10.0)], "l_quantity <= 10")
_table("table_gt", "lineitem", _LINE, [("l_quantity", "gt", 40.0)], "l_quantity > 40")
_table("table_ge", "lineitem", _LINE, [("l_quantity", "ge", 40.0)], "l_quantity >= 40")
_table("table_negative", "customer", ["c_custkey", "c_acctbal"], [("c_acctbal", "ge", -500.0), ("c_acctbal", "lt", 0.0)], "c_acctbal >= -500 AND c_acctbal < 0")
_table("table_startswith", "part", ["p_partkey", "p_type"], [("p_type", "startswith", "STANDARD")], "starts_with(p_type, 'STANDARD')")
_table("table_endswith", "part", ["p_partkey", "p_type"], [("p_type", "endswith", "L")], "ends_with(p_type, 'L')")
_table("table_contains", "part", ["p_partkey", "p_name"], [("p_name", "contains", "in")], "contains(p_name, 'in')")
_table("table_in", "orders", ["o_orderkey", "o_orderstatus"], [("o_orderstatus", "in", ["F", "P"])], "o_orderstatus IN ('F', 'P')")
_table("table_between", "lineitem", _LINE, [("l_quantity", "between", (10.0, 20.0))], "l_quantity BETWEEN 10 AND 20")
_table("table_null_safe", "orders", ["o_orderkey"], [("o_orderpriority", "eqnullsafe", "1-URGENT")], "o_orderpriority IS NOT DISTINCT FROM '1-URGENT'")
_table("table_not_null", "orders", ["o_orderkey"], [("o_orderdate", "isnull", False)], "o_orderdate IS NOT NULL")
_table(
    "table_conjunction", "lineitem", ["l_quantity", "l_orderkey", "l_linenumber"],
    [("l_returnflag", "eq", "A"), ("l_quantity", "gt", 10.0), ("l_discount", "le", 0.05)], "l_returnflag = 'A' AND l_quantity > 10 AND l_discount <= 0.05",
)


@query("SELECT l_tax, l_orderkey FROM lineitem")
def table_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableCollection(_read(spark, sf_dir, "lineitem")).scan(["l_tax", "l_orderkey"])


@query("""SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate,
       min(l_returnflag) AS min_l_returnflag, max(l_returnflag) AS max_l_returnflag FROM lineitem""")
def table_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableCollection(_read(spark, sf_dir, "lineitem")).limits(["l_quantity", "l_shipdate", "l_returnflag"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "table")
    TableCollection(_read(spark, sf_dir, "customer")).save(path, mode="overwrite")
    return TableCollection.load(spark, path).df


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited text table with a header row, read as strings."""
    path = storage.scratch(spark, "delimited")
    _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("sep", "|").option("header", True).csv(path)
    return storage.delimited(spark, path)


@query("SELECT c_name AS value FROM customer")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch(spark, "text")
    _read(spark, sf_dir, "customer").select("c_name").write.text(path)
    return storage.text_records(spark, path)


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def bulk_append_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    region = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return table.append(nation, region)


@query("SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 5, '0') AS padded FROM nation")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select("n_nationkey", t.padded(F.col("n_nationkey"), 5).alias("padded"))


@query("SELECT p_partkey, try_cast(p_size::VARCHAR AS INT) AS size, try_cast(p_name AS DOUBLE) AS none, try_cast(p_retailprice::VARCHAR AS DOUBLE) AS price FROM part")
def text_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    kinds = (("p_size", "int", "size"), ("p_name", "double", "none"), ("p_retailprice", "double", "price"))
    return part.select("p_partkey", *[t.typed(F.col(c).cast("string"), k).alias(n) for c, k, n in kinds])


@query(r"""
SELECT doc_id AS key, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN strlen(regexp_extract(text, '^[\x00-\x7F]*')) ELSE -1 END AS place FROM documents
""")
def non_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("key", t.first_non_ascii(F.col("value")).alias("place"))


# --- JSON --------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc"))


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') = '87'")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JsonCollection(_events(spark, sf_dir)).filter("k", "87")


@query("SELECT event_id AS id FROM events WHERE contains(json_extract_string(props, '$.k'), '7')")
def json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JsonCollection(_events(spark, sf_dir)).search("7")


@query("SELECT event_id AS id, json_extract(props, '$.k')::BIGINT AS k, event_id AS inner_id FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = JsonCollection(_events(spark, sf_dir)).documents()
    return docs.select("id", F.get_json_object("doc", "$.k").cast("long").alias("k"), F.get_json_object("doc", "$.id").cast("long").alias("inner_id"))


@query("SELECT event_id AS id, 'k' AS path, json_extract_string(props, '$.k') AS leaf FROM events")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JsonCollection(_events(spark, sf_dir)).leaves()


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, props AS doc FROM events")
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JsonCollection.build(_events(spark, sf_dir), "doc", "id").df


@query("SELECT 'OBJECT<k: DECIMAL(21,1), name: STRING>' AS schema")
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers and fractions of one field widen to a decimal; a field of some documents joins the others."""
    nations = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('{"k":'), F.col("n_nationkey"), F.lit('.5,"name":"x"}')).alias("doc"))
    whole = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('{"k":'), F.col("n_nationkey"), F.lit("}")).alias("doc"))
    return json_docs.widened_schema(nations.union(whole))


@query("SELECT event_id AS id, props AS doc FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as saved and loaded."""
    path = storage.scratch(spark, "json")
    JsonCollection(_events(spark, sf_dir)).save(path)
    return JsonCollection.load(spark, path).df


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0")
def json_filter_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field whose name holds a quote and a dot."""
    half = F.concat(F.lit('{"it\'s.even":"'), (F.col("n_nationkey") % 2 == 0).cast("string"), F.lit('"}'))
    docs = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), half.alias("doc"))
    return JsonCollection(docs).filter(r"it's\.even", "true")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, props AS doc FROM events UNION ALL SELECT (SELECT count(*) FROM events) + row_number() OVER (ORDER BY n_nationkey) - 1, '{\"n\":' || n_nationkey || '}' FROM nation")
def bulk_append_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('{"n":'), F.col("n_nationkey"), F.lit("}")).alias("doc"))
    return JsonCollection.build(_events(spark, sf_dir), "doc", "id").bulk_append(new, "doc", "n_nationkey").df


# --- what Spark adds: joins, aggregates, windows, sets over the same tables ----------------------------------------


@query("""
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def join_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (_read(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    both = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return both.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.rollup_count_distinct(_read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [["l_returnflag"], ["l_linestatus"], []]
    return _read(spark, sf_dir, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))


@query("""SELECT user_id, min(ts) AS first, count(*) AS n FROM (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at most two hours apart, by the engine's own session windows."""
    sessions = _read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours"))
    return sessions.agg(F.min("ts").alias("first"), F.count("*").alias("n")).select("user_id", "first", "n")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 20")
def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by the named source under each mode, read through ``CREATE TEMPORARY VIEW ... USING``."""
    path = storage.scratch(spark, "named")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    datasource.save(nation.limit(1), path, "error")
    datasource.save(nation, path, "overwrite")
    datasource.save(nation.limit(2), path, "ignore")
    return datasource.create_view(spark, "lodestar_nation", path).filter("n_nationkey >= 20")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place")).filter("place <= 3")


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).intersect(_read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
       sum(len(string_split(event_type, 'c')) - 1)::BIGINT AS n FROM events GROUP BY 1, 2
""")
def windowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_count(_read(spark, sf_dir, "events"), "c", "ts", "event_type")
