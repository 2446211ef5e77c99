"""Registered queries on the warehouse catalog, SQL checks, the question log and reports, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import rank
from .plans import catalog, qalog, searchindex, shapes, sqlcheck
from .queries import _pieces, query, table
from .session import spread, stored
from .sources import sinks

LAYERS = ("ADS", "DWS", "DWT", "DWD", "ODS")
_LAYER = "['ADS', 'DWS', 'DWT', 'DWD', 'ODS', 'TMP'][p_partkey % 6 + 1]"


def _files(spark, sf_dir) -> DataFrame:
    """For every part: a definition, an ETL text, and for every third a document; every sixth lies in no known layer."""
    key = F.col("p_partkey")
    k, layer = key.cast("string"), F.element_at(F.array(*map(F.lit, (*LAYERS, "TMP"))), (key % 6 + 1).cast("int"))
    low = F.lower(layer)
    folder = F.concat(F.lit("/dw/0"), (key % 6 + 1).cast("string"), F.lit("-"), layer, F.lit("/"))
    define = F.concat(
        F.lit("-- CREATE TABLE old.x (y INT)\nCREATE TABLE IF NOT EXISTS "), low, F.lit(".t_"), k, F.lit(" (\n  id BIGINT COMMENT '编号 "), k,
        F.lit("', -- the key\n  `v` DECIMAL(10, 2) COMMENT 'a, b',\n  PRIMARY KEY (id)\n) COMMENT '表 "), k, F.lit("' PARTITIONED BY (dt STRING COMMENT '日期');"),
    )
    fill = F.concat(
        F.lit("INSERT OVERWRITE TABLE t_"), k, F.lit(" SELECT DISTINCT id, sum(v)\nFROM (SELECT *, row_number() over (partition by id, dt order by ts desc) rn FROM dwd.src_"), (key % 7).cast("string"),
        F.lit(") o\nJOIN dim.shop s ON o.sid = s.sid -- FROM nowhere\nWHERE rn = 1 GROUP BY id, o.dt;"),
    )
    told = F.concat(F.lit("# Table\nCREATE TABLE "), low, F.lit(".t_"), k, F.lit(" (other STRING)"))
    file = lambda name, text: F.struct(F.concat(folder, F.lit(name), k).alias("path"), text.alias("text"))
    parts = F.array(file("表", define), file("载入", fill), F.when(key % 3 == 0, file("说明", told)))
    ends = F.array(F.lit(".sql"), F.lit(".sql"), F.lit(".md"))
    listed = F.zip_with(parts, ends, lambda f, e: F.when(f.isNotNull(), F.struct(F.concat(f["path"], e).alias("path"), f["text"].alias("text"))))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.explode(F.array_compact(listed)).alias("f")).select("f.*")


def _catalog(spark, sf_dir, layers=None, signals=False) -> DataFrame:
    return catalog.build(_files(spark, sf_dir), layers=layers, signals=signals)


_ENTRIES = f"""
SELECT p_partkey, {_LAYER} AS layer, lower({_LAYER}) || '.t_' || p_partkey AS name, '表' || p_partkey AS description, '表 ' || p_partkey AS table_comment,
  '/dw/0' || (p_partkey % 6 + 1) || '-' || {_LAYER} || '/' AS folder, 'id:BIGINT:编号 ' || p_partkey || '|v:DECIMAL(10,2):a, b' AS columns FROM part WHERE p_partkey % 6 < 5
"""


@query(f"""
SELECT layer, name, description, table_comment, folder || '表' || p_partkey || '.sql,' || folder || '载入' || p_partkey || '.sql' AS sql_files, CASE WHEN p_partkey % 3 = 0 THEN folder || '说明' || p_partkey || '.md' ELSE '' END AS doc_files, columns, 'dt:STRING:日期' AS partition_columns,
  'dwd.src_' || (p_partkey % 7) || ',dim.shop' AS source_tables, 'id,o.dt' AS group_by, 'id,dt' AS row_number_keys, true AS has_distinct, true AS has_row_number FROM ({_ENTRIES})
""")
def catalog_build(spark, sf_dir):
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["type"], x["comment"])), "|")
    signs = F.col("signals")
    return _catalog(spark, sf_dir, signals=True).select(
        "layer", "name", "description", "table_comment", F.array_join("sql_files", ",").alias("sql_files"), F.array_join("doc_files", ",").alias("doc_files"), told(F.col("columns")).alias("columns"), told(F.col("partition_columns")).alias("partition_columns"),
        *(F.array_join(signs[f], ",").alias(f) for f in ("source_tables", "group_by", "row_number_keys")), signs["has_distinct"].alias("has_distinct"), signs["has_row_number"].alias("has_row_number"),
    )


@query(f"SELECT layer, count(*) AS tables, count(*) AS commented FROM ({_ENTRIES}) GROUP BY layer")
def catalog_counts(spark, sf_dir):
    return catalog.counts(_catalog(spark, sf_dir))


@query(f"SELECT layer, name, CAST(row_number() OVER (ORDER BY layer, name) AS INTEGER) AS place FROM ({_ENTRIES}) QUALIFY place <= 50")
def catalog_order(spark, sf_dir):
    return rank.placed(rank.by_layer(_catalog(spark, sf_dir)), 50).select("layer", "name", "place")


_FOUND = f"""
SELECT layer, name, 5.0 * contains(name, 't_12')::INT + 4.0 * contains('编号 ' || p_partkey || 'a, b', '编号')::INT + 1.5 + 4.0 * contains(table_comment, '345')::INT + 4.0 * contains(description, '345')::INT + 5.0 * contains(name, '345')::INT
  + 4.0 * contains('编号 ' || p_partkey || 'a, b', '345')::INT + 1.0 * contains('表' || p_partkey, '345')::INT AS hits, CASE layer WHEN 'ADS' THEN 3.0 WHEN 'DWS' THEN 2.0 WHEN 'DWT' THEN 1.0 ELSE 0.0 END AS bonus FROM ({_ENTRIES})
"""


@query(f"SELECT layer, name, CAST(hits + bonus AS DOUBLE) AS score FROM ({_FOUND}) ORDER BY hits + bonus DESC, layer, name LIMIT 20")
def catalog_search(spark, sf_dir):
    return catalog.search(_catalog(spark, sf_dir), "统计 T_12 编号 dt １２ 345")


@query(f"""
WITH e AS ({_ENTRIES}), c AS (SELECT *, lower(name) AS f1, description AS f2, table_comment AS f3, '编号 ' || p_partkey || chr(10) || 'a, b' AS f4, 'id' || chr(10) || 'v' AS f5, 'dt' AS f6,
  lower(folder || '表' || p_partkey || '.sql' || chr(10) || folder || '载入' || p_partkey || '.sql' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || folder || '说明' || p_partkey || '.md' ELSE '' END) AS f7 FROM e),
w AS (SELECT n_nationkey AS question_id, unnest(['t_' || n_nationkey, '编号', lower(n_name), 'nation', 'dt', 'sql']) AS word FROM nation),
h AS (SELECT word, layer, name, CASE WHEN word = 'dt' THEN 0.5 ELSE 1.0 END * (5.0 * contains(f1, word)::INT + 4.0 * contains(f2, word)::INT + 4.0 * contains(f3, word)::INT + 4.0 * contains(f4, word)::INT + 3.0 * contains(f5, word)::INT + 3.0 * contains(f6, word)::INT + contains(f7, word)::INT) AS hits FROM (SELECT DISTINCT word FROM w), c),
s AS (SELECT question_id, layer, name, sum(hits) + CASE layer WHEN 'ADS' THEN 3.0 WHEN 'DWS' THEN 2.0 WHEN 'DWT' THEN 1.0 ELSE 0.0 END AS score FROM w JOIN h ON h.word = w.word GROUP BY question_id, layer, name)
SELECT question_id, layer, name, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, layer, name) AS INTEGER) AS place FROM s WHERE score > 0 QUALIFY place <= 20
""")
def catalog_search_many(spark, sf_dir):
    """A question for every nation, all answered at once from an index of the catalog."""
    entries = stored(_catalog(spark, sf_dir), "entries")
    ask = F.concat(F.lit("统计 T_"), F.col("n_nationkey").cast("string"), F.lit(" 编号 "), "n_name", F.lit(" dt SQL"))
    questions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question_id"), ask.alias("question"))
    index = searchindex.postings(searchindex.field_texts(entries))  # asked once: what a word's gram isn't in is dropped as it is made
    return searchindex.search_many(index, entries, questions)


@query(f"SELECT layer, name, CAST(5.0 + CASE layer WHEN 'DWD' THEN 3.0 ELSE 0.0 END AS DOUBLE) AS score FROM ({_ENTRIES}) WHERE layer IN ('DWD', 'ODS') AND contains(name, 't_77') ORDER BY score DESC, layer, name LIMIT 20")
def catalog_search_in_layers(spark, sf_dir):
    """Entries of two layers only, and only those with a hit."""
    layers = ("DWD", "ODS")
    return catalog.search(_catalog(spark, sf_dir, layers), "t_77", prefer=("DWD",), layers=layers, require_hit=True)


@query(f"SELECT layer, name, columns, partition_columns, path FROM (SELECT layer, name, 'id=编号 ' || p_partkey || '|v=a, b' AS columns, 'dt' AS partition_columns, folder || '表' || p_partkey || '.sql' AS path FROM ({_ENTRIES}))")
def catalog_search_entries(spark, sf_dir):
    """What the search index holds of each entry."""
    found = sinks.search_entries(_catalog(spark, sf_dir))
    return found.select("layer", "name", F.array_join(F.transform("columns", lambda c: F.array_join(c, "=")), "|").alias("columns"), F.array_join("partition_columns", ",").alias("partition_columns"), "path")


@query(f"SELECT layer, name, layer || '.' || name || chr(10) || 'columns: id(编号 ' || p_partkey || '), v(a, b)' || chr(10) || 'partitions: dt' || chr(10) || 'detail: full/layer=' || layer AS card FROM ({_ENTRIES})")
def catalog_cards(spark, sf_dir):
    return sinks.full_card(_catalog(spark, sf_dir))


#: For every kind of text: the text by dialect and the codes that it should give.
_TEXTS = (
    ("SELECT id FROM {n} WHERE dt = '1'", ()),
    ("SELECT * FROM {n}", ("missing-where", "select-star")),
    ("SELECT id FROM t_{k} WHERE id = 1 /* dt */ ORDER BY v", ("missing-partition-filter", "hive-orderby-not-selected")),
    ("SELECT x::int AS y, (SELECT 1) FROM unknown_table JOIN u ON a = (SELECT 2) ORDER BY 1 -- DROP TABLE t", ("hive-legacy-postgres-cast", "hive-legacy-scalar-subquery-select", "hive-legacy-scalar-subquery-on", "hive-orderby-positional")),
    ("SELECT a.id FROM {n} a\njoin b ON a.i = b.i\nJOIN c ON a.i = c.i\njoin d ON a.i = d.i WHERE a.dt > '2'", ("many-joins",)),
    ("TRUNCATE TABLE {n}; SELECT 'all' AS x", ("destructive",)),
)


@query(" UNION ALL ".join(f"SELECT 'q' || p_partkey AS path, '{code}' AS code FROM part WHERE p_partkey % 6 = {k} AND (p_partkey % 6 < 5 OR '{code}' NOT LIKE 'missing%')" for k, (_, codes) in enumerate(_TEXTS) for code in codes))
def sql_lint(spark, sf_dir):
    """A SQL text for every part, on the table of another one, with the warnings that its kind gives."""
    key = F.col("p_partkey")
    other = key - key % 6  # a part of the first layer: its table is in the catalog
    named = F.concat(F.lit("ads.t_"), other.cast("string"))
    text = F.element_at(F.array(*(F.replace(F.replace(F.lit(t), F.lit("{n}"), named), F.lit("{k}"), other.cast("string")) for t, _ in _TEXTS)), (key % 6 + 1).cast("int"))
    texts = spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("q"), key.cast("string")).alias("path"), text.alias("sql"))
    return sqlcheck.check(texts, "hive-legacy", _catalog(spark, sf_dir)).select("path", "code")


#: What comes first, is selected, read, asked for and sorted by, in every combination.
_VARIED = _pieces(
    ("", "DROP TABLE a; ", "/* delete x */ ", "INSERT OVERWRITE TABLE t ", "-- update y|", "alter  TABLE b; "),
    ("SELECT *", "select id, v AS w", "SELECT DISTINCT *", "SELECT sum(v)::int AS s, a.id", "SELECT (SELECT max(x) FROM q) AS m, id", "SELECT ~*~, `id`", "SELECT explode(x) AS id"),
    (" FROM dw.t a", "|from t JOIN u ON a.i = u.i", " FROM t join u on (select 1) = u.i join w ON w.i = 2", " FROM t a JOIN b ON a.i=b.i|JOIN c ON 1=1 left join d ON d.i = a.i", " FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v) rn FROM s) z JOIN a ON 1=1 JOIN b ON 1=1 JOIN c ON 1=1"),
    ("", " WHERE dt = ~x~", " where v > 2 -- ORDER BY 7|", " WHERE a.dt IN (~1~, ~drop~)"),
    ("", " ORDER BY 1", " order by id DESC", " ORDER BY zz, id", " ORDER BY a.w LIMIT 5"),
)
_FLAT = "plain"
for _ in range(3):  # what stands in parentheses, from inside out: a mark, and another one for a subquery
    _FLAT = f"regexp_replace(regexp_replace({_FLAT}, '(?i)\\(\\s*select[^()]*\\)', '{{Q}}', 'g'), '\\([^()]*\\)', '{{}}', 'g')"


@query(f"""
WITH t AS (SELECT o_orderkey, regexp_replace(regexp_replace({_VARIED}, '/\\*.*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g') AS plain FROM orders),
f AS (SELECT o_orderkey, plain, {_FLAT} AS flat FROM t),
p AS (SELECT o_orderkey, plain, flat, regexp_extract(flat, '(?is)select\\s+(?:distinct\\s+)?(.*?)\\s+from\\s', 1) AS given, regexp_extract(flat, '(?is)order\\s+by\\s+(.*?)(?:\\s+limit\\s.*)?$', 1) AS sorts FROM f),
n AS (SELECT *, list_filter(list_transform(string_split(given, ','), lambda x: lower(regexp_extract(trim(x), '([A-Za-z_][A-Za-z_0-9]*)`?$', 1))), lambda x: x <> '') AS names,
  list_filter(list_transform(string_split(sorts, ','), lambda x: lower(regexp_extract(trim(regexp_replace(x, '(?i)\\s+(asc|desc)\\s*$', '')), '([A-Za-z_0-9]+)$', 1))), lambda x: x <> '') AS keys FROM p),
c AS (SELECT o_orderkey, unnest(list_filter([
  CASE WHEN regexp_matches(plain, '(?i)(^|\\W)(drop|truncate|delete|update|insert\\s+(overwrite|into)|create\\s+table|alter\\s+table)(\\W|$)') THEN 'destructive' END,
  CASE WHEN regexp_matches(plain, '(?i)\\bselect\\s+(distinct\\s+)?\\*') THEN 'select-star' END,
  CASE WHEN contains(plain, '::') THEN 'hive-legacy-postgres-cast' END,
  CASE WHEN len(regexp_extract_all(plain, '(?i)\\bjoin\\b')) >= 3 AND NOT contains(lower(plain), 'row_number') THEN 'many-joins' END,
  CASE WHEN len(list_filter(keys, lambda k: regexp_full_match(k, '[0-9]+'))) > 0 THEN 'hive-orderby-positional' END,
  CASE WHEN len(list_filter(keys, lambda k: NOT regexp_full_match(k, '[0-9]+') AND NOT list_contains(names, k))) > 0 THEN 'hive-orderby-not-selected' END,
  CASE WHEN contains(given, '{{Q}}') THEN 'hive-legacy-scalar-subquery-select' END,
  CASE WHEN regexp_matches(flat, '(?i)\\son\\s[^()]*\\{{Q\\}}') THEN 'hive-legacy-scalar-subquery-on' END], lambda x: x IS NOT NULL)) AS code FROM n),
g AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN contains(plain, '`') THEN 'gaussdb-backticks' END, CASE WHEN contains(lower(plain), 'explode(') THEN 'gaussdb-hive-only' END], lambda x: x IS NOT NULL)) AS code FROM t)
SELECT 'hive-legacy' AS dialect, o_orderkey, code FROM c UNION ALL SELECT 'gaussdb', o_orderkey, code FROM g
""")
def sql_flags(spark, sf_dir):
    """A text for every order, of pieces in all combinations, checked in two dialects; the twin reads the same texts with patterns of its own."""
    texts = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("path"), F.expr(_VARIED).alias("sql"))
    found = sqlcheck.check_dialects(texts, ["hive-legacy", "gaussdb"]).where("dialect = 'hive-legacy' OR code LIKE 'gaussdb%'")
    return found.select("dialect", F.col("path").cast("long").alias("o_orderkey"), "code")


@query("""
SELECT 'hive' AS dialect, 'hive-postgres-cast' AS code, count(*) AS n FROM part UNION ALL SELECT 'sparksql', 'hive-postgres-cast', count(*) FROM part
UNION ALL SELECT 'gaussdb', 'gaussdb-backticks', count(*) FROM part UNION ALL SELECT 'gaussdb', 'gaussdb-hive-only', count(*) FROM part WHERE p_partkey % 2 = 0
""")
def sql_dialects(spark, sf_dir):
    text = F.concat(F.lit("SELECT `a`::int AS b"), F.when(F.col("p_partkey") % 2 == 0, ", explode(c) AS d").otherwise(""), F.lit(" FROM t WHERE note = 'explode'"))
    texts = spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").cast("string").alias("path"), text.alias("sql"))
    return sqlcheck.check_dialects(texts, ["hive", "sparksql", "gaussdb"]).groupBy("dialect", "code").agg(F.count("*").alias("n"))


_FOLDER = (("/dw/01-ADS/", "/w/dws_etl/sub/", "/a/odsx/", "/x/DWD/ods/", "/dwt.old/"),)
_DEFINED = _pieces(*_FOLDER, ("m", "z", "表"), ("_def_#.sql",), key="p_partkey")
_FILLED = _pieces(*_FOLDER, key="p_partkey") + " || " + _pieces(("p_fill_#.sql",), key="p_partkey")
_DEFINITION = _pieces(
    ("CREATE TABLE ", "create external table if not exists ", "-- CREATE TABLE old.x (y INT)|CREATE TABLE IF NOT EXISTS "), ("ads.t_#", "t_#"),
    (" (id BIGINT COMMENT ~编号, 主键~, v DECIMAL(10, 2))", "|(|  `id` STRING,|  note STRING COMMENT ~a~ -- x, y|, PRIMARY KEY (id)|)", " (k INT NOT NULL DEFAULT 0, w DOUBLE)"),
    ("", " COMMENT ~表 #~"), ("", " PARTITIONED BY (dt STRING COMMENT ~日期~)", " PARTITIONED BY (dt STRING, h INT) STORED AS ORC"), ("", " TBLPROPERTIES (~comment~=~p #~)"), key="p_partkey", size=15,
)
_FILLING = _pieces(
    ("INSERT OVERWRITE TABLE ", "insert into table "), ("t_#", "ads.t_#"),
    (" SELECT DISTINCT id, sum(v)|FROM dwd.s1 o JOIN dim.shop s ON o.i = s.i -- FROM nowhere|GROUP BY id, o.dt", " SELECT id FROM (SELECT *, row_number() over (partition by id, dt order by ts desc) rn FROM ods.a) z WHERE rn = 1", " select id from t1 left join `t2` on 1=1 group by substr(id, 1, 2)|having count(*) > 1;"),
    key="p_partkey", size=7,
)
_BARE = "regexp_replace(regexp_replace({0}, '--[^\\n]*', ' ', 'g'), '`', '', 'g')"
#: The entries of a list at its own level, parentheses and quoted texts whole, without what surrounds them.
_ENTRIES_OF = "list_filter(list_transform(regexp_extract_all({0}, '(?:\\([^()]*\\)|\\x27[^\\x27]*\\x27|[^,()\\x27])+'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '')"
_COLUMN = "regexp_extract(x, '^(\\w+)', 1) || ':' || replace(regexp_extract(x, '^\\w+\\s+(\\w+(?:\\([^()]*\\))?)', 1), ', ', ',') || ':' || regexp_extract(x, '(?i)comment\\s+\\x27([^\\x27]*)', 1)"
_COLUMNS = "array_to_string(list_transform(list_filter({0}, lambda x: NOT regexp_matches(x, '(?i)^primary')), lambda x: " + _COLUMN + "), '|')"
_LAYERED = "coalesce(list_filter(list_transform(string_split(path, '/'), lambda p: upper(regexp_extract(p, '(?i)(?:^|[^a-z])(ADS|DWS|DWT|DWD|ODS)(?:$|[^a-z])', 1))), lambda p: p <> '')[1], 'UNKNOWN')"


@query(f"""
WITH d AS (SELECT p_partkey, {_DEFINED} AS path, {_BARE.format(_DEFINITION)} AS t FROM part), f AS (SELECT p_partkey, {_FILLED} AS path, {_BARE.format(_FILLING)} AS t FROM part),
d1 AS (SELECT *, regexp_extract(t, '(?is)create\\s+(?:external\\s+)?table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w.]+)', 1) AS name, regexp_extract(t, '(?s)\\w\\s*\\(((?:\\([^()]*\\)|[^()])*)\\)', 1) AS body, regexp_replace(t, '(?s)^.*?\\w\\s*\\((?:\\([^()]*\\)|[^()])*\\)', '') AS rest FROM d),
d2 AS (SELECT path, name, {_COLUMNS.format(_ENTRIES_OF.format("body"))} AS columns, {_COLUMNS.format(_ENTRIES_OF.format("regexp_extract(rest, '(?i)partitioned by \\(([^()]*)\\)', 1)"))} AS parts,
  coalesce(nullif(regexp_extract(regexp_replace(rest, '\\([^()]*\\)', '', 'g'), '(?i)comment\\s+\\x27([^\\x27]*)', 1), ''), regexp_extract(rest, '(?i)\\x27comment\\x27=\\x27([^\\x27]*)', 1)) AS told, NULL AS src, NULL AS grp, NULL AS keys, false AS is_distinct, false AS numbered FROM d1),
f2 AS (SELECT path, regexp_extract(t, '(?i)insert\\s+(?:overwrite|into)\\s+table\\s+([\\w.]+)', 1) AS name, '' AS columns, '' AS parts, '' AS told, regexp_extract_all(t, '(?i)\\b(?:from|join)\\s+([\\w.]+)', 1) AS src,
  {_ENTRIES_OF.format("regexp_extract(t, '(?is)group\\s+by\\s+(.*?)(?:\\s+having|;|$)', 1)")} AS grp, {_ENTRIES_OF.format("regexp_extract(t, '(?i)partition by (.*?) order', 1)")} AS keys, regexp_matches(t, '(?i)select\\s+distinct') AS is_distinct, contains(lower(t), 'row_number') AS numbered FROM f),
u AS (SELECT *, {_LAYERED} AS layer, regexp_extract(path, '([^/]*)$', 1) AS file FROM (SELECT * FROM d2 UNION ALL SELECT * FROM f2)),
q AS (SELECT u.*, CASE WHEN contains(u.name, '.') THEN u.name ELSE coalesce((SELECT arg_max(x.name, x.path) FROM u x WHERE x.layer = u.layer AND contains(x.name, '.') AND x.columns <> '' AND x.path <= u.path AND regexp_extract(x.name, '([^.]*)$', 1) = u.name), u.name) END AS whole FROM u)
SELECT layer, whole AS name, coalesce(arg_min(nullif(regexp_extract(file, '^([一-鿿][一-鿿\\w]*)', 1), ''), path) FILTER (WHERE regexp_matches(file, '^[一-鿿]')), '') AS description, coalesce(arg_min(told, path) FILTER (WHERE told <> ''), '') AS table_comment, string_agg(path, ',' ORDER BY path) AS sql_files,
  coalesce(arg_min(columns, path) FILTER (WHERE columns <> ''), '') AS columns, coalesce(arg_min(parts, path) FILTER (WHERE parts <> ''), '') AS partition_columns, coalesce(string_agg(array_to_string(src, ','), ',' ORDER BY path) FILTER (WHERE len(src) > 0), '') AS source_tables,
  coalesce(string_agg(array_to_string(grp, ';'), ';' ORDER BY path) FILTER (WHERE len(grp) > 0), '') AS group_by, coalesce(string_agg(array_to_string(keys, ';'), ';' ORDER BY path) FILTER (WHERE len(keys) > 0), '') AS row_number_keys, bool_or(is_distinct) AS has_distinct, bool_or(numbered) AS has_row_number
FROM q WHERE layer <> 'UNKNOWN' GROUP BY layer, whole
""")
def catalog_of_varied_files(spark, sf_dir):
    """Definitions and ETL texts for every part, of pieces in many combinations, in folders of all kinds; the twin reads the same texts with patterns of its own."""
    file = lambda path, text: F.struct(F.expr(path).alias("path"), F.expr(text).alias("text"))
    files = spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.explode(F.array(file(_DEFINED, _DEFINITION), file(_FILLED, _FILLING))).alias("f")).select("f.*")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["type"], x["comment"])), "|")
    signs = F.col("signals")
    return catalog.build(files).select(
        "layer", "name", "description", "table_comment", F.array_join("sql_files", ",").alias("sql_files"), told(F.col("columns")).alias("columns"), told(F.col("partition_columns")).alias("partition_columns"), F.array_join(signs["source_tables"], ",").alias("source_tables"),
        F.array_join(signs["group_by"], ";").alias("group_by"), F.array_join(signs["row_number_keys"], ";").alias("row_number_keys"), signs["has_distinct"].alias("has_distinct"), signs["has_row_number"].alias("has_row_number"),
    )


_ADVICE = {"click": "Which clicks?", "error": "Ask for the log", "view": "Which clicks?"}


@query("""
WITH t AS (SELECT event_type AS issue, count(*) AS n FROM events WHERE event_type IN ('click', 'error', 'view') AND event_id % 3 > 0 GROUP BY 1)
SELECT CASE issue WHEN 'error' THEN 'Ask for the log' ELSE 'Which clicks?' END AS advice, max(n) AS n, min(issue) AS issue FROM t GROUP BY 1
""")
def issue_advice(spark, sf_dir):
    """Issues of bad answers with what to ask; the same advice once."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, "Bad_case").otherwise("good").alias("label"), F.array("event_type").alias("issues"), F.lit(None).cast("struct<text:string,issues:array<string>>").alias("feedback"))
    return qalog.advice(qalog.top_issues(log), _ADVICE)


@query("SELECT event_id, 'k' || user_id AS key, 'a=' || event_type AS value FROM events")
def key_values(spark, sf_dir):
    pairs = F.array(F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("=a="), F.col("event_type")))
    found = table(spark, sf_dir, "events").select("event_id", qalog.pairs(pairs).alias("m"))
    return found.select("event_id", F.map_keys("m")[0].alias("key"), F.map_values("m")[0].alias("value"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT'")
def sql_parameters(spark, sf_dir):
    """A SQL text with {{name}} places."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("millrace_orders")
    return shapes.with_parameters(spark, "SELECT o_orderkey, o_custkey FROM millrace_orders WHERE o_orderdate >= CAST({{start_date}} AS TIMESTAMP_NTZ) AND o_orderpriority = {{priority}}", start_date="1998-01-01", priority="1-URGENT")


@query("SELECT c_custkey % 10 AS c, arg_max(c_custkey, c_custkey * 7 % 101 * 1000000 + c_custkey) AS last, arg_min(c_custkey, c_custkey * 7 % 101 * 1000000 + c_custkey) AS first FROM customer GROUP BY 1")
def first_and_last_rows(spark, sf_dir):
    """The first and the last row of each key."""
    from .operators import dedupe

    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("c"), "c_custkey", (F.col("c_custkey") * 7 % 101).alias("o"))
    last = dedupe.keep_first(rows, ["c"], "o", "c_custkey", last=True).select("c", F.col("c_custkey").alias("last"))
    return last.join(dedupe.keep_first(rows, ["c"], "o", "c_custkey").select("c", F.col("c_custkey").alias("first")), "c")
