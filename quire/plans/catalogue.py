"""The registered queries of the corpus engine, each with its SQL oracle.

Names follow the operators: search, order, runs, dictionaries, markup, aggregates,
placement, validation. Each reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import search as S
from quire.operators.ordering import global_index
from quire.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query in SQL; tables are written {table}. The oracle is the same text unless given."""
    import re

    names = sorted(set(re.findall(r"\{(\w+)\}", spark_sql)))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(spark_sql, **{n: table(spark, sf_dir, n) for n in names})
    ORACLES[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", spark_sql)


# ---- search ----------------------------------------------------------------

def _part_index(spark, sf_dir):
    return S.index(table(spark, sf_dir, "part"), "p_brand", "p_brand", "p_partkey", ["p_name", "p_type", "p_size"])


_SEARCH = """
WITH i AS (SELECT p_brand AS g, p_partkey AS item, lower(p_brand) AS label, lower(concat_ws(chr(10), p_name, p_type, cast(p_size AS varchar))) AS hay FROM part),
h AS (SELECT g, item, contains(label, '{q}') AS whole FROM i WHERE contains(label, '{q}') OR contains(hay, '{q}'))
SELECT g AS "group", CASE WHEN NOT bool_or(whole) THEN array_to_string(list(item ORDER BY item), ',') END AS items FROM h GROUP BY g"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("group", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("search_group_or_item", _SEARCH.format(q="ring"))
def search_group_or_item(spark, sf_dir):
    return _flat(S.search(_part_index(spark, sf_dir), " Ring "))


@query("search_label_hit", _SEARCH.format(q="brand#1"))
def search_label_hit(spark, sf_dir):
    return _flat(S.search(_part_index(spark, sf_dir), "Brand#1"))


@query("search_empty_query", _SEARCH.format(q=""))
def search_empty_query(spark, sf_dir):
    return _flat(S.search(_part_index(spark, sf_dir), "  "))


@query("search_limit", f"SELECT * FROM ({_SEARCH.format(q='a')}) ORDER BY \"group\" LIMIT 5")
def search_limit(spark, sf_dir):
    return _flat(S.search(_part_index(spark, sf_dir), "a", 5))


@query("search_alias_expand", """
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'DS' WHEN 1 THEN 'Francesco Fuscagni' WHEN 2 THEN 'fs' ELSE 'xds' END AS editor FROM customer),
a(k, o) AS (VALUES ('ds', 'daniel schwemer'), ('daniel schwemer', 'ds'), ('ff', 'francesco fuscagni'), ('francesco fuscagni', 'ff'))
SELECT c_custkey, concat_ws(chr(10), editor, o) AS editor FROM c LEFT JOIN a ON lower(trim(editor)) = k""")
def search_alias_expand(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'DS' WHEN 1 THEN 'Francesco Fuscagni' WHEN 2 THEN 'fs' ELSE 'xds' END AS editor")
    return S.with_aliases(c, "editor")



@query("search_missing_not_searchable", "SELECT d.doc_id AS item, lower(concat_ws(chr(10), d.source, l.quality)) AS hay FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT contains(lower(concat_ws(chr(10), d.source, l.quality)), '—')")
def search_missing_not_searchable(spark, sf_dir):
    """Missing values are no text of the index: the marker finds none of them."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    idx = S.index(rows, "source", "source", "doc_id", ["source", "quality"])
    return idx.where(~F.contains("hay", F.lit("—"))).select("item", "hay")


sql_query("search_dictionary_semijoin", """
SELECT l_returnflag, count(*) AS n FROM {lineitem} l
LEFT SEMI JOIN (SELECT DISTINCT l_linestatus AS s FROM {lineitem} WHERE contains(lower(l_linestatus), 'o')) d ON l.l_linestatus = d.s
GROUP BY l_returnflag""", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE contains(lower(l_linestatus), 'o') GROUP BY l_returnflag")

# ---- order, runs, numbering ----------------------------------------------------

_DUCK_KEY = """list_transform(regexp_extract_all({x}, '([0-9]+|[^0-9]+)'), lambda p: struct_pack(t := CASE WHEN regexp_matches(p, '^[0-9]') THEN 0 ELSE 1 END,
 n := CASE WHEN regexp_matches(p, '^[0-9]') AND length(ltrim(p, '0')) <= 20 THEN coalesce(CASE WHEN try_cast(p AS hugeint) <= 18446744073709551615 THEN try_cast(p AS hugeint) END, 0) ELSE 0 END,
 s := CASE WHEN regexp_matches(p, '^[0-9]') THEN '' ELSE translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END))"""


@query("natural_sort_rank", f"SELECT p_partkey, p_name, row_number() OVER (ORDER BY {_DUCK_KEY.format(x='p_type')}, {_DUCK_KEY.format(x='p_name')}, p_size, p_partkey) - 1 AS rank FROM part")
def natural_sort_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keys = [T.natural_key("p_type"), T.natural_key("p_name"), F.col("p_size"), F.col("p_partkey")]
    keyed = p.select("p_partkey", "p_name", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return global_index(keyed, [F.col(f"k{i}") for i in range(4)], "rank").select("p_partkey", "p_name", "rank")


@query("group_runs", """
WITH o AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
b AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY pos) IS NOT DISTINCT FROM event_type AND pos > 0 THEN 0 ELSE 1 END AS s FROM o),
r AS (SELECT *, sum(s) OVER (ORDER BY pos) AS run FROM b)
SELECT event_type, min(pos) AS first_pos, count(*) AS n FROM r GROUP BY run, event_type""")
def group_runs(spark, sf_dir):
    """Runs over a global order of events."""
    from quire.operators.inventory import with_runs

    e = global_index(table(spark, sf_dir, "events").select("ts", "event_id", "event_type"), [F.col("ts"), F.col("event_id")], "pos")
    runs = with_runs(e, F.col("event_type"), "pos")
    return runs.groupBy("run", "event_type").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).drop("run")


@query("row_number_global", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS no FROM orders")
def row_number_global(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_index(o, [F.col("o_totalprice"), F.col("o_orderkey")], "i").select("o_orderkey", (F.col("i") + 1).alias("no"))


# ---- gates and markup -----------------------------------------------------------------

_PATHS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('a/', page_id, '.xml') WHEN 1 THEN concat('__MACOSX/', page_id, '.xml') WHEN 2 THEN concat('a/._', page_id, '.XML') WHEN 3 THEN 'a/s.css.xml' WHEN 4 THEN 'a/b.xml/' ELSE 'n.txt' END AS path"


@query("path_gate", f"""SELECT page_id, path FROM ({_PATHS} FROM pages) WHERE NOT path LIKE '%/' AND lower(path) LIKE '%.xml' AND NOT lower(path) LIKE '%.css.xml'
AND len(list_filter(string_split(path, '/'), lambda s: lower(s) = '__macosx' OR starts_with(s, '.'))) = 0""")
def path_gate(spark, sf_dir):
    p = spark.sql(_PATHS + " FROM {pages}", pages=table(spark, sf_dir, "pages"))
    return p.where(T.is_document_path("path"))


@query("content_gate", "SELECT page_id FROM pages WHERE page_id % 7 = 0 OR lower(substr(replace(html, '<html', '<TEI'), 1, 4)) = '<tei'")
def content_gate(spark, sf_dir):
    """Markers in the first 16,384 bytes: some pages begin with one, the others have it just where the bytes end."""
    x = F.concat(F.when(F.col("page_id") % 7 == 0, F.lit("<AOxml/>")).otherwise(F.lit("")), F.repeat(F.lit("é"), 8190), F.lower(F.replace("html", F.lit("<html"), F.lit("<TEI"))))
    return table(spark, sf_dir, "pages").where(T.has_marker(T.byte_window(x, 16384))).select("page_id")


@query("strip_tags", r"""SELECT page_id, md5(regexp_replace(html, '<!\[CDATA\[(.*?)(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<[^>]*>|<.*\z', '\1', 'gs')) AS digest FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags("html").cast("binary")).alias("digest"))


@query("hrefs_exploded", """SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def hrefs_exploded(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


@query("find_year", "SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS year FROM documents")
def find_year(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.year_in("text").alias("year"))


@query("number_after_token", "SELECT p_partkey, nullif(rtrim(regexp_extract(p_brand, '(?i)brand#\\s*([0-9][0-9.]*)', 1), '.'), '') AS no FROM part")
def number_after_token(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.number_after("p_brand", "brand#").alias("no"))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat(' ', cast(o_orderdate AS {s})) WHEN 1 THEN '20170328' WHEN 2 THEN concat('in ', cast(o_orderdate AS {s})) WHEN 3 THEN concat(o_orderkey % 4000, '-01') ELSE cast(o_orderdate AS {s}) END AS d FROM "


@query("date_year", f"SELECT o_orderkey, CASE WHEN regexp_extract(d, '^\\s*([0-9]{{4}})', 1) BETWEEN '1900' AND '2100' THEN regexp_extract(d, '^\\s*([0-9]{{4}})', 1) END AS year FROM ({_DATES.format(s='varchar')}orders)")
def date_year(spark, sf_dir):
    dates = spark.sql(_DATES.format(s="string") + "{orders}", orders=table(spark, sf_dir, "orders"))
    return dates.select("o_orderkey", T.date_year("d").alias("year"))


# ---- aggregates -----------------------------------------------------------------------------

@query("best_credit", """SELECT l_orderkey, arg_min(l_suppkey, row(rank, no_year, l_linenumber, l_suppkey, l_partkey)) AS suppkey FROM
(SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS no_year FROM lineitem) GROUP BY l_orderkey""")
def best_credit(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = F.struct(rank.alias("r"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), "l_linenumber", "l_suppkey", "l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", order).alias("suppkey"))


sql_query("ranked_list", "SELECT source, string_agg(lang, ', ') WITHIN GROUP (ORDER BY n DESC, lang) AS langs FROM (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang) GROUP BY source",
          "SELECT source, string_agg(lang, ', ' ORDER BY n DESC, lang) AS langs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")

sql_query("md5_digest", "SELECT doc_id, md5(text) AS digest FROM {documents}")

# ---- placement, names, joins, validation ---------------------------------------------------------



_NAMES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(repeat('.', cast(1 + page_id % 4 AS int)), '') WHEN 1 THEN concat(url, chr(cast(1 + page_id % 31 AS int)), ' .') WHEN 2 THEN concat('.', page_id, chr(127)) WHEN 3 THEN '' WHEN 4 THEN '  ' ELSE concat(url, chr(92), '. ') END AS x FROM """
_ESCAPED = "replace(replace(replace(x, '/', '%2F'), chr(92), '%5C'), ':', '%3A')"
for _c in (*range(1, 32), 127):
    _ESCAPED = f"replace({_ESCAPED}, chr({_c}), '%{_c:02X}')"


@query("path_component", f"SELECT page_id, CASE WHEN y = '' OR starts_with(y, '.') THEN '_' || y ELSE y END AS name FROM (SELECT page_id, CASE WHEN rtrim(e, ' .') = '' THEN e ELSE rtrim(e, ' .') END AS y FROM (SELECT page_id, {_ESCAPED} AS e FROM ({_NAMES}pages)))")
def path_component(spark, sf_dir):
    """Names of dots, of spaces, empty, and with every control character."""
    names = spark.sql(_NAMES + "{pages}", pages=table(spark, sf_dir, "pages"))
    return names.select("page_id", T.path_component("x").alias("name"))


@query("href_encode", "SELECT p_partkey, './' || array_to_string(list_transform(string_split(p_brand || '/' || p_name || '.xml', '/'), lambda s: url_encode(s)), '/') AS href FROM part")
def href_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.href(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".xml"))).alias("href"))


@query("pdf_name", "SELECT p_partkey, regexp_replace(p_name || '.xml', '\\.xml$', '.pdf') AS pdf FROM part")
def pdf_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit(".xml")), r"\.xml$", ".pdf").alias("pdf"))




@query("anti_both_ways", "SELECT 'documents' AS missing_in, doc_id::VARCHAR AS relative FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'labels of documents', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_both_ways(spark, sf_dir):
    """Documents without a label, and labels without a document."""
    from quire.operators import export as E

    ids = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").cast("string").alias("relative"))
    return E.violations({"labels": ids("labels"), "documents": ids("documents")})


@query("validation_errors_top10", "SELECT message, count(*) OVER () AS n FROM (SELECT 'no label for ' || doc_id AS message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) ORDER BY message LIMIT 10")
def validation_errors_top10(spark, sf_dir):
    """The first ten faults and how many there are in all."""
    from quire.operators import export as E

    missing = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select(F.concat(F.lit("no label for "), "doc_id").alias("message"))
    return E.first_faults(missing)


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escape("html").cast("binary")).alias("digest"))


@query("union_pools", "SELECT v, row_number() OVER (ORDER BY pool, v) - 1 AS id FROM (SELECT DISTINCT 0 AS pool, p_brand AS v FROM part UNION ALL SELECT DISTINCT 1, p_type FROM part)")
def union_pools(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    both = p.select(F.lit(0).alias("pool"), F.col("p_brand").alias("v")).distinct().unionAll(p.select(F.lit(1), "p_type").distinct())
    return global_index(both, [F.col("pool"), F.col("v")], "id").select("v", "id")

# ---- the verified export ---------------------------------------------------------------------------

_MARKED = """SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<?xml version="1.0"?>' WHEN 2 THEN concat('<?xml-stylesheet href="a"?> <?keep ', page_id, '?>')
WHEN 3 THEN '<?XML version="1.1"?><?one?>  <?two?>' ELSE '<?open ' END, html) AS x FROM """
_PIS = r"""SELECT page_id, x, regexp_extract(x, '^[ \t\r\n]*(<\?(?:[^?]|\?[^>])*\?>[ \t\r\n]*)*', 0) AS prologue FROM m"""
_NORMAL = rf"""WITH m AS ({_MARKED}pages), p AS ({_PIS}), k AS (SELECT page_id, x, prologue,
list_filter(regexp_extract_all(prologue, '<\?(?:[^?]|\?[^>])*\?>'), lambda i: NOT regexp_matches(i, '^(?i)<\?(xml|xml-stylesheet)[ ?]')) AS kept FROM p)
SELECT page_id, len(kept) AS kept, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || coalesce(array_to_string(list_transform(kept, lambda i: i || chr(10)), ''), '') || substr(x, length(prologue) + 1)) AS digest FROM k"""


def _marked(spark, sf_dir):
    return spark.sql(_MARKED + "{pages}", pages=table(spark, sf_dir, "pages"))


@query("export_normalize", _NORMAL)
def export_normalize(spark, sf_dir):
    from quire.operators import export as E

    out = _marked(spark, sf_dir).withColumn("y", E.normalized("x"))
    return out.select("page_id", (F.size(E.instructions("y")) - 1).cast("long").alias("kept"), F.md5(F.col("y").cast("binary")).alias("digest"))


@query("export_distortions", """SELECT CASE page_id % 4 WHEN 1 THEN 'body differs' WHEN 2 THEN 'no declaration' WHEN 3 THEN 'instruction invented' END AS error, count(*) AS n FROM pages GROUP BY 1""")
def export_distortions(spark, sf_dir):
    """The proof against outputs that are right (one in four) or wrong in a known way."""
    from quire.operators import export as E

    kind, y = F.col("page_id") % 4, E.normalized("x")
    wrong = F.when(kind == 1, F.concat(y, F.lit("!"))).when(kind == 2, E.body("x")).when(kind == 3, F.replace(y, F.lit(E.DECLARATION), F.lit(E.DECLARATION + "<?new?>"))).otherwise(y)
    return _marked(spark, sf_dir).select(E.distortion("x", wrong).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


_PLACED = """WITH r AS (SELECT p_partkey, p_brand, p_name, 'a/' || p_type || '/' || p_partkey AS source, p_brand || '/' || p_name || '.xml' AS path FROM part)
SELECT p_partkey, source, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY p_partkey) = 1 THEN path ELSE p_brand || '/' || p_name || ' (' || split_part(source, '/', 2) || ').xml' END AS relative FROM r"""


def _placed(spark, sf_dir):
    from quire.operators import export as E

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.concat(F.lit("a/"), "p_type", F.lit("/"), "p_partkey").alias("source"))
    return E.place(parts, "p_brand", "p_name", "source", "p_partkey")


@query("export_place", f"SELECT p_partkey, relative, replace(relative, '.xml', '.pdf') AS pdf FROM ({_PLACED})")
def export_place(spark, sf_dir):
    return _placed(spark, sf_dir).select("p_partkey", "relative", "pdf")


@query("export_collisions", f"SELECT relative, count(*) AS n, min(source) AS first FROM ({_PLACED}) GROUP BY relative HAVING count(*) > 1")
def export_collisions(spark, sf_dir):
    from quire.operators import export as E

    return E.collisions(_placed(spark, sf_dir), "source")


@query("export_manifest", f"SELECT relative, '{{\"file\":\"' || relative || '\",\"source\":\"' || source || '\"}}' AS line FROM ({_PLACED})")
def export_manifest(spark, sf_dir):
    from quire.operators import export as E

    return E.manifest(_placed(spark, sf_dir), "source")


@query("export_violations", f"""WITH p AS (SELECT * FROM ({_PLACED})), d AS (SELECT relative FROM p WHERE p_partkey % 50 <> 0 UNION ALL SELECT 'x/' || p_partkey FROM p WHERE p_partkey % 70 = 0)
SELECT 'disk' AS missing_in, relative FROM (SELECT DISTINCT relative FROM p EXCEPT SELECT relative FROM d) UNION ALL SELECT 'placed of disk', relative FROM (SELECT DISTINCT relative FROM d EXCEPT SELECT relative FROM p)""")
def export_violations(spark, sf_dir):
    """A listing of the disk that lacks files and has strange ones, against the places."""
    from quire.operators import export as E

    placed = stage(_placed(spark, sf_dir), "placed")
    disk = placed.where("p_partkey % 50 <> 0").select("relative").unionByName(placed.where("p_partkey % 70 = 0").select(F.concat(F.lit("x/"), "p_partkey").alias("relative")))
    return E.violations({"placed": placed, "disk": disk})


@query("href_resolve", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '/' || p_name || '.xml' WHEN 1 THEN 'a+b/%zz ' || p_partkey END AS path FROM part""")
def href_resolve(spark, sf_dir):
    """Links that were encoded, odd ones, and those that would leave the package: the last lead nowhere."""
    from quire.operators import export as E

    p, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    good = T.href(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".xml")))
    link = F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("./a+b/%zz%20"), "p_partkey")).when(kind == 2, F.concat(F.lit("./%2e%2E/"), "p_partkey")).otherwise(F.concat(F.lit("/"), "p_name"))
    return p.select("p_partkey", E.resolve(link).alias("path"))


# The corpus from archive to package adds its queries to the same tables.
from quire.plans import corpus  # noqa: E402, F401
