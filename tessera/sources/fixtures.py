"""The wiki's tables as views over the driver's star schema. Each is one statement that Spark SQL and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Statements name the tables they read in braces.
VIEWS: dict[str, str] = {
    "fx_page": """SELECT p_partkey AS page_id, 0 AS namespace, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS title,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('Q', CAST(p_partkey AS STRING)) END AS item,
        (p_partkey * 7919) % 100003 AS latest_revision, p_brand AS brand, p_type AS kind FROM {part}""",
    "fx_linktarget": "SELECT DISTINCT p_brand AS lt_id, 10 AS namespace, p_brand AS title FROM {part}",
    "fx_templatelinks": "SELECT p_partkey AS from_id, 0 AS from_namespace, p_brand AS target_id FROM {part}",
    "fx_page_props": """SELECT p_partkey AS page_id, 'wikibase_item' AS name, concat('Q', CAST(p_partkey AS STRING)) AS value FROM {part} WHERE p_partkey % 5 <> 0
        UNION ALL SELECT p_partkey, 'displaytitle', p_name FROM {part} WHERE p_partkey % 3 = 0""",
    "fx_categorylinks": """SELECT concat('R', CAST(n_regionkey AS STRING)) AS parent, concat('N', CAST(n_nationkey AS STRING)) AS child, 'subcat' AS kind, CAST(NULL AS BIGINT) AS page_id FROM {nation}
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)), 'subcat', CAST(NULL AS BIGINT) FROM {nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT concat('N', CAST(s_nationkey AS STRING)), concat('S', CAST(s_suppkey AS STRING)), 'page', s_suppkey FROM {supplier}""",
    "fx_claims": """SELECT o_orderkey AS claim_id, concat('Q', CAST(o_custkey AS STRING)) AS item, concat('P', substring(o_orderpriority, 1, 1)) AS property,
        CASE o_orderstatus WHEN 'F' THEN 'deprecated' WHEN 'O' THEN 'normal' ELSE 'preferred' END AS rank,
        CASE WHEN o_orderkey % 3 > 0 THEN concat('Q', CAST((o_orderkey * 31) % 997 AS STRING)) END AS item_value,
        CASE WHEN o_orderkey % 3 = 0 THEN concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Quebec ' ELSE 'tt' END, CAST((o_orderkey * 17) % 401 AS STRING)) END AS text_value, o_totalprice AS amount,
        CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM {orders}""",
    "fx_subclass": "SELECT DISTINCT p_brand AS child, p_type AS parent FROM {part} UNION SELECT DISTINCT p_type, 'root' FROM {part}",
    "fx_history": """SELECT concat('Q', CAST(o_custkey AS STRING)) AS item, o_orderkey AS rev,
        concat(CASE WHEN o_orderstatus = 'F' THEN '/* wbremoveclaims-remove:1| */ [[Property:P' ELSE '/* wbsetclaim-create:2||1 */ [[Property:P' END, substring(o_orderpriority, 1, 1), ']]: ',
        CASE WHEN o_orderkey % 3 > 0 THEN concat('[[Q', CAST((o_orderkey * 31) % 997 AS STRING), ']]') ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Quebec ' ELSE 'tt' END, CAST((o_orderkey * 17) % 401 AS STRING)) END,
        CASE WHEN o_orderkey % 7 = 0 THEN ', and more' ELSE '' END) AS comment FROM {orders}""",
    # (JSON braces are written ‹ ›, as the statements name their tables in braces)
    "fx_property": """SELECT r_regionkey AS n, translate(concat('‹"id":"P', CAST(r_regionkey + 1 AS STRING), '","datatype":"', CASE r_regionkey WHEN 0 THEN 'external-id' WHEN 1 THEN 'quantity' WHEN 2 THEN 'wikibase-item' WHEN 3 THEN 'geo-shape' ELSE 'time' END,
        '","labels":‹', CASE WHEN r_regionkey % 2 = 0 THEN concat('"en":‹"value":"', lower(r_name), '"›') ELSE '' END, '›,"claims":‹',
        CASE WHEN r_regionkey = 4 THEN '"P31":[‹"rank":"normal","mainsnak":‹"snaktype":"value","datavalue":‹"value":‹"id":"Q18644427"››››],' ELSE '' END,
        '"P1630":[‹"rank":"deprecated","mainsnak":‹"snaktype":"value","datavalue":‹"value":"http://old/$1"›››,‹"rank":"normal","mainsnak":‹"snaktype":"value","datavalue":‹"value":"https://x.org/', lower(r_name), '/$1"›››],',
        '"P2302":[‹"rank":"normal","mainsnak":‹"snaktype":"value","datavalue":‹"value":‹"id":"Q21502404"›››,"qualifiers":‹"P1793":[‹"snaktype":"value","datavalue":‹"value":"tt[0-9]+"››],"P2316":[‹"snaktype":"value","datavalue":‹"value":‹"id":"Q21502408"›››]››,',
        '‹"rank":"normal","mainsnak":‹"snaktype":"value","datavalue":‹"value":‹"id":"Q21510860"›››,"qualifiers":‹"P2313":[‹"snaktype":"value","datavalue":‹"value":‹"amount":"+10"›››],"P2312":[‹"snaktype":"novalue"›]››,',
        '‹"rank":"normal","mainsnak":‹"snaktype":"value","datavalue":‹"value":‹"id":"Q99"›››,"qualifiers":‹"P2316":[‹"snaktype":"value","datavalue":‹"value":‹"id":"Q62026391"›››]››]››'), '‹›', concat(chr(123), chr(125))) AS json FROM {region}""",
    "fx_run": """SELECT user_id AS id, user_id % 7 AS user_id, CASE event_type WHEN 'view' THEN 'loading' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'editing' WHEN 'signup' THEN 'paused' ELSE 'done' END AS status,
        CAST(NULL AS STRING) AS message, CASE WHEN event_type IN ('purchase', 'error') THEN event_id END AS started, CASE WHEN event_type = 'error' THEN event_id + 5 END AS finished, event_id AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM {events}) WHERE nth = 1""",
    "fx_run_row": """SELECT user_id AS run_id, event_id AS seq, event_id % 97 AS page_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Q', CAST(event_id % 97 AS STRING)) END AS item,
        CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'lost' END AS status,
        round(value, 2) AS value FROM {events}""",
    "fx_share": """SELECT n_nationkey AS id, n_name AS title, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_regionkey END AS user_id, concat('user ', CAST(n_regionkey AS STRING)) AS user_name,
        CASE WHEN n_nationkey % 5 = 0 THEN 100 + n_nationkey END AS legacy_id FROM {nation}""",
    "fx_share_tag": """SELECT n_nationkey AS share_id, lower(n_name) AS tag FROM {nation} WHERE n_nationkey % 4 <> 0
        UNION ALL SELECT n_nationkey, concat('region-', CAST(n_regionkey AS STRING)) FROM {nation} WHERE n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0""",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or one of the driver's tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: view(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def with_views(sql: str) -> str:
    """SQL for DuckDB with the fixture views that it names as common table expressions."""
    named = [n for n in VIEWS if n in sql]
    ctes = []
    for n in named:
        body = VIEWS[n]
        for t in _TABLES:
            body = body.replace("{" + t + "}", t)
        ctes.append(f"{n} AS ({body})")
    if not ctes:
        return sql
    head, rest = ("WITH RECURSIVE ", sql.strip()[len("WITH RECURSIVE ") :]) if sql.strip().upper().startswith("WITH RECURSIVE") else ("WITH ", sql.strip())
    if head == "WITH " and rest.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {rest[5:]}"
    return f"{head}{', '.join(ctes)}{', ' if head != 'WITH ' else ' '}{rest}"
