"""Corpora of names, paths, opinions and catalogs made from TPC-H-like tables, for the registered queries.

Each is built from known columns with portable expressions, so that SQL can state the expected results from those
columns without parsing anything. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RES = "element_at(array('1080p','720p','2160p','576p','480p'), cast(l_partkey % 5 + 1 as int))"
SRC = "element_at(array('BluRay','WEB-DL','HDTV','WEBRip'), cast(l_suppkey % 4 + 1 as int))"
COD = "case l_returnflag when 'A' then 'x264' when 'R' then 'HEVC' else 'AV1' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each different (part name, line number, quantity, resolution, source, codec), with what it is made of."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_linenumber as season", "cast(l_quantity as int) as episode", f"{RES} as res", f"{SRC} as src", f"{COD} as codec")
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as l_partkey", "p_name", "p_type", "p_brand", "p_size")
    r = li.join(part, "l_partkey").select("p_name", "p_type", "p_brand", "season", "episode", "res", "src", "codec").distinct()
    return r.selectExpr("*", "concat(replace(p_name, ' ', '.'), '.S', lpad(season, 2, '0'), 'E', lpad(episode, 2, '0'), '.', res, '.', src, '.', codec, '.mkv') as name")


#: The same rows in SQL.
RELEASES_SQL = """
releases AS (
  SELECT DISTINCT p_name, p_type, p_brand, l_linenumber AS season, CAST(l_quantity AS INT) AS episode,
    (['1080p','720p','2160p','576p','480p'])[CAST(l_partkey % 5 + 1 AS INT)] AS res,
    (['BluRay','WEB-DL','HDTV','WEBRip'])[CAST(l_suppkey % 4 + 1 AS INT)] AS src,
    CASE l_returnflag WHEN 'A' THEN 'x264' WHEN 'R' THEN 'HEVC' ELSE 'AV1' END AS codec
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opinion for each order, provider and field among the order's lines: the least value, the largest confidence."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as file_id", "cast(l_linenumber % 6 as int) as feed_ord", "element_at(array('filename','dirname','file','wikipedia','tvmaze','tmdb'), cast(l_linenumber % 6 + 1 as int)) as provider",
        "element_at(array('season','episode','year','codec','resolution'), cast(l_suppkey % 5 + 1 as int)) as field", "cast(l_partkey % 3 + 1 as string) as value",
        "round(1 - 2 * l_discount, 2) as confidence", "(l_linenumber % 6 = 0 and l_suppkey % 10 < 3) as weak",
    )
    return li.groupBy("file_id", "provider", "feed_ord", "field").agg({"value": "min", "confidence": "max", "weak": "max"}).selectExpr(
        "file_id", "provider", "feed_ord", "field", "`min(value)` as value", "`max(confidence)` as confidence", "`max(weak)` as weak"
    )


OPINIONS_SQL = """
opinions AS (
  SELECT l_orderkey AS file_id, CAST(l_linenumber % 6 AS INT) AS feed_ord,
    (['filename','dirname','file','wikipedia','tvmaze','tmdb'])[CAST(l_linenumber % 6 + 1 AS INT)] AS provider,
    (['season','episode','year','codec','resolution'])[CAST(l_suppkey % 5 + 1 AS INT)] AS field,
    min(CAST(l_partkey % 3 + 1 AS VARCHAR)) AS value, max(round(1 - 2 * l_discount, 2)) AS confidence,
    bool_or(l_linenumber % 6 = 0 AND l_suppkey % 10 < 3) AS weak
  FROM lineitem GROUP BY ALL
), weights(field, provider, w) AS (VALUES
  ('season','wikipedia',5.0),('season','tvmaze',5.0),('season','tmdb',5.0),('season','filename',4.0),('season','dirname',2.0),('season','file',1.0),
  ('episode','wikipedia',5.0),('episode','tvmaze',5.0),('episode','tmdb',5.0),('episode','filename',4.0),('episode','dirname',2.0),('episode','file',1.0),
  ('year','tmdb',5.0),('year','wikipedia',4.0),('year','tvmaze',4.0),('year','dirname',1.0),('year','filename',1.0),
  ('resolution','file',5.0),('resolution','dirname',1.0),('resolution','filename',1.0),('codec','file',5.0),('codec','dirname',1.0),('codec','filename',1.0)
), voters AS (
  SELECT * FROM (SELECT *, field IN ('season','episode') AND weak AS wk, bool_or(NOT (field IN ('season','episode') AND weak)) OVER (PARTITION BY file_id, field) AS explicit FROM opinions)
  WHERE NOT (wk AND explicit)
), scored AS (
  SELECT v.*, CAST(coalesce(w, 1.0) AS DOUBLE) AS base, CAST(coalesce(w, 0.0) AS DOUBLE) AS listed,
    CAST(coalesce(w, 1.0) AS DOUBLE) * confidence * CASE WHEN wk THEN 0.5 ELSE 1.0 END AS eff
  FROM voters v LEFT JOIN weights w ON v.field = w.field AND v.provider = w.provider
), clusters AS (
  SELECT file_id, field, value, round(sum(eff), 9) AS score, max(listed) AS top, max(CASE WHEN provider = 'filename' THEN 1 ELSE 0 END) AS named,
    min(feed_ord) AS first_ord, avg(confidence) AS mean, max(confidence) AS most, count(*) AS n
  FROM scored GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, field ORDER BY score DESC, top DESC, named DESC, first_ord) AS rk,
    sum(score) OVER (PARTITION BY file_id, field) AS total FROM clusters
), verdicts AS (
  SELECT a.file_id, a.field, a.value, a.n, a.score, a.total, a.mean, a.most, coalesce(b.score, 0) AS run, b.score IS NOT NULL AND abs(a.score - b.score) < 1e-9 AS tied,
    CASE WHEN a.total > 0 THEN a.score / a.total ELSE 0 END AS share
  FROM ranked a LEFT JOIN ranked b ON a.file_id = b.file_id AND a.field = b.field AND b.rk = 2 WHERE a.rk = 1
), decided AS (
  SELECT *, CASE WHEN field IN ('season','episode') THEN
      CASE WHEN n >= 2 AND score > run AND share * mean >= 0.6 THEN 'accept' WHEN tied THEN 'skip'
           WHEN n = 1 AND abs(total - score) < 1e-9 AND score > 1.1 AND most >= 0.6 THEN 'accept' ELSE 'skip' END
    WHEN n >= 2 OR share >= 0.5 THEN 'accept' ELSE 'guess' END AS decision,
    least(CASE WHEN total = 0 THEN score ELSE score / total END * mean, 0.999) AS posterior
  FROM verdicts
)"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog: a show a brand, a season a size class, numbered by retail order; every seventh entry is a special."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand as show_id", "cast(p_size % 5 + 1 as int) as season", "cast(p_partkey % 40 + 1 as int) as number", "p_name as name",
        "case when p_partkey % 7 = 0 then 'special' else 'regular' end as type", "p_partkey as ord",
    )


EPISODES_SQL = """
episodes AS (
  SELECT p_brand AS show_id, CAST(p_size % 5 + 1 AS INT) AS season, CAST(p_partkey % 40 + 1 AS INT) AS number, p_name AS name,
    CASE WHEN p_partkey % 7 = 0 THEN 'special' ELSE 'regular' END AS type, p_partkey AS ord FROM part
)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that ask the catalog: one for each different part and line number."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_linenumber", "cast(l_quantity as int) as q").distinct()
    return li.join(table(spark, sf_dir, "part").selectExpr("p_partkey as l_partkey", "p_brand"), "l_partkey").selectExpr("l_partkey", "p_brand as show_id", "cast(l_linenumber % 5 + 1 as int) as season", "q as episode").distinct()


ASKED_SQL = """
asked AS (
  SELECT DISTINCT l_partkey, p_brand AS show_id, CAST(l_linenumber % 5 + 1 AS INT) AS season, CAST(l_quantity AS INT) AS episode
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
