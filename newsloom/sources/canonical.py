"""Adapters from the stored tables to the canonical news tables: outlets, articles, entities, fact-checks and their map.

The SQL of OUTLETS, ARTICLES and FACT_CHECKS is read alike by Spark and DuckDB; only un-nesting differs (ENTITIES)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OUTLETS = """
SELECT DISTINCT CAST(substr(source, 4) AS INT) + 1 AS id, source AS name,
  CASE CAST(substr(source, 4) AS INT) % 6 WHEN 0 THEN 'national_agency' WHEN 1 THEN 'news_aggregator' WHEN 2 THEN 'investigative'
    WHEN 3 THEN 'civic_news' WHEN 4 THEN 'regional_newspaper' ELSE 'fact_checker' END AS outlet_type
FROM documents"""
ARTICLES = """
SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS INT) + 1 AS outlet_id, substr(d.text, 1, 80) AS title, d.text AS content_text,
  DATE '2024-01-01' + CAST((d.doc_id * 37) % 180 AS INT) AS published_on, CAST((d.doc_id * 37) % 180 AS INT) AS day,
  e.embedding, CASE WHEN e.vec_id IS NULL THEN NULL ELSE 1 END AS cluster_run_id, e.label AS cluster_id,
  e.label * 100 + CAST(floor(((d.doc_id * 37) % 180) / 30.0) AS INT) AS sub_cluster_id,
  CASE WHEN l.toxic IS NULL THEN NULL ELSE l.toxic = 1 END AS is_excluded,
  CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 0 END AS is_templated,
  CASE d.n_chars % 5 WHEN 0 THEN 'politics' WHEN 1 THEN 'economy' WHEN 2 THEN 'justice' WHEN 3 THEN 'health' ELSE NULL END AS tf_topic,
  CASE d.n_chars % 6 WHEN 0 THEN 'conflict' WHEN 1 THEN 'human_interest' WHEN 2 THEN 'economic' WHEN 3 THEN 'morality' WHEN 4 THEN 'responsibility' ELSE NULL END AS tf_framing,
  CASE d.doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'politics' WHEN 2 THEN 'economy' WHEN 3 THEN 'justice' ELSE 'health' END AS llm_topic,
  CAST(d.n_chars % 101 AS DOUBLE) / 100 AS score_sensationalism,
  CASE WHEN d.n_chars % 7 = 0 THEN NULL ELSE CAST(d.n_chars % 89 AS DOUBLE) / 88 END AS score_citation_quality,
  CASE WHEN d.n_chars % 11 = 0 THEN NULL ELSE CAST(d.doc_id % 97 AS DOUBLE) / 96 END AS score_rhetoric_intensity,
  CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE CAST(d.doc_id % 53 AS DOUBLE) / 52 END AS tf_gov_stance_confidence,
  CASE WHEN d.n_chars % 4 = 0 THEN NULL ELSE CAST(d.doc_id % 31 AS DOUBLE) / 30 END AS tf_sovereignism_confidence,
  d.lang
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""
FACT_CHECKS = """
SELECT a.id, a.id AS article_id, a.outlet_id, CASE a.id % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'missing_context' ELSE 'satire' END AS verdict,
  CASE a.id % 4 WHEN 3 THEN 'context' ELSE 'verdict' END AS verdict_type, a.title AS claim_text, a.published_on, CAST(a.id % 5 AS INT) AS severity_score,
  a.embedding, a.cluster_run_id, a.cluster_id, a.sub_cluster_id, CAST(a.id % 100 AS DOUBLE) / 100 AS similarity
FROM articles a JOIN outlets o ON o.id = a.outlet_id WHERE o.outlet_type = 'fact_checker'"""
ENTITIES = {
    "spark": "SELECT doc_id AS article_id, e AS entity_text, {label} AS entity_label FROM documents LATERAL VIEW explode(array_distinct(regexp_extract_all(text, '([A-Z][a-z]{{3,}})', 1))) x AS e",
    "duckdb": "SELECT article_id, e AS entity_text, {label} AS entity_label FROM (SELECT doc_id AS article_id, unnest(list_distinct(regexp_extract_all(text, '([A-Z][a-z]{{3,}})', 1))) AS e FROM documents)",
}
ENTITIES = {k: v.format(label="CASE length(e) % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'GPE' WHEN 3 THEN 'LOC' ELSE 'EVENT' END") for k, v in ENTITIES.items()}


class News:
    """The canonical tables over one folder of Parquet tables, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        for name in tables:
            text = text.replace(f"FROM {name}", "FROM {" + name + "}").replace(f"JOIN {name}", "JOIN {" + name + "}")
        return self.spark.sql(text, **tables)

    @property
    def outlets(self) -> DataFrame:
        return self._sql(OUTLETS, documents=self.table("documents"))

    @property
    def articles(self) -> DataFrame:
        return self._sql(ARTICLES, documents=self.table("documents"), embeddings=self.table("embeddings"), labels=self.table("labels"))

    @property
    def fact_checks(self) -> DataFrame:
        return self._sql(FACT_CHECKS, articles=self.articles, outlets=self.outlets)

    @property
    def entities(self) -> DataFrame:
        return self.spark.sql(ENTITIES["spark"].replace("{3,}", "{{3,}}").replace("FROM documents", "FROM {documents}"), documents=self.table("documents"))

    @property
    def placed_entities(self) -> DataFrame:
        """The entities with their place among those found in the text."""
        text = ENTITIES["spark"].replace("{3,}", "{{3,}}").replace("FROM documents", "FROM {documents}")
        text = text.replace("LATERAL VIEW explode(", "LATERAL VIEW posexplode(").replace(") x AS e", ") x AS place, e").replace("SELECT doc_id AS article_id,", "SELECT doc_id AS article_id, place,")
        return self.spark.sql(text, documents=self.table("documents"))


def oracle(body: str) -> str:
    """DuckDB SQL of a query over the canonical tables; ``body`` may begin with further CTEs (``name AS (...)``)."""
    comma = "" if body.lstrip().startswith("SELECT") else ","
    return f"WITH outlets AS ({OUTLETS}), articles AS ({ARTICLES}), fact_checks AS ({FACT_CHECKS}), entities AS ({ENTITIES['duckdb']}){comma} {body}"
