"""The reference queries over the stored tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import vectors
from newsloom.functions.stems import romanian
from newsloom.functions.wordlists import BYLINES, COMMON_NOUNS, HUBS, NER_STOPWORDS, PARTIES, STOPWORDS
from newsloom.operators import analytics as A
from newsloom.operators import clustering as C
from newsloom.operators import density as D
from newsloom.operators import entities as N
from newsloom.operators import factchecks as K
from newsloom.operators import graph as G
from newsloom.operators import labelling as L
from newsloom.operators import neighbours as V
from newsloom.operators import search as S
from newsloom.operators import sinks
from newsloom.sources import extraction as X
from newsloom.sources import pages as P
from newsloom.sources.canonical import News, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}

TOPICS = ["politics", "economy", "justice", "health"]
FRAMINGS = ["conflict", "human_interest", "economic", "morality", "responsibility"]
EN = {"tier1": ["the", "loser", "idiot"], "tier2": ["of the", "and", "onan"]}


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(News(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _pct(column: str, values: list[str]) -> str:
    cols = ", ".join(f"round(100.0 * count(*) FILTER ({column} = '{v}') / count(*), 2) AS {v}_pct" for v in values)
    return oracle(f"SELECT o.name AS outlet_name, count(*) AS total, {cols} FROM articles a JOIN outlets o ON a.outlet_id = o.id WHERE {column} IS NOT NULL GROUP BY o.name")


def _mode(column: str) -> str:
    return f"(SELECT outlet_id, {column} AS v FROM (SELECT outlet_id, {column}, row_number() OVER (PARTITION BY outlet_id ORDER BY count(*) DESC, {column}) AS k FROM articles WHERE {column} IS NOT NULL GROUP BY outlet_id, {column}) WHERE k = 1)"


@query(oracle(f"""SELECT o.id, o.name, o.outlet_type, count(a.id) AS total_articles, round(avg(score_sensationalism), 6) AS avg_sensationalism, round(avg(score_citation_quality), 6) AS avg_citation_quality,
    round(avg(score_rhetoric_intensity), 6) AS avg_rhetoric, any_value(t.v) AS dominant_topic, any_value(f.v) AS dominant_framing
    FROM outlets o LEFT JOIN articles a ON a.outlet_id = o.id LEFT JOIN {_mode('tf_topic')} t ON t.outlet_id = o.id LEFT JOIN {_mode('tf_framing')} f ON f.outlet_id = o.id GROUP BY o.id, o.name, o.outlet_type"""))
def outlet_summary(n: News) -> DataFrame:
    return A.outlet_summary(n.articles, n.outlets)


@query(oracle("""SELECT o.name AS outlet_name, round(avg(tf_gov_stance_confidence), 6) AS coalition_axis, round(avg(tf_sovereignism_confidence), 6) AS eu_axis, count(*) AS article_count
    FROM articles a JOIN outlets o ON a.outlet_id = o.id WHERE tf_gov_stance_confidence IS NOT NULL AND tf_sovereignism_confidence IS NOT NULL GROUP BY o.name"""))
def bias_chart(n: News) -> DataFrame:
    return A.bias_chart(n.articles, n.outlets)


@query(oracle("""SELECT o.name AS outlet_name, round(avg(score_sensationalism), 3) AS sensationalism, round(avg(score_citation_quality), 3) AS citation_quality, round(avg(score_rhetoric_intensity), 3) AS rhetoric, count(score_citation_quality) AS n_cited
    FROM articles a JOIN outlets o ON a.outlet_id = o.id GROUP BY o.name"""))
def scores_comparison(n: News) -> DataFrame:
    return A.scores_comparison(n.articles, n.outlets)


@query(_pct("tf_topic", TOPICS))
def topic_distribution(n: News) -> DataFrame:
    return A.distribution(n.articles, n.outlets, "tf_topic", TOPICS)


@query(_pct("tf_framing", FRAMINGS))
def framing_distribution(n: News) -> DataFrame:
    return A.distribution(n.articles, n.outlets, "tf_framing", FRAMINGS)


@query(oracle("""SELECT name, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY outlet_id), 2) AS pct FROM
    (SELECT outlet_id, tf_framing AS label, count(*) AS n FROM articles WHERE tf_framing IS NOT NULL GROUP BY ALL) c JOIN outlets o ON o.id = c.outlet_id"""))
def label_distribution(n: News) -> DataFrame:
    return A.label_distribution(n.articles, n.outlets, "tf_framing")


@query(oracle("""SELECT id, outlet_id, title, published_on, tf_topic, cluster_key, name FROM (SELECT id, outlet_id, title, published_on, tf_topic, coalesce(cluster_id, -1) AS cluster_key FROM articles WHERE tf_topic = 'politics' ORDER BY published_on DESC, id LIMIT 20 OFFSET 20) a
    LEFT JOIN (SELECT id AS o_id, name FROM outlets) o ON a.outlet_id = o.o_id"""))
def article_page(n: News) -> DataFrame:
    return A.article_page(n.articles, n.outlets, topic="politics", page=2)


@query(oracle("""SELECT a.id AS article_id, title, published_on, tf_topic, (SELECT string_agg(entity_label || ':' || entity_text, '|' ORDER BY entity_label || ':' || entity_text) FROM entities WHERE article_id = 5) AS entities,
    (SELECT string_agg(verdict, '|' ORDER BY verdict) FROM fact_checks WHERE article_id = 5) AS verdicts FROM articles a WHERE a.id = 5"""))
def article_detail(n: News) -> DataFrame:
    return A.article_detail(n.articles, n.entities, n.fact_checks, 5)


@query(oracle("SELECT id, llm_topic, tf_topic, llm_topic = tf_topic AS agree FROM articles WHERE llm_topic IS NOT NULL AND tf_topic IS NOT NULL ORDER BY id LIMIT 50"))
def llm_vs_model(n: News) -> DataFrame:
    return A.llm_vs_model(n.articles)


@query(oracle("""l AS (SELECT cluster_run_id, sub_cluster_id AS cluster, count(*) AS article_count, count(DISTINCT outlet_id) AS outlet_count, min(published_on) AS date_from, max(published_on) AS date_to FROM articles WHERE cluster_run_id IS NOT NULL AND sub_cluster_id IS NOT NULL GROUP BY ALL)
    SELECT * FROM l WHERE date_to >= DATE '2024-02-01' AND date_from <= DATE '2024-03-01' AND outlet_count > 1 AND EXISTS (SELECT 1 FROM articles a WHERE a.cluster_run_id = l.cluster_run_id AND a.sub_cluster_id = l.cluster AND a.is_excluded IS NOT TRUE)
    ORDER BY article_count DESC, cluster LIMIT 20"""))
def cluster_list(n: News) -> DataFrame:
    return A.cluster_list(n.articles, event=True, date_from="2024-02-01", date_to="2024-03-01")


@query(oracle("SELECT sub_cluster_id AS cluster, max(published_on) AS newest, count(*) AS n FROM articles WHERE sub_cluster_id IS NOT NULL GROUP BY 1 ORDER BY newest DESC, cluster LIMIT 25"))
def cluster_recent_sort(n: News) -> DataFrame:
    return A.cluster_recent(n.articles)


@query(oracle("SELECT o.name, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id) AS article_ids, count(*) AS n FROM articles a JOIN outlets o ON o.id = a.outlet_id WHERE cluster_id = 3 AND is_excluded IS NOT TRUE GROUP BY o.name"))
def cluster_members(n: News) -> DataFrame:
    return A.cluster_members(n.articles, n.outlets, 3)


@query(oracle("""SELECT p.cluster_id, (SELECT count(*) FROM outlets) AS total_outlets, len(present) AS covering_outlets, array_to_string(present, ',') AS present,
    coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM outlets WHERE NOT list_contains(p.present, name)), '') AS missing
    FROM (SELECT cluster_id, list_sort(list(DISTINCT o.name)) AS present FROM articles a JOIN outlets o ON o.id = a.outlet_id WHERE cluster_id IS NOT NULL GROUP BY 1) p"""))
def coverage_gaps(n: News) -> DataFrame:
    return A.coverage_gaps(n.articles, n.outlets)


@query(oracle("""SELECT s.sub_cluster_id, article_count, outlet_count, covering, category, round(ln(1 + article_count) * type_count, 4) AS popularity, round(ln(1 + article_count) * type_count * (1 - outlet_count / 7), 4) AS gap FROM
    (SELECT sub_cluster_id, count(*) AS article_count, count(DISTINCT o.id) FILTER (o.outlet_type <> 'national_agency') AS outlet_count, count(DISTINCT o.outlet_type) FILTER (o.outlet_type <> 'national_agency') AS type_count,
      coalesce(array_to_string(list_sort(list(DISTINCT o.name) FILTER (o.outlet_type <> 'national_agency')), ','), '') AS covering FROM articles a JOIN outlets o ON o.id = a.outlet_id WHERE sub_cluster_id IS NOT NULL GROUP BY 1) s
    LEFT JOIN (SELECT sub_cluster_id, CASE WHEN len(r) > 1 AND r[1].n = r[2].n THEN r[1].t || ' / ' || r[2].t ELSE r[1].t END AS category FROM
      (SELECT sub_cluster_id, list({'n': n, 't': tf_topic} ORDER BY n DESC, tf_topic) AS r FROM (SELECT sub_cluster_id, tf_topic, count(*) AS n FROM articles WHERE tf_topic IS NOT NULL AND sub_cluster_id IS NOT NULL GROUP BY ALL) GROUP BY 1)) m ON m.sub_cluster_id = s.sub_cluster_id
    WHERE outlet_count > 0 AND ln(1 + article_count) * type_count >= 3.0"""))
def coverage_metrics(n: News) -> DataFrame:
    return A.coverage_metrics(n.articles, n.outlets)


@query(oracle("""SELECT 'unscored' AS what, count(*) AS n FROM articles WHERE score_citation_quality IS NULL AND length(content_text) >= 200 UNION ALL
    SELECT 'unsummarised', count(*) FROM (SELECT sub_cluster_id, count(*) AS c FROM articles WHERE cluster_run_id IS NOT NULL AND sub_cluster_id IS NOT NULL GROUP BY 1) WHERE c BETWEEN 4 AND 60 AND sub_cluster_id NOT IN (101, 203)"""))
def backlog_counters(n: News) -> DataFrame:
    return A.backlog(n.articles, n.spark.sql("SELECT * FROM VALUES (101), (203) AS t(cluster)"))


@query(oracle("SELECT outlet_id, count(*) AS n, count(embedding) AS embedded, count(tf_topic) AS with_topic, count(cluster_id) AS clustered FROM articles GROUP BY 1"))
def completeness(n: News) -> DataFrame:
    return A.completeness(n.articles)


@query(oracle("""SELECT * FROM (SELECT id, outlet_id, row_number() OVER (PARTITION BY outlet_id ORDER BY id) AS k FROM (SELECT id, outlet_id, row_number() OVER (PARTITION BY outlet_id ORDER BY id) AS rn, count(*) OVER (PARTITION BY outlet_id) AS total FROM articles) WHERE rn % greatest(total // 10, 1) = 0) WHERE k <= 10"""))
def systematic_sample(n: News) -> DataFrame:
    return A.systematic_sample(n.articles, 10)


@query(oracle("""SELECT * FROM (SELECT id, outlet_id, signal, row_number() OVER (PARTITION BY outlet_id ORDER BY signal, id) AS rn FROM (SELECT id, outlet_id, CASE WHEN title ILIKE '%the %' OR title ILIKE '%que%' THEN 0 ELSE 1 END AS signal FROM articles)) WHERE rn <= 15"""))
def stratified_candidates(n: News) -> DataFrame:
    return A.stratified_candidates(n.articles, ["%the %", "%que%"], 15)


@query(oracle("""SELECT id, q.outlet_id, lack, rn FROM (SELECT a.id, a.outlet_id, t.lack, row_number() OVER (PARTITION BY a.outlet_id ORDER BY a.id) AS rn FROM articles a
    JOIN (SELECT outlet_id, 45 - count(llm_topic) AS lack FROM articles GROUP BY 1) t ON t.outlet_id = a.outlet_id WHERE a.llm_topic IS NULL AND lack > 0) q WHERE rn <= 2 * lack"""))
def label_quota(n: News) -> DataFrame:
    return A.quota(n.articles, n.outlets.select(F.col("id").alias("outlet_id"), F.lit(45).alias("target")), "llm_topic")


@query(oracle("SELECT id, tf_topic IS NOT DISTINCT FROM 'health' AS is_excluded FROM articles"))
def materialised_exclusions(n: News) -> DataFrame:
    found = n.articles.where("tf_topic IN ('health', 'justice')").select(F.col("id").alias("article_id"), F.when(F.col("tf_topic") == "health", 0.8).otherwise(0.5).alias("confidence"))
    return A.materialised_flag(n.articles, found)


@query(oracle("""SELECT count(*) FILTER (NOT is_templated AND NOT is_excluded) AS null_dropped, count(*) FILTER (is_templated = false OR is_templated IS NULL) AS null_kept,
    count(*) FILTER (NOT coalesce(is_excluded, false) AND tf_topic IN ('politics', 'health')) AS coalesced FROM articles"""))
def flag_readings(n: News) -> DataFrame:
    return A.overlap_filter(n.articles)


#: A run for each outlet: some without a date, some that are not completed.
_RUNS = """SELECT outlet_id AS id, CASE WHEN outlet_id % 5 <> 1 THEN DATE '2024-02-01' + CAST(count(*) % 9 AS INT) END AS created_at, CASE WHEN outlet_id % 4 <> 0 THEN max(published_on) END AS completed_at,
    count(sub_cluster_id) % 2 = 0 AS has_event FROM articles GROUP BY outlet_id"""
_NEWEST = "ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 1"


def _runs(n: News) -> DataFrame:
    return n.spark.sql(_RUNS.replace("FROM articles", "FROM {articles}"), articles=n.articles)


@query(oracle(f"""runs AS ({_RUNS}) SELECT 'max_id' AS mode, max(id) AS id FROM runs UNION ALL SELECT 'max_completed', max(id) FROM runs WHERE completed_at IS NOT NULL
    UNION ALL SELECT 'newest', id FROM (SELECT id FROM runs {_NEWEST}) UNION ALL SELECT 'newest_event', id FROM (SELECT id FROM runs WHERE has_event {_NEWEST})"""))
def latest_run(n: News) -> DataFrame:
    runs = _runs(n)
    out = [A.latest_run(runs, m).select(F.lit(m).alias("mode"), "id") for m in ("max_id", "max_completed", "newest", "newest_event")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


# Fact-checks.
@query(oracle("SELECT id, outlet_id, verdict, verdict_type, published_on FROM fact_checks WHERE verdict = 'true' ORDER BY published_on DESC, id LIMIT 20"))
def factcheck_list(n: News) -> DataFrame:
    return K.fact_check_list(n.fact_checks, verdict="true")


@query(oracle("SELECT id, verdict, similarity FROM fact_checks WHERE cluster_run_id = 1 AND cluster_id = 3"))
def factcheck_by_cluster(n: News) -> DataFrame:
    return K.by_cluster(n.fact_checks, 1, 3)


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_NEAR = f"SELECT f.id, f.verdict, 1 - {_COS.format(a='f.embedding', b='q.embedding')} AS distance FROM fact_checks f, (SELECT id, embedding FROM articles WHERE id = 7) q WHERE f.embedding IS NOT NULL AND f.id <> q.id"


@query(oracle(f"SELECT id, verdict, round(distance, 6) AS distance FROM ({_NEAR}) WHERE distance < 0.75 ORDER BY distance, id LIMIT 10"))
def factcheck_proximity(n: News) -> DataFrame:
    return K.proximity(n.fact_checks, n.articles.where("id = 7"), 0.75)


@query(oracle(f"SELECT article, id, round(distance, 6) AS distance FROM (SELECT a.id AS article, f.id, 1 - {_COS.format(a='a.embedding', b='f.embedding')} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY 1 - {_COS.format(a='a.embedding', b='f.embedding')}, f.id) AS rn FROM articles a JOIN fact_checks f ON a.id <> f.id WHERE a.embedding IS NOT NULL AND f.embedding IS NOT NULL AND a.id % 100 = 0) WHERE rn <= 10 AND distance < 0.75"))
def factcheck_proximity_indexed(n: News) -> DataFrame:
    checks = V.prepared(n.fact_checks, "id", V.unit("embedding"))
    return K.nearest_checks(V.build(checks), n.articles.where("id % 100 = 0"), 0.75)


@query(oracle(f"""SELECT id, verdict, 1 AS tier FROM fact_checks WHERE cluster_id = (SELECT cluster_id FROM articles WHERE id = 7) UNION ALL
    SELECT id, verdict, 2 FROM (SELECT * FROM ({_NEAR}) WHERE distance < 0.9 ORDER BY distance, id LIMIT 10) WHERE id NOT IN (SELECT id FROM fact_checks WHERE cluster_id = (SELECT cluster_id FROM articles WHERE id = 7))"""))
def factcheck_by_article(n: News) -> DataFrame:
    return K.by_article(n.fact_checks, n.articles.where("id = 7"), 0.9)


@query(oracle("SELECT cluster_run_id, cluster_id, count(*) AS factcheck_count, max(severity_score) AS max_severity, max(severity_score) >= 3 AS severe, max(similarity) AS similarity FROM fact_checks WHERE cluster_run_id IS NOT NULL GROUP BY 1, 2"))
def factcheck_badge(n: News) -> DataFrame:
    return K.badge(n.fact_checks)


_CENTRE = """(SELECT cluster, list(m / norm ORDER BY pos) AS centroid, max(n) AS n FROM (SELECT cluster, pos, m, n, sqrt(sum(m * m) OVER (PARTITION BY cluster)) AS norm FROM
    (SELECT cluster, pos, avg(x) AS m, count(*) AS n FROM (SELECT cluster_id AS cluster, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM articles WHERE cluster_id IS NOT NULL AND embedding IS NOT NULL AND is_templated IS NOT TRUE) GROUP BY 1, 2)) GROUP BY 1)"""


@query(oracle(f"SELECT cluster, n, round(centroid[1], 6) AS c0, round(centroid[32], 6) AS c31, round(list_sum(centroid), 6) AS total FROM {_CENTRE}"))
def centroids(n: News) -> DataFrame:
    out = C.centroids(n.articles, "cluster_id")
    return out.select("cluster", "n", F.round(F.col("centroid")[0], 6).alias("c0"), F.round(F.col("centroid")[31], 6).alias("c31"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(oracle(f"SELECT id, cluster, rn, round(cos, 6) AS cos FROM (SELECT f.id, c.cluster, {_COS.format(a='f.embedding', b='c.centroid')} AS cos, row_number() OVER (PARTITION BY f.id ORDER BY cos DESC, c.cluster) AS rn FROM fact_checks f, {_CENTRE} c WHERE f.embedding IS NOT NULL AND {_COS.format(a='f.embedding', b='c.centroid')} >= 0.1) WHERE rn <= 3"))
def coarse_match_top3(n: News) -> DataFrame:
    return K.coarse_matches(n.fact_checks, C.centroids(n.articles, "cluster_id").select("cluster", "centroid"), 0.1)


@query(oracle(f"""SELECT a.cluster_id AS cluster, any_value(c.n) AS n, round(avg({_COS.format(a='a.embedding', b='b.embedding')}), 6) AS mean_pairwise_cosine, avg({_COS.format(a='a.embedding', b='b.embedding')}) >= 0 AS cohesive
    FROM articles a JOIN articles b ON a.cluster_id = b.cluster_id AND a.id <> b.id JOIN (SELECT cluster_id, count(*) AS n FROM articles WHERE embedding IS NOT NULL GROUP BY 1) c ON c.cluster_id = a.cluster_id WHERE c.n >= 4 GROUP BY 1"""))
def cohesion(n: News) -> DataFrame:
    return C.cohesion(n.articles, "cluster_id", floor=0.0)


@query(oracle("SELECT f.id AS check_id, max(CAST(len(list_intersect(f.r, t.r)) > 0 AS INT)) AS shares FROM (SELECT id, cluster_id, {r} AS r FROM (SELECT id, cluster_id, claim_text AS x FROM fact_checks WHERE cluster_id IS NOT NULL)) f JOIN (SELECT cluster_id, {r} AS r FROM (SELECT cluster_id, title AS x, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn FROM articles WHERE cluster_id IS NOT NULL) WHERE rn <= 10) t ON t.cluster_id = f.cluster_id GROUP BY 1".replace("{r}", """list_transform(list_filter(list_transform(regexp_split_to_array(lower(x), '\\s+'), lambda w: regexp_replace(w, '^[.,!?"''()„”:\\-–—]+|[.,!?"''()„”:\\-–—]+$', '', 'g')), lambda w: length(w) > 4), lambda w: substr(w, 1, 5))""")))
def keyword_overlap(n: News) -> DataFrame:
    return K.keyword_guard(n.fact_checks, n.articles)


@query(oracle("SELECT sub_cluster_id, string_agg(title, ' | ' ORDER BY rn) AS titles FROM (SELECT sub_cluster_id, title, row_number() OVER (PARTITION BY sub_cluster_id ORDER BY published_on, id) AS rn FROM articles WHERE sub_cluster_id IS NOT NULL) WHERE rn <= 8 GROUP BY 1"))
def earliest_titles(n: News) -> DataFrame:
    return K.earliest_titles(n.articles)


@query(oracle("SELECT id, CASE WHEN p >= 0.7 THEN cluster END AS cluster, round(p, 6) AS similarity FROM (SELECT id, cluster_id AS cluster, 1 / (1 + exp(-((id % 7) - 3.0))) AS p FROM fact_checks WHERE cluster_id IS NOT NULL)"))
def reranked_assignment(n: News) -> DataFrame:
    return K.assign(n.fact_checks.where("cluster_id IS NOT NULL").select("id", F.col("cluster_id").alias("cluster"), ((F.col("id") % 7) - 3.0).alias("logit")), 0.7)


# Entities and their graph.
_CANON = """cn AS (SELECT entity_text AS raw, first_value(entity_text) OVER (PARTITION BY array_to_string(list_sort(string_split(lower(entity_text), ' ')), ' ') ORDER BY n DESC, length(entity_text) DESC, entity_text) AS canonical
      FROM (SELECT entity_text, count(*) AS n FROM entities WHERE NOT regexp_matches(lower(trim(entity_text)), '[.](ro|com|net|org|eu)$') AND lower(trim(entity_text)) NOT IN ({stops}) GROUP BY 1)),
    ce AS (SELECT article_id, canonical AS entity_text, entity_label FROM entities JOIN cn ON raw = entity_text WHERE lower(canonical) NOT IN ({bylines})),
    hh AS (SELECT entity_text, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM (SELECT entity_text, outlet_id, count(*) AS c FROM ce JOIN articles a ON a.id = ce.article_id WHERE entity_label = 'PERSON' GROUP BY ALL) GROUP BY 1),
    ml AS (SELECT entity_text, entity_label FROM (SELECT entity_text, entity_label, row_number() OVER (PARTITION BY entity_text ORDER BY count(*) DESC, entity_label) AS k FROM ce GROUP BY 1, 2) WHERE k = 1),
    ge AS (SELECT article_id, entity_text FROM ce WHERE entity_text NOT IN (SELECT hh.entity_text FROM hh JOIN ml USING (entity_text) WHERE round(entropy, 6) < 0.3 AND ml.entity_label = 'PERSON'))""".format(stops=_quoted(NER_STOPWORDS), bylines=_quoted(G.WIRE_SERVICES + BYLINES))
_EDGES = _CANON + """, m AS (SELECT DISTINCT article_id, entity_text FROM ge), c AS (SELECT entity_text, count(*) AS c FROM m GROUP BY 1), r AS (SELECT a.entity_text AS source, b.entity_text AS target, count(*) AS weight_raw FROM m a JOIN m b ON a.article_id = b.article_id AND a.entity_text < b.entity_text GROUP BY 1, 2 HAVING count(*) >= 5),
    edges AS (SELECT * FROM (SELECT source, target, weight_raw, round(ln(weight_raw * CAST((SELECT count(*) FROM documents WHERE length(text) > 0) AS DOUBLE) / (x.c * y.c)), 6) AS weight_pmi FROM r JOIN c x ON x.entity_text = source JOIN c y ON y.entity_text = target) WHERE weight_pmi > 0),
    e2 AS (SELECT source AS a, target AS b, weight_raw, weight_pmi FROM edges UNION ALL SELECT target, source, weight_raw, weight_pmi FROM edges), deg AS (SELECT a AS node, count(*) AS degree FROM e2 GROUP BY 1)"""


def _graph_sql(body: str) -> str:
    return oracle(_EDGES + " " + body)


def _edges(n: News) -> DataFrame:
    return sinks.checkpointed(G.edges(G.graph_entities(n.entities, n.articles), n.articles))


@query(_graph_sql("SELECT * FROM edges"))
def comention_pmi(n: News) -> DataFrame:
    return _edges(n)


@query(_graph_sql("SELECT b AS neighbour, weight_raw, weight_pmi FROM e2 WHERE lower(a) = 'with' ORDER BY weight_pmi DESC, neighbour LIMIT 50"))
def entity_neighbours(n: News) -> DataFrame:
    return G.neighbours(_edges(n), "with")


@query(_graph_sql("SELECT min(degree) AS cutoff FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS n FROM deg) WHERE k >= floor(0.999 * n)"))
def hub_cutoff(n: News) -> DataFrame:
    return G.hub_cutoff(_edges(n))


_PATHS = """cand AS (SELECT *, row_number() OVER (ORDER BY cost, path) AS nth FROM (SELECT 'With > That' AS path, round(1 / weight_pmi, 6) AS cost, 1 AS hops, CAST([] AS VARCHAR[]) AS inn, [weight_pmi] AS pmi, [weight_raw] AS raw FROM e2 WHERE a = 'With' AND b = 'That' UNION ALL
    SELECT 'With > ' || x.b || ' > That', round(1 / x.weight_pmi + y.weight_pmi ** -1, 6), 2, [x.b], [x.weight_pmi, y.weight_pmi], [x.weight_raw, y.weight_raw] FROM e2 x JOIN e2 y ON x.b = y.a WHERE x.a = 'With' AND y.b = 'That' AND x.b <> 'That' AND y.a <> 'With' UNION ALL
    SELECT 'With > ' || x.b || ' > ' || z.a || ' > That', round(1 / x.weight_pmi + 1 / y.weight_pmi + 1 / z.weight_pmi, 6), 3, [x.b, z.a], [x.weight_pmi, y.weight_pmi, z.weight_pmi], [x.weight_raw, y.weight_raw, z.weight_raw] FROM e2 x JOIN e2 y ON x.b = y.a JOIN e2 z ON y.b = z.a WHERE x.a = 'With' AND z.b = 'That' AND x.b <> 'That' AND z.a <> 'With') ORDER BY cost, path LIMIT 100)"""
_SCORED = f"""cut AS (SELECT min(degree) AS cutoff FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS n FROM deg) WHERE k >= floor(0.999 * n)), hub AS (SELECT DISTINCT lower(node) AS node FROM deg, cut WHERE degree >= cutoff),
    inn AS (SELECT nth, d.node, degree, lower(d.node) IN (SELECT node FROM hub) OR lower(d.node) IN ({_quoted(HUBS)}) OR contains(d.node, '+') OR lower(trim(d.node)) IN ({_quoted(COMMON_NOUNS)}) OR regexp_matches(trim(d.node), '^\\p{{Ll}}\\S*$')
      OR len(list_intersect(list_distinct(string_split(trim(d.node), ' ')), [{_quoted(PARTIES)}])) >= 2 OR regexp_matches(trim(d.node), '^({'|'.join(PARTIES)})\\s+\\p{{Lu}}') AS bad FROM (SELECT nth, unnest(inn) AS node FROM cand) u JOIN deg d ON d.node = u.node),
    pen AS (SELECT nth, bool_or(bad) AS bad, sum(ln(ln(1 + degree))) AS penalty FROM inn GROUP BY 1), mk AS (SELECT c.*, coalesce(bad, false) AS bad, coalesce(penalty, 0) AS penalty FROM cand c LEFT JOIN pen USING (nth)),
    sc AS (SELECT path, cost, hops, inn, nth, round(exp(list_avg(list_transform(pmi, lambda x: ln(x)))) * ln(1 + exp(list_avg(list_transform(raw, lambda x: ln(x))))) * exp(-penalty), 6) AS score FROM mk WHERE CASE WHEN (SELECT bool_or(NOT bad) FROM mk) THEN NOT bad ELSE nth <= 20 END)"""
_GREEDY = """ord AS (SELECT *, row_number() OVER (ORDER BY score DESC, nth) AS r FROM sc),
    fold AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS kept UNION ALL
      SELECT o.r, CASE WHEN len(f.kept) < 5 AND NOT list_has_any(f.used, o.inn) THEN list_concat(f.used, o.inn) ELSE f.used END, CASE WHEN len(f.kept) < 5 AND NOT list_has_any(f.used, o.inn) THEN list_append(f.kept, o.r) ELSE f.kept END FROM fold f JOIN ord o ON o.r = f.r + 1)
    SELECT CAST(list_position(k.kept, o.r) - 1 AS INT) AS path_id, o.path, o.cost, o.hops, o.score FROM ord o, (SELECT kept FROM fold ORDER BY r DESC LIMIT 1) k WHERE list_contains(k.kept, o.r)"""


def _candidates(n: News) -> tuple[DataFrame, DataFrame]:
    e = _edges(n)
    return e, G.path_candidates(e, "With", "That", least_raw=5, least_pmi=0.0)


@query(oracle(f"{_EDGES}, {_PATHS} SELECT path, cost, hops FROM cand"))
def paths_candidates(n: News) -> DataFrame:
    return _candidates(n)[1].select("path", "cost", "hops")


@query(oracle(f"{_EDGES}, {_PATHS}, {_SCORED} SELECT path, cost, hops, score FROM sc"))
def paths_scored(n: News) -> DataFrame:
    return G.scored_paths(*_candidates(n)).select("path", "cost", "hops", "score")


@query(oracle(f"{_EDGES}, {_PATHS}, {_SCORED}, {_GREEDY}").replace("WITH outlets", "WITH RECURSIVE outlets", 1))
def paths_disjoint(n: News) -> DataFrame:
    return G.disjoint_paths(G.scored_paths(*_candidates(n)))


@query(oracle(_EDGES + ", reach AS (SELECT a AS node, a AS root FROM e2 UNION SELECT e2.b, r.root FROM reach r JOIN e2 ON e2.a = r.node ), comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) AS largest, (SELECT count(*) FROM edges) AS edges FROM (SELECT c, count(*) AS n FROM comp GROUP BY 1)").replace("WITH outlets", "WITH RECURSIVE outlets", 1))
def graph_stats(n: News) -> DataFrame:
    return G.graph_stats(_edges(n))


@query(_graph_sql("""SELECT name, CAST(starts_with(lower(name), 'on') AS INT) AS starts, coalesce(degree, 0) AS degree, article_count FROM (SELECT entity_text AS name, count(DISTINCT article_id) AS article_count FROM entities GROUP BY 1) t LEFT JOIN deg ON deg.node = t.name
    WHERE contains(lower(name), 'on') ORDER BY starts DESC, degree DESC, article_count DESC, name LIMIT 10"""))
def entity_autocomplete(n: News) -> DataFrame:
    return G.autocomplete(n.entities, _edges(n), "on")


@query(oracle("""SELECT outlet_id, id, published_on FROM (SELECT outlet_id, id, published_on, row_number() OVER (PARTITION BY outlet_id ORDER BY published_on DESC, id) AS rn FROM articles WHERE id IN (SELECT article_id FROM entities WHERE entity_text = 'With') AND id IN (SELECT article_id FROM entities WHERE entity_text = 'That') AND (is_excluded = false OR is_excluded IS NULL)) WHERE rn = 1"""))
def edge_articles_one_per_outlet(n: News) -> DataFrame:
    return G.edge_articles(n.entities, n.articles, "With", "That")


_STEPS = """, way AS (SELECT path_id, string_split(path, ' > ') AS n FROM chosen), steps AS (SELECT path_id, step, n[step + 1] AS source, n[step + 2] AS target FROM (SELECT path_id, n, CAST(unnest(range(len(n) - 1)) AS INT) AS step FROM way)),
    named AS (SELECT s.*, a.id, a.outlet_id, a.published_on FROM steps s JOIN articles a ON a.id IN (SELECT article_id FROM entities WHERE entity_text = s.source) AND a.id IN (SELECT article_id FROM entities WHERE entity_text = s.target) WHERE a.is_excluded = false OR a.is_excluded IS NULL),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_id, step, outlet_id ORDER BY published_on DESC, id) AS k FROM named) WHERE k = 1)
    SELECT path_id, step, source, target, CAST(rank AS INT) AS rank, id, outlet_id, published_on FROM (SELECT *, row_number() OVER (PARTITION BY path_id, step ORDER BY published_on DESC, id) AS rank FROM one) WHERE rank <= 10"""
_CHOSEN = _GREEDY.rsplit("    SELECT CAST(list_position", 1)


@query(oracle(f"{_EDGES}, {_PATHS}, {_SCORED}, {_CHOSEN[0].rstrip()}, chosen AS (SELECT CAST(list_position{_CHOSEN[1]}){_STEPS}").replace("WITH outlets", "WITH RECURSIVE outlets", 1))
def path_articles(n: News) -> DataFrame:
    """The articles of each edge of each chosen path."""
    return G.path_articles(G.disjoint_paths(G.scored_paths(*_candidates(n))), n.entities, n.articles)


@query(oracle("SELECT id, outlet_id, published_on FROM articles WHERE id IN (SELECT article_id FROM entities WHERE entity_text = 'With') AND id IN (SELECT article_id FROM entities WHERE entity_text = 'That') ORDER BY published_on DESC, id LIMIT 20"))
def direct_articles(n: News) -> DataFrame:
    return G.direct_articles(n.entities, n.articles, "With", "That")


@query(oracle("SELECT id, title, published_on FROM articles WHERE id IN (SELECT article_id FROM entities WHERE lower(entity_text) = 'with') ORDER BY published_on DESC, id LIMIT 50"))
def entity_articles(n: News) -> DataFrame:
    return G.entity_articles(n.entities, n.articles, "with")


@query(oracle("""SELECT raw, canonical FROM (SELECT entity_text AS raw, first_value(entity_text) OVER (PARTITION BY array_to_string(list_sort(string_split(lower(entity_text), ' ')), ' ') ORDER BY n DESC, length(entity_text) DESC, entity_text) AS canonical FROM
    (SELECT entity_text, count(*) AS n FROM (SELECT CASE WHEN article_id % 3 = 0 THEN 'With ' || entity_text WHEN article_id % 3 = 1 THEN entity_text || ' With' ELSE entity_text END AS entity_text FROM entities) GROUP BY 1))"""))
def canonical_entities(n: News) -> DataFrame:
    name = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("With "), "entity_text")).when(F.col("article_id") % 3 == 1, F.concat("entity_text", F.lit(" With"))).otherwise(F.col("entity_text"))
    return G.canonical_entities(n.entities.select(name.alias("entity_text")))


@query(oracle("""SELECT entity_text, CAST(sum(c) AS BIGINT) AS n, abs(round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6)) AS entropy FROM (SELECT entity_text, outlet_id, count(*) AS c FROM entities e JOIN articles a ON a.id = e.article_id GROUP BY ALL) GROUP BY 1"""))
def outlet_entropy(n: News) -> DataFrame:
    return G.outlet_entropy(n.entities, n.articles)


@query(oracle("""h AS (SELECT entity_text, abs(round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6)) AS entropy FROM (SELECT entity_text, outlet_id, count(*) AS c FROM entities e JOIN articles a ON a.id = e.article_id WHERE entity_label = 'PERSON' GROUP BY ALL) GROUP BY 1)
    SELECT article_id, entity_text, entity_label FROM entities WHERE lower(entity_text) NOT IN ('reuters', 'afp', 'ap', 'associated press', 'mediafax', 'agerpres') AND NOT (entity_label = 'PERSON' AND entity_text IN (SELECT entity_text FROM h WHERE entropy < 0.3))"""))
def without_bylines(n: News) -> DataFrame:
    return G.without_bylines(n.entities, n.articles)


@query(oracle("""t AS (SELECT DISTINCT entity_text AS name FROM entities), g AS (SELECT name, list_distinct(list_transform(range(1, length(name) + 2), lambda i: substr('  ' || lower(name) || ' ', i, 3))) AS g FROM t), q AS (SELECT list_distinct(list_transform(range(1, length('Thatone') + 2), lambda i: substr('  thatone ', i, 3))) AS q)
    SELECT * FROM (SELECT name, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS similarity FROM g, q) WHERE similarity >= 0.3"""))
def similar_names(n: News) -> DataFrame:
    return G.similar_names(n.entities.select(F.col("entity_text").alias("name")).distinct(), "Thatone")


@query(oracle("SELECT lower(trim(a)) AS author, count(*) AS n FROM (SELECT DISTINCT id, unnest(['Author ' || outlet_id, ' AUTHOR ' || (id % 7) || ' ']) AS a FROM articles) GROUP BY 1"))
def author_blocklist(n: News) -> DataFrame:
    authors = n.articles.select("id", F.explode(F.array(F.concat(F.lit("Author "), F.col("outlet_id").cast("string")), F.concat(F.lit(" AUTHOR "), (F.col("id") % 7).cast("string"), F.lit(" ")))).alias("a")).distinct()
    return authors.groupBy(F.lower(F.trim("a")).alias("author")).agg(F.count(F.lit(1)).alias("n"))


@query(oracle("""SELECT cluster, string_agg(entity_text, ',' ORDER BY rn) AS entities FROM (SELECT cluster_id AS cluster, entity_text, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, entity_text) AS rn FROM entities e JOIN articles a ON a.id = e.article_id WHERE cluster_id IS NOT NULL AND entity_label IN ('PERSON', 'ORGANIZATION', 'GPE') AND length(entity_text) >= 3 GROUP BY cluster_id, entity_text) WHERE rn <= 5 GROUP BY 1"""))
def top_entities(n: News) -> DataFrame:
    return C.top_entities(n.articles, n.entities, "cluster_id")


# Text scores.
_OCC = "((length({t}) - length(replace({t}, '{x}', ''))) / {n})"


def _occ(text: str, terms: list[str]) -> str:
    return " + ".join(_OCC.format(t=text, x=t.replace("'", "''"), n=len(t)) for t in terms)


def _hits(terms: list[str]) -> str:
    return " + ".join(f"CAST(contains(p, '{t}') AS INT)" if " " in t else f"CAST(contains(' ' || regexp_replace(p, '[^a-z0-9_]', ' ', 'g') || ' ', ' {t} ') AS INT)" for t in terms)


_NORM = "lower(translate({}, 'ăâîșțşţĂÂÎŞŢ', 'aaiststAAIST'))"
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"


@query(oracle(f"""SELECT id, CASE WHEN length(trim(t)) = 0 THEN 0.0 ELSE round(0.20 * least(1.0, ({_occ('t', ['!'])} + {_occ('t', ['?'])}) / 3) + 0.15 * least(1.0, s / 2) + 0.35 * least(1.0, h1) + 0.15 * CASE WHEN h1 > 0 THEN least(1.0, h2 / 2) ELSE least(1.0, greatest(0, h2 - 1) / 2) END
    + 0.10 * CASE WHEN regexp_matches(t, '^\\d+\\s+[A-Za-z0-9_]+') THEN 1.0 ELSE 0.0 END + 0.05 * least(1.0, greatest(0.0, (w - 8) / 12)), 4) END AS score FROM
    (SELECT id, t, p, len(list_filter(regexp_split_to_array(t, '[^A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z]{{5,}}'))) AS s, {_hits(EN['tier1'])} AS h1, {_hits(EN['tier2'])} AS h2, {_WORDS.format('t')} AS w FROM (SELECT id, title AS t, {_NORM.format('title')} AS p FROM articles))"""))
def sensationalism(n: News) -> DataFrame:
    return n.articles.select("id", T.sensationalism(F.col("title"), EN["tier1"], EN["tier2"]).alias("score"))


@query(oracle(f"""SELECT id, CASE WHEN length(c) < 100 THEN 0.5 ELSE round(0.45 * least(1.0, ({_occ('p', T.ATTRIBUTION)}) * 1000 / greatest(w, 1) / 6) + 0.20 * (1 - least(1.0, CASE WHEN n_ent > 0 THEN v * (1 - 0.5 * least(1.0, n_ent / greatest(w / 100, 1.0))) ELSE v END / 3))
    + 0.15 * (1 - least(1.0, ({_occ('p', T.SPECULATION)}) * 1000 / greatest(w, 1) / 3)) + 0.20 * least(1.0, ({_occ('c', ['„'])} + {_occ('c', ['«'])}) * 1000 / greatest(w, 1) / 2), 4) END AS score FROM
    (SELECT a.id, c, p, w, coalesce(e.n_ent, 0) AS n_ent, ({_occ('p', T.VAGUE)}) * 1000 / greatest(w, 1) AS v FROM (SELECT id, content_text AS c, {_NORM.format('content_text')} AS p, {_WORDS.format('content_text')} AS w FROM articles) a LEFT JOIN (SELECT article_id, count(*) AS n_ent FROM entities GROUP BY 1) e ON e.article_id = a.id)"""))
def citation_quality(n: News) -> DataFrame:
    ents = n.entities.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n_ent"))
    return n.articles.select("id", "content_text").join(ents, "id", "left").select("id", T.citation_quality(F.col("content_text"), F.coalesce("n_ent", F.lit(0))).alias("score"))


# A title of each article begins with one of these, by the remainder of its id.
_VERDICT_HEADS = [("FALS: ", "false"), ("Parțial fals | ", "partially_false"), ("SCAM I ", "scam"), ("Deep fake: ", "deepfake"), ("FAKE NEWS ", "fake_news"), ("TEORIA CONSPIRAȚIEI: ", "conspiracy_theory"), ("Despre ", None)]
_HEADS = ", ".join(f"({k}, '{h}', {'NULL' if v is None else repr(v)})" for k, (h, v) in enumerate(_VERDICT_HEADS))


@query(oracle(f"""h(k, head, verdict) AS (VALUES {_HEADS}) SELECT id, verdict, CASE WHEN verdict = 'fake_news' THEN trim(regexp_replace(w, '^[Ii][ \t]*', '')) WHEN verdict IS NOT NULL THEN w END AS claim_text
    FROM (SELECT id, verdict, regexp_extract(title, '[A-Za-z]{{3,}}( [A-Za-z]{{3,}})*') || '.' AS w FROM articles JOIN h ON k = id % {len(_VERDICT_HEADS)} WHERE regexp_matches(title, '[A-Za-z]{{3,}}'))"""))
def verdict_parse(n: News) -> DataFrame:
    words = F.regexp_extract("title", "[A-Za-z]{3,}( [A-Za-z]{3,})*", 0)
    head = F.element_at(F.array(*(F.lit(h) for h, _ in _VERDICT_HEADS)), (F.col("id") % len(_VERDICT_HEADS) + 1).cast("int"))
    rows = n.articles.where(words != "").select("id", T.verdict(F.concat(head, words, F.lit("."))).alias("v"))
    return rows.select("id", "v.verdict", "v.claim_text")


_MONTH_NAMES = ", ".join(f"'{m}'" for m in T.MONTHS)
_RAW_DATE = f"""CASE CAST(id % 5 AS INT) WHEN 0 THEN day(d) || ' ' || [{_MONTH_NAMES}][month(d)] || ' ' || year(d) || ' ora 10:30' WHEN 1 THEN day(d) || ' ' || [{_MONTH_NAMES}][month(d)] || ' ' || year(d) WHEN 2 THEN strftime(d, '%d.%m.%Y') WHEN 3 THEN strftime(d, '%Y-%m-%dT%H:%M:%S') ELSE 'fără dată' END"""


@query(oracle(f"SELECT id, {_RAW_DATE} AS raw, CASE CAST(id % 5 AS INT) WHEN 0 THEN CAST(d AS TIMESTAMP) + INTERVAL 630 MINUTE WHEN 4 THEN NULL ELSE CAST(d AS TIMESTAMP) END AS parsed FROM (SELECT id, published_on AS d FROM articles)"))
def date_parsers(n: News) -> DataFrame:
    d = F.col("published_on")
    named = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(F.array(*map(F.lit, T.MONTHS)), F.month(d)), F.year(d).cast("string"))
    kind = F.col("id") % 5
    raw = F.when(kind == 0, F.concat(named, F.lit(" ora 10:30"))).when(kind == 1, named).when(kind == 2, F.date_format(d, "dd.MM.yyyy")).when(kind == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("fără dată")
    return n.articles.select("id", raw.alias("raw")).select("id", "raw", T.any_date(F.col("raw")).cast("timestamp_ntz").alias("parsed"))


def _ballot(k: int) -> str:
    return f"CASE (n_chars + doc_id * {k}) % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'a' END"


#: Of two or three votes each, some unusable.
_BALLOTS = f"SELECT doc_id AS id, {_ballot(1)} AS v0, {_ballot(2)} AS v1, CASE WHEN doc_id % 7 > 0 THEN {_ballot(4)} END AS v2, doc_id % 7 > 0 AS three FROM documents"
_PAIR = "CASE WHEN v0 = v1 THEN v0 WHEN v0 = v2 THEN v0 WHEN v1 = v2 THEN v1 END"
_USABLE = "list_filter([v0, v1, v2], lambda x: x IS NOT NULL)"


def _votes(n: News, rule: str) -> DataFrame:
    rows = n.spark.sql(_BALLOTS.replace("FROM documents", "FROM {documents}"), documents=n.table("documents"))
    votes = F.when(F.col("three"), F.array("v0", "v1", "v2")).otherwise(F.array("v0", "v1"))
    return rows.select("id", T.vote(votes, rule).alias("v")).select("id", "v.value", "v.confidence")


@query(f"SELECT id, {_PAIR} AS value, CASE WHEN v0 = v1 THEN 'high' WHEN {_PAIR} IS NOT NULL THEN 'low' END AS confidence FROM ({_BALLOTS})")
def votes_labeler(n: News) -> DataFrame:
    return _votes(n, "labeler")


@query(f"""SELECT id, CASE WHEN v0 IS NOT NULL THEN CASE WHEN u[1] = u[2] THEN u[1] ELSE {_PAIR} END END AS value, CASE WHEN v0 IS NOT NULL THEN CASE WHEN u[1] = u[2] THEN 'high' WHEN {_PAIR} IS NOT NULL THEN 'low' END END AS confidence
    FROM (SELECT *, {_USABLE} AS u FROM ({_BALLOTS}))""")
def votes_expander(n: News) -> DataFrame:
    return _votes(n, "expander")


@query(f"SELECT id, CASE WHEN v0 = v1 THEN v0 ELSE 'informativ' END AS value, CASE WHEN v0 = v1 THEN 'high' ELSE 'low' END AS confidence FROM ({_BALLOTS})")
def votes_register(n: News) -> DataFrame:
    return _votes(n, "register")


@query(oracle("SELECT label, n, round(greatest(0.2, least(5.0, sum(n) OVER () / (count(*) OVER () * n))), 6) AS weight FROM (SELECT tf_topic AS label, count(*) AS n FROM articles WHERE tf_topic IS NOT NULL GROUP BY 1)"))
def class_weights(n: News) -> DataFrame:
    return L.class_weights(n.articles, "tf_topic")


@query(oracle("""c AS (SELECT llm_topic AS t, tf_topic AS g, count(*) AS n FROM articles WHERE llm_topic IS NOT NULL GROUP BY 1, 2), k AS (SELECT t AS c FROM c UNION SELECT g FROM c WHERE g IS NOT NULL)
    SELECT round(avg(2.0 * b / (t + g)), 6) AS macro_f1, count(*) AS classes FROM (SELECT c, coalesce((SELECT sum(n) FROM c WHERE t = k.c), 0) AS t, coalesce((SELECT sum(n) FROM c WHERE g = k.c), 0) AS g, coalesce((SELECT sum(n) FROM c WHERE t = k.c AND g = k.c), 0) AS b FROM k)"""))
def macro_f1(n: News) -> DataFrame:
    return L.macro_f1(n.articles, "llm_topic", "tf_topic")


@query(oracle("""SELECT CASE WHEN outlet_id IN (2, 5) THEN 'test' ELSE 'train' END AS split, CASE tf_topic WHEN 'politics' THEN 0 WHEN 'economy' THEN 1 WHEN 'justice' THEN 2 ELSE -1 END AS label_id, CASE WHEN tf_topic IS NULL THEN 'unlabelled' WHEN tf_topic = 'health' THEN 'out_of_scope' END AS reason, count(*) AS n FROM articles GROUP BY ALL"""))
def split_by_outlet(n: News) -> DataFrame:
    return L.split_by_outlet(n.articles, [2, 5], TOPICS[:3])


@query(oracle("SELECT CASE WHEN outlet_type = 'fact_checker' THEN 'neutral' WHEN tf_topic IN ('politics', 'justice') THEN 'model' END AS route, count(*) AS n FROM articles a JOIN outlets o ON o.id = a.outlet_id GROUP BY 1"))
def axis_routing(n: News) -> DataFrame:
    return L.route_axes(n.articles, n.outlets, ["politics", "justice"])


@query(oracle("SELECT id, CASE WHEN length(title) <= 40 THEN title WHEN instr(reverse(substr(title, 1, 40)), ' ') > 0 AND 40 - instr(reverse(substr(title, 1, 40)), ' ') > 28 THEN substr(title, 1, 40 - instr(reverse(substr(title, 1, 40)), ' ')) || '…' ELSE substr(title, 1, 40) || '…' END AS short FROM articles"))
def truncation(n: News) -> DataFrame:
    return n.articles.select("id", T.truncated(F.col("title"), 40).alias("short"))


@query(oracle("SELECT id, len(w) AS n, len(h) AS kept, md5(array_to_string(h, ' ')) AS digest FROM (SELECT id, w, CASE WHEN len(w) <= 64 THEN w ELSE list_concat(w[1:48], w[-16:]) END AS h FROM (SELECT id, string_split(content_text, ' ') AS w FROM articles))"))
def head_tail_tokens(n: News) -> DataFrame:
    rows = n.articles.select("id", F.split("content_text", " ").alias("w")).withColumn("h", T.head_tail(F.col("w"), 64, 48))
    return rows.select("id", F.size("w").alias("n"), F.size("h").alias("kept"), F.md5(F.array_join("h", " ")).alias("digest"))


@query(oracle("""SELECT id, p FROM (SELECT id, round(exp((id % 5) - m) / (exp((id % 5) - m) + exp((id % 3) - m) + exp(-m)), 6) AS p FROM (SELECT id, greatest(id % 5, id % 3, 0) AS m FROM articles))"""))
def label_probabilities(n: News) -> DataFrame:
    return n.articles.select("id", F.round(T.softmax(F.array((F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double"), F.lit(0.0)))[0], 6).alias("p"))


def _names(heading: str, labels: list[str], n: int) -> str:
    return f"(SELECT article_id, '{heading}: ' || string_agg(entity_text, ', ' ORDER BY place) AS s FROM (SELECT article_id, entity_text, place, row_number() OVER (PARTITION BY article_id ORDER BY place) AS rn FROM (SELECT article_id, entity_text, list_position(regexp_extract_all(text, '([A-Z][a-z]{{3,}})', 1), entity_text) AS place FROM entities JOIN documents ON doc_id = article_id WHERE entity_label IN ({_quoted(labels)}))) WHERE rn <= {n} GROUP BY 1)"


@query(oracle(f"""SELECT a.id, 'passage: ' || CASE WHEN a.id IN (SELECT article_id FROM entities) THEN concat_ws('. ', p.s, o.s, l.s, e.s) || '. ' ELSE '' END || concat_ws(' ', title, substr(coalesce(content_text, ''), 1, 1500)) AS augmented FROM articles a
    LEFT JOIN {_names('Persoane', ['PERSON'], 6)} p ON p.article_id = a.id LEFT JOIN {_names('Organizații', ['ORGANIZATION'], 4)} o ON o.article_id = a.id LEFT JOIN {_names('Locuri', ['GPE', 'LOC'], 4)} l ON l.article_id = a.id LEFT JOIN {_names('Evenimente', ['EVENT'], 2)} e ON e.article_id = a.id"""))
def augmented_text(n: News) -> DataFrame:
    return N.augmented_text(n.articles, n.placed_entities)


# Windows, labels, samples.
@query(oracle("SELECT w AS window_idx, count(*) AS n, count(DISTINCT outlet_id) AS outlets FROM (SELECT outlet_id, unnest(range(greatest(0, CAST(ceil((day - 27) / 14.0) AS INT)), CAST(floor(day / 14.0) AS INT) + 1)) AS w FROM articles) GROUP BY 1"))
def sliding_windows(n: News) -> DataFrame:
    return C.assign_windows(n.articles.select("outlet_id", "day"), "day", length=28, stride=14, closed=False).groupBy("window_idx").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("outlet_id").alias("outlets"))


@query(oracle("SELECT id, greatest(0, CAST(ceil((day - 7) / 3.0) AS INT)) AS window_idx FROM articles"))
def earliest_window(n: News) -> DataFrame:
    return C.earliest_window(C.assign_windows(n.articles.select("id", "day"), "day", length=7, stride=3, closed=True))


@query(oracle("""SELECT id, cluster_id, 65 AS dims, round(0.2 * coalesce((day - lo) / nullif(hi - lo, 0), 0), 6) AS t FROM (SELECT id, cluster_id, day, min(day) OVER (PARTITION BY cluster_id) AS lo, max(day) OVER (PARTITION BY cluster_id) AS hi FROM articles WHERE embedding IS NOT NULL AND cluster_id IS NOT NULL)"""))
def temporal_feature(n: News) -> DataFrame:
    return C.temporal_feature(n.articles).select("id", "cluster_id", F.size("feature").alias("dims"), F.round(F.element_at("feature", -1), 6).alias("t"))


def _labels_sql(key: str, min_df: int, max_df: float) -> str:
    return oracle(f"""tok AS (SELECT {key} AS g, list_filter(regexp_extract_all(lower(string_agg(title, ' ' ORDER BY id)), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zà-ÿăîâșț]{{3,}}') AND NOT list_contains([{_quoted(STOPWORDS)}], w)) AS w FROM articles WHERE {key} IS NOT NULL GROUP BY 1),
    w AS (SELECT g, t, count(*) AS tf FROM (SELECT g, unnest(w) AS t FROM tok UNION ALL SELECT g, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok) GROUP BY 1, 2), n AS (SELECT count(DISTINCT g) AS n FROM tok),
    d AS (SELECT t, count(*) AS df, sum(tf) AS s FROM w GROUP BY 1), f AS (SELECT t, df, n FROM d, n WHERE df >= {min_df} AND df <= {max_df} * n ORDER BY s DESC, t LIMIT 40000)
    SELECT g AS {key}, string_agg(t, ',' ORDER BY rn) AS terms FROM (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY round((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 9) DESC, t) AS rn FROM w JOIN f USING (t)) WHERE rn <= 5 GROUP BY 1""")


@query(_labels_sql("cluster_id", 3, 0.65))
def tfidf_labels(n: News) -> DataFrame:
    return C.tfidf_labels(n.articles.where("cluster_id IS NOT NULL").select("cluster_id", "id", "title"), "cluster_id", "title")


@query(_labels_sql("sub_cluster_id", 1, 0.85))
def tfidf_labels_events(n: News) -> DataFrame:
    return C.tfidf_labels(n.articles.where("sub_cluster_id IS NOT NULL").select("sub_cluster_id", "id", "title"), "sub_cluster_id", "title", min_df=1, max_df=0.85)


@query(oracle("""r AS (SELECT sub_cluster_id AS g, id, title FROM articles WHERE sub_cluster_id IS NOT NULL), tf AS (SELECT g, id, t, count(*) AS tf FROM (SELECT g, id, unnest(regexp_extract_all(lower(title), '[a-z]{3,}')) AS t FROM r) GROUP BY 1, 2, 3), n AS (SELECT g, count(*) AS n FROM r GROUP BY 1), d AS (SELECT g, t, count(*) AS df FROM tf GROUP BY 1, 2),
    w AS (SELECT tf.g, id, t, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (g, t) JOIN n USING (g)), u AS (SELECT g, id, t, w / sqrt(sum(w * w) OVER (PARTITION BY g, id)) AS w FROM w), p AS (SELECT a.g, a.id, b.id AS id2, sum(a.w * b.w) AS c FROM u a JOIN u b ON a.g = b.g AND a.t = b.t AND a.id <> b.id GROUP BY 1, 2, 3), k AS (SELECT DISTINCT g, id FROM p WHERE c >= 0.15)
    SELECT r.g, r.id FROM r WHERE EXISTS (SELECT 1 FROM k WHERE k.g = r.g AND k.id = r.id) OR (SELECT count(*) FROM k WHERE k.g = r.g) < 2"""))
def title_filter(n: News) -> DataFrame:
    return C.title_filter(n.articles, "sub_cluster_id")


@query()
def event_clusters(n: News) -> DataFrame:
    return C.event_clusters(n.articles, cut=0.80, merge=0.80)


@query()
def topic_clusters(n: News) -> DataFrame:
    placed = C.assign_windows(n.articles.where("embedding IS NOT NULL").select("id", "outlet_id", "day", "embedding"), "day", length=28, stride=14, closed=False)
    return D.topics(placed.withColumnRenamed("window_idx", "g"), samples=3, least=5)


@query(oracle("SELECT sub_cluster_id AS cluster, count(*) AS article_count, count(DISTINCT outlet_id) AS outlet_count FROM articles WHERE cluster_run_id IS NOT NULL AND sub_cluster_id NOT IN (101, 203) GROUP BY 1 HAVING outlet_count >= 3 AND article_count BETWEEN 4 AND 60 AND max(published_on) - min(published_on) <= 31"))
def summary_candidates(n: News) -> DataFrame:
    return C.summary_candidates(A.cluster_labels(n.articles, True), n.spark.sql("SELECT * FROM VALUES (101), (203) AS t(cluster)"), days=31)


_PRIORITY = ["national_agency", "investigative", "civic_news", "regional_newspaper", "news_aggregator", "fact_checker"]


@query(oracle(f"""SELECT cluster_id, id, rank FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, CASE WHEN k = 1 THEN list_position({_PRIORITY}, outlet_type) ELSE 0 END, sim DESC, id) AS rank FROM
    (SELECT cluster_id, a.id, outlet_type, a.score_sensationalism AS sim, row_number() OVER (PARTITION BY cluster_id, outlet_type ORDER BY a.score_sensationalism DESC, a.id) AS k FROM articles a JOIN outlets o ON o.id = a.outlet_id WHERE cluster_id IS NOT NULL)) WHERE rank <= 8"""))
def stratified_sample(n: News) -> DataFrame:
    members = n.articles.where("cluster_id IS NOT NULL").join(n.outlets.select(F.col("id").alias("outlet_id"), "outlet_type"), "outlet_id").select("cluster_id", "id", "outlet_type", F.col("score_sensationalism").alias("sim"))
    return C.stratified_sample(members, "cluster_id", k=8, priority=_PRIORITY)


_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_TEXT = 'the of "and the" -idiot or und der'
_SEARCH_SQL = f"""base AS (SELECT id, embedding, w, (list_contains(w, 'the') AND list_contains(w, 'of') AND contains(j, ' and the ') AND NOT list_contains(w, 'idiot')) AS one FROM (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j FROM (SELECT id, embedding, regexp_extract_all(lower(concat_ws(' ', title, content_text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM articles WHERE NOT is_templated AND NOT is_excluded))
      WHERE (list_contains(w, 'the') AND list_contains(w, 'of') AND contains(j, ' and the ') AND NOT list_contains(w, 'idiot')) OR (list_contains(w, 'und') AND list_contains(w, 'der'))),
    hit AS (SELECT id, one, pos, term FROM (SELECT id, one, unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM base) WHERE term IN (CASE WHEN one THEN 'the' ELSE 'und' END, CASE WHEN one THEN 'of' ELSE 'der' END, CASE WHEN one THEN 'and' ELSE 'und' END)),
    las AS (SELECT id, pos, count(*) OVER u AS nth, CASE WHEN one THEN CASE WHEN max(pos) FILTER (term = 'the') OVER u IS NOT NULL AND max(pos) FILTER (term = 'of') OVER u IS NOT NULL AND max(pos) FILTER (term = 'and') OVER u IS NOT NULL THEN least(max(pos) FILTER (term = 'the') OVER u, max(pos) FILTER (term = 'of') OVER u, max(pos) FILTER (term = 'and') OVER u) END
      ELSE CASE WHEN max(pos) FILTER (term = 'und') OVER u IS NOT NULL AND max(pos) FILTER (term = 'der') OVER u IS NOT NULL THEN least(max(pos) FILTER (term = 'und') OVER u, max(pos) FILTER (term = 'der') OVER u) END END AS first FROM hit WINDOW u AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    cov AS (SELECT l.id, l.pos, l.first, (l.pos - l.first) - (l.nth - s.nth) AS noise, (l.pos + l.first) / 2 AS middle FROM (SELECT *, lag(first) OVER (PARTITION BY id ORDER BY pos) AS before FROM las) l JOIN las s ON s.id = l.id AND s.pos = l.first WHERE l.first IS NOT NULL AND (before IS NULL OR before <> l.first)),
    den AS (SELECT id, sum(0.1 / (1 + noise)) AS d, count(*) AS n, coalesce(sum(1.0 / gap) FILTER (gap > 0), 0) AS near FROM (SELECT *, middle - lag(middle) OVER (PARTITION BY id ORDER BY pos) AS gap FROM cov) GROUP BY 1),
    base2 AS (SELECT b.id, b.embedding, round(CASE WHEN near > 0 THEN d / (n / near) ELSE d END, 9) AS lex FROM base b JOIN den USING (id)),
    dense AS (SELECT id, row_number() OVER (ORDER BY cos DESC, id) AS dense_rank FROM (SELECT id, round({_COS.format(a='embedding', b=json.dumps(_QUERY))}, 9) AS cos FROM base WHERE embedding IS NOT NULL) WHERE cos >= 0.0 ORDER BY cos DESC, id LIMIT 50),
    sparse AS (SELECT id, row_number() OVER (ORDER BY lex DESC, id) AS sparse_rank FROM base2 ORDER BY lex DESC, id LIMIT 50),
    f AS (SELECT id, dense_rank, sparse_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0), 9) AS rrf FROM dense FULL OUTER JOIN sparse USING (id)), r AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) AS rn FROM f),
    k AS (SELECT * FROM r WHERE (rn <= 3 OR rrf >= 0.5 * (SELECT rrf FROM r WHERE rn = 3)) AND rn <= 20)
    SELECT id, dense_rank, sparse_rank, rrf, CASE WHEN (SELECT max(rrf) FROM k) >= 0.025 AND (SELECT count(*) FROM k WHERE dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) >= 3 THEN 'HIGH' WHEN (SELECT max(rrf) FROM k) >= 0.020 OR (SELECT count(*) FROM k WHERE dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM k"""


@query(oracle(_SEARCH_SQL))
def hybrid_search(n: News) -> DataFrame:
    return S.hybrid_search(n.articles, _QUERY, _TEXT, floor=0.0)


@query(oracle(_SEARCH_SQL))
def indexed_search(n: News) -> DataFrame:
    """The same search from an inverted index, which is written first."""
    path = f"{sinks.shared_folder(n.spark)}/postings-{uuid.uuid4().hex}"
    S.write_postings(n.articles, path)
    return S.hybrid_search(n.articles, _QUERY, _TEXT, postings=path, floor=0.0)


@query()
def stemmed_search(n: News) -> DataFrame:
    """A search by stems: forms of a word meet."""
    path = f"{sinks.shared_folder(n.spark)}/postings-{uuid.uuid4().hex}"
    S.write_postings(n.articles, path, stem=romanian)
    return S.hybrid_search(n.articles, _QUERY, "pentru or la or der", postings=path, stem=romanian, floor=0.0)


# Sources and sinks.
@query("SELECT page_id, url, md5(url) AS url_hash FROM pages")
def page_hashes(n: News) -> DataFrame:
    return P.page_fields(n.table("pages")).select("page_id", "url", "url_hash")


@query(r"""SELECT page_id, url, md5(url) AS url_hash, CASE WHEN t = '' THEN 'Unknown Title' ELSE t END AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\f\r\v]+', ' ', 'g')) AS content_text
    FROM (SELECT *, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM pages)""")
def page_extract(n: News) -> DataFrame:
    return P.page_fields(n.table("pages"))


@query(rf"""SELECT page_id, outlet_id, url, md5(url) AS url_hash, CASE WHEN outlet_id IN (1, 2, 4, 6, 11) THEN trim(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&')) ELSE 'Unknown Title' END AS title,
    CASE WHEN outlet_id = 4 THEN array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '&quot;', '"'), '&amp;', '&'), '</?[a-z]+>'), lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE '' END AS content_text,
    [{_quoted([r[1] for r in X.RULES])}][outlet_id] AS author, CAST(NULL AS TIMESTAMP) AS published_at FROM (SELECT *, CAST(page_id % 12 + 1 AS INT) AS outlet_id FROM pages)""")
def page_articles(n: News) -> DataFrame:
    """The pages read by the rules of an outlet each; of the tables' pages these find headings, the text of articles and no dates."""
    return X.extract(n.table("pages").withColumn("outlet_id", (F.col("page_id") % 12 + 1).cast("int")), X.rules(n.spark))


#: Links as outlets write them, from the pages' own.
_LINKS = """SELECT page_id, CAST(page_id % 12 + 1 AS INT) AS outlet_id, CASE page_id % 5 WHEN 0 THEN 'https://www.desteptarea.ro/' WHEN 1 THEN 'https://www.gds.ro/' WHEN 2 THEN 'https://arad24.net/Sport/' WHEN 3 THEN 'https://www.desteptarea.ro/2024-' ELSE 'https://www.desteptarea.ro/a/' END
    || CASE page_id % 3 WHEN 0 THEN substr(url, length(url) - 5) ELSE CAST(page_id AS STRING) END AS link FROM pages"""


@query(f"""SELECT page_id, outlet_id, link FROM ({_LINKS}) WHERE starts_with(link, [{_quoted([r[7] for r in X.RULES])}][outlet_id])
    AND NOT (outlet_id IN (1, 4) AND regexp_matches(lower(link), '{'|'.join(X.NOISE)}')) AND NOT (outlet_id = 2 AND regexp_full_match(trim(substr(link, 28), '/'), '\\d+(-\\d+)?|.*/.*'))""")
def allowed_links(n: News) -> DataFrame:
    links = n.spark.sql(_LINKS.replace("FROM pages", "FROM {pages}"), pages=n.table("pages"))
    return X.valid_links(links, X.rules(n.spark))


@query(r"""SELECT page_id, CASE WHEN starts_with(link, '/') THEN host || link ELSE link END AS link FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1))) AS link FROM pages)""")
def page_links(n: News) -> DataFrame:
    return P.page_links(n.table("pages"))


@query(oracle("SELECT o.id AS outlet_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM outlets o"))
def crawl_calendar(n: News) -> DataFrame:
    return P.calendar(n.spark, n.outlets, "2024-01-01", "2024-01-31")


@query(oracle("SELECT outlet_id, id % 5 + 1 AS page FROM articles GROUP BY outlet_id, id % 5 HAVING min(published_on) >= DATE '2024-01-08' - 2"))
def crawl_boundary(n: News) -> DataFrame:
    return P.next_pages(n.articles.select("outlet_id", (F.col("id") % 5).alias("page"), "published_on"), "2024-01-08")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text) HAVING md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0)")
def insert_ignore(n: News) -> DataFrame:
    docs = n.table("documents").select("doc_id", F.md5("text").alias("h"))
    return sinks.insert_ignore(docs.where("doc_id % 10 = 0").select("h"), docs, ["h"], "doc_id")


@query(oracle("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM articles WHERE id % 2 = 0 OR id % 3 = 0"))
def upsert(n: News) -> DataFrame:
    rows = n.articles.select("id")
    return sinks.upsert(rows.where("id % 2 = 0").withColumn("v", F.lit("old")), rows.where("id % 3 = 0").withColumn("v", F.lit("new")), ["id"])


@query(oracle("SELECT id FROM articles WHERE outlet_id NOT IN (SELECT outlet_id FROM articles WHERE id < 10)"))
def insert_where_absent(n: News) -> DataFrame:
    return sinks.insert_where_absent(n.articles, n.articles.select("id", "outlet_id"), ["outlet_id"], F.col("id") < 10).select("id")


@query(oracle("SELECT id FROM articles WHERE score_citation_quality IS NULL AND id > 100"))
def work_scan(n: News) -> DataFrame:
    return sinks.due_work(sinks.after(n.articles, 100), "score_citation_quality").select("id")


# Names.
_PEOPLE = "SELECT article_id, entity_text, 'PERSON' AS entity_label FROM entities WHERE length(entity_text) <= 6 UNION ALL SELECT article_id, 'Ana ' || entity_text, 'PERSON' FROM entities WHERE length(entity_text) <= 6 AND article_id % 3 < 2 UNION ALL SELECT article_id, 'Ion ' || entity_text, CASE WHEN article_id % 2 = 0 THEN 'PERSON' ELSE 'LOC' END FROM entities WHERE length(entity_text) <= 6 AND article_id % 3 = 0"


def _people(n: News) -> DataFrame:
    return n.spark.sql(_PEOPLE.replace("FROM entities", "FROM {entities}"), entities=n.entities)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: Surfaces and lemmas around the entities found: titles before and after, agreed forms, overrides, decomposed letters, cedillas, underscores, nothing.
_SURFACES = """SELECT article_id, entity_text, CASE length(entity_text) % 9 WHEN 0 THEN 'Premierul ' || entity_text WHEN 1 THEN 'Fostul premier ' || entity_text WHEN 2 THEN entity_text || ', președinte' WHEN 3 THEN 'Uniunii Europene'
    WHEN 4 THEN 'Iranului' WHEN 5 THEN 'Palaţul_' || entity_text || ' Ș' WHEN 6 THEN entity_text WHEN 7 THEN '' END AS surface,
    CASE length(entity_text) % 9 WHEN 3 THEN 'uniune european' WHEN 6 THEN lower(entity_text) WHEN 7 THEN 'x' WHEN 1 THEN '' END AS lemma FROM entities"""
_SYNONYM_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in N.SYNONYMS.items())
_LEMMA_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in N.LEMMAS.items())
_COMPOSED = "translate(nfc_normalize({}), 'şŞţŢ', 'șȘțȚ')"


@query(oracle(f"""p AS ({_SURFACES}), s AS (SELECT *, trim(replace({_COMPOSED.format("coalesce(surface, '')")}, '_', ' ')) AS plain FROM p), b AS (SELECT *, coalesce({_COMPOSED.format("nullif(lemma, '')")}, plain) AS base FROM s),
    c AS (SELECT b.*, CASE WHEN y.v <> plain THEN y.v ELSE coalesce(l.v, base) END AS chosen FROM b LEFT JOIN (VALUES {_SYNONYM_ROWS}) y(k, v) ON y.k = lower(trim(plain)) LEFT JOIN (VALUES {_LEMMA_ROWS}) l(k, v) ON l.k = lower(trim(base)))
    SELECT article_id, entity_text, surface, CASE WHEN plain = '' THEN '' ELSE trim(regexp_replace(regexp_replace(chosen, '^(?i)({'|'.join(N.TWO_WORD_TITLES + N.TITLES)})\\s+', ''), ',\\s*(?i)({'|'.join(N.TRAILING_TITLES)})$', '')) END AS name FROM c"""))
def normalised_names(n: News) -> DataFrame:
    rows = n.spark.sql(_SURFACES.replace("FROM entities", "FROM {entities}"), entities=n.entities)
    return rows.select("article_id", "entity_text", "surface", N.normalise(F.col("surface"), F.col("lemma")).alias("name"))


@query(oracle(f"p AS ({_PEOPLE}) SELECT p.article_id, entity_text, entity_label, CASE WHEN entity_label = 'PERSON' AND c.n = 1 THEN c.f ELSE entity_text END AS name FROM p LEFT JOIN (SELECT article_id, string_split(entity_text, ' ')[-1] AS last, count(DISTINCT entity_text) AS n, min(entity_text) AS f FROM p WHERE entity_label = 'PERSON' AND contains(entity_text, ' ') GROUP BY ALL) c ON c.article_id = p.article_id AND c.last = p.entity_text"))
def surname_merge(n: News) -> DataFrame:
    return N.surnames(_people(n))


_TAG = "CASE length(text) % 7 WHEN 0 THEN 'B-PERSON' WHEN 1 THEN 'I-PERSON' WHEN 2 THEN 'I-ORG' WHEN 3 THEN 'B-ORG' WHEN 4 THEN 'I-ORG' WHEN 5 THEN 'O' ELSE 'B-DATE' END"
_SPANS = f"""w AS (SELECT article_id, pos, text, {_TAG} AS tag FROM (SELECT id AS article_id, unnest(range(len(string_split(title, ' ')))) AS pos, unnest(string_split(title, ' ')) AS text FROM articles)),
    b AS (SELECT article_id, pos, substr(tag, 3) AS label FROM w WHERE tag LIKE 'B-%'), e AS (SELECT b.article_id, b.pos, b.label, (SELECT min(w.pos) FROM w WHERE w.article_id = b.article_id AND w.pos > b.pos AND w.tag <> 'I-' || b.label) AS stop FROM b),
    s AS (SELECT e.article_id, e.pos AS start, trim(string_agg(w.text, ' ' ORDER BY w.pos)) AS entity_text, CASE e.label WHEN 'ORG' THEN 'ORGANIZATION' ELSE e.label END AS entity_label FROM e JOIN w ON w.article_id = e.article_id AND w.pos >= e.pos AND w.pos < coalesce(e.stop, 1000000) WHERE e.label <> 'DATE' GROUP BY ALL)"""


def _spans(n: News) -> DataFrame:
    words = n.articles.select(F.col("id").alias("article_id"), F.posexplode(F.split("title", " ")).alias("pos", "text"))
    return N.spans(words.withColumn("tag", F.expr(_TAG)))


@query(oracle(f"{_SPANS} SELECT article_id, start, entity_text, entity_label FROM s"))
def tag_spans(n: News) -> DataFrame:
    return _spans(n)


@query(oracle(f"""{_SPANS} SELECT article_id, start, entity_text, entity_label FROM s WHERE entity_label <> 'PERSON' OR NOT EXISTS
    (SELECT 1 FROM w WHERE w.article_id = s.article_id AND w.pos BETWEEN s.start - 3 AND s.start - 1 AND regexp_replace(lower(w.text), '[^\\p{{L}}]', '', 'g') IN ('then', 'that', 'die', 'sursa', 'foto'))"""))
def uncredited_spans(n: News) -> DataFrame:
    """Persons without those that a credit word precedes; words of the tables' texts stand among the credit words."""
    words = n.articles.select(F.col("id").alias("article_id"), F.posexplode(F.split("title", " ")).alias("pos", "text"))
    return N.uncredited(_spans(n), words, ["then", "that", "die", "sursa", "foto"])


_ODD = "CASE WHEN start % 5 = 0 THEN 'VIDEO ' || upper(entity_text) WHEN start % 5 = 1 THEN upper(substr(entity_text, 1, 1)) || substr(entity_text, 2) WHEN start % 5 = 2 THEN 'Digi ' || entity_text WHEN start % 5 = 3 THEN 'Foto*' || entity_text ELSE entity_text END"
_BLOCKED = " OR ".join(f"contains(lower(t), '{b}')" for b in N.BLOCKED)


@query(oracle(f"{_SPANS} SELECT article_id, start, t AS entity_text FROM (SELECT article_id, start, trim({_ODD}) AS t, entity_label FROM s) WHERE regexp_matches(t, '^\\p{{Lu}}') AND length(t) <= 60 AND NOT contains(t, '*') AND upper(t) NOT IN ('INTERVIU', 'EXCLUSIV', 'FOTO', 'UPDATE', 'VIDEO', 'DOCUMENT', 'LIVE', 'BREAKING') AND NOT starts_with(upper(t), 'VIDEO ') AND (entity_label <> 'ORGANIZATION' OR NOT ({_BLOCKED}))"))
def plausible_spans(n: News) -> DataFrame:
    cased = _spans(n).withColumns({"high": T.capitals(F.col("entity_text")), "initial": T.capitals(F.substring("entity_text", 1, 1))})
    named = cased.withColumn("entity_text", F.trim(F.expr(_ODD.replace("upper(entity_text)", "high").replace("upper(substr(entity_text, 1, 1))", "initial"))))
    return named.where(N.plausible(F.col("entity_text"), F.col("entity_label"))).select("article_id", "start", "entity_text")


_KNOWN = [("ana with",), ("IRON",), ("their own house",), ("that ion",), (" ",)]


@query(oracle(f"""p AS ({_PEOPLE}), k AS (SELECT lower(trim(name)) AS k FROM (VALUES {_values(_KNOWN)}) AS t(name) WHERE trim(name) <> ''), a AS (SELECT DISTINCT article_id, 'ana ' || lower(min(entity_text)) || ' pop' AS k FROM entities WHERE article_id % 4 = 1 GROUP BY article_id),
    hit AS (SELECT DISTINCT p.article_id, p.entity_text FROM p JOIN (SELECT NULL AS article_id, k FROM k UNION ALL SELECT article_id, k FROM a) x ON (x.article_id IS NULL OR x.article_id = p.article_id) AND (contains(x.k, lower(entity_text)) OR contains(lower(entity_text), x.k)
      OR len(list_intersect(string_split(x.k, ' '), string_split(lower(entity_text), ' '))) >= 2))
    SELECT article_id, entity_text, entity_label FROM p WHERE entity_label <> 'PERSON' OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.article_id = p.article_id AND h.entity_text = p.entity_text)"""))
def without_authors(n: News) -> DataFrame:
    own = n.entities.where("article_id % 4 = 1").groupBy("article_id").agg(F.concat(F.lit("Ana "), F.lower(F.min("entity_text")), F.lit(" Pop")).alias("name"))
    return N.without_authors(_people(n), n.spark.createDataFrame(_KNOWN, "name string"), own)


@query(_graph_sql("""SELECT coalesce(node, x) AS canonical, node IS NOT NULL AS found FROM (SELECT x, coalesce((SELECT min(node) FROM deg WHERE lower(node) = lower(x)), (SELECT CASE WHEN count(*) = 1 THEN min(node) END FROM deg WHERE contains(lower(node), lower(x)))) AS node
    FROM (VALUES ('wITH'), ('wit'), ('zzz')) AS t(x))"""))
def resolved_names(n: News) -> DataFrame:
    e = _edges(n)
    return G.resolve(e, " wITH ").union(G.resolve(e, "wit")).union(G.resolve(e, "zzz"))


# What the survey lists beside these.
_CLAIMED = "SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'FALS: ' WHEN 1 THEN 'FALS ' WHEN 2 THEN '  Parțial fals | ' WHEN 3 THEN 'Parțial fals: ' WHEN 4 THEN 'ADEVĂRAT | ' WHEN 5 THEN 'Context lipsă: ' WHEN 6 THEN 'știri ' WHEN 7 THEN '' END || substr(text, 1, 40) AS title FROM documents"


@query(f"SELECT id, len(list_filter([{_quoted(K.TITLE_STARTS)}], lambda s: starts_with(trim(lower(coalesce(title, ''))), s))) > 0 AS is_fact_check FROM ({_CLAIMED})")
def fact_check_titles(n: News) -> DataFrame:
    rows = n.spark.sql(_CLAIMED.replace("FROM documents", "FROM {documents}"), documents=n.table("documents"))
    return rows.select("id", K.is_fact_check(F.col("title")).alias("is_fact_check"))


@query(oracle("""SELECT f.id, CASE verdict WHEN 'true' THEN 'green' WHEN 'satire' THEN 'green' WHEN 'false' THEN 'red' ELSE 'amber' END AS chip,
    CASE WHEN c IS NULL THEN '' WHEN c >= 0.7 THEN 'good' WHEN c < 0.3 THEN 'bad' ELSE 'neutral' END AS citations, CASE WHEN s >= 0.7 THEN 'bad' WHEN s < 0.3 THEN 'good' ELSE 'neutral' END AS sensationalism
    FROM fact_checks f JOIN (SELECT id, score_citation_quality AS c, score_sensationalism AS s FROM articles) a ON a.id = f.id"""))
def score_pills(n: News) -> DataFrame:
    scores = n.articles.select("id", "score_citation_quality", "score_sensationalism")
    return n.fact_checks.select("id", "verdict").join(scores, "id").select("id", K.chip(F.col("verdict")).alias("chip"), K.pill(F.col("score_citation_quality"), True).alias("citations"), K.pill(F.col("score_sensationalism"), False).alias("sensationalism"))


_ROOTS = """list_transform(list_filter(list_transform(regexp_split_to_array(lower(x), '\\s+'), lambda w: regexp_replace(w, '^[.,!?"''()„”:\\-–—]+|[.,!?"''()„”:\\-–—]+$', '', 'g')), lambda w: length(w) > 4), lambda w: substr(w, 1, 5))"""


@query(oracle(f"""t AS (SELECT cluster_id, sub_cluster_id AS event, length(title) AS len, {_ROOTS} AS r FROM (SELECT *, title AS x, row_number() OVER (PARTITION BY sub_cluster_id ORDER BY published_on, id) AS rn FROM articles WHERE sub_cluster_id IS NOT NULL) WHERE rn <= 8),
    c AS (SELECT id, cluster_id, length(x) AS len, {_ROOTS} AS r FROM (SELECT *, claim_text AS x FROM fact_checks WHERE cluster_id IS NOT NULL)),
    b AS (SELECT c.id, t.event, 1 / (1 + exp(-((t.len + c.len + t.event) % 5 - 3.0))) AS p FROM c JOIN t ON t.cluster_id = c.cluster_id AND len(list_intersect(c.r, t.r)) > 0),
    o AS (SELECT id, event, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, event) AS rn FROM b)
    SELECT c.id, CASE WHEN p >= 0.6 THEN event END AS sub_cluster_id, CASE WHEN p >= 0.6 THEN round(p, 4) END AS sub_similarity FROM c LEFT JOIN o ON o.id = c.id AND o.rn = 1"""))
def refined_to_events(n: News) -> DataFrame:
    # The reranker's place is taken by a function of the two texts and the event.
    return K.refined_to_events(n.fact_checks, n.articles, lambda claim, title: (F.length(title) + F.length(claim) + F.col("event")) % 5 - 3.0)


@query(oracle("""SELECT id, round(CASE WHEN tf_topic IS NULL THEN 1.0 ELSE (SELECT count(tf_topic) FROM articles) / (5.0 * (SELECT count(*) FROM articles b WHERE b.tf_topic = a.tf_topic)) * CASE WHEN tf_topic = 'justice' AND id % 5 = 0 THEN 2 ELSE 1 END END, 6) AS weight FROM articles a"""))
def oversampling_weights(n: News) -> DataFrame:
    return L.oversampling_weights(n.articles, "tf_topic", 5, (F.col("tf_topic") == "justice") & (F.col("id") % 5 == 0))


@query(oracle(r"""SELECT sub_cluster_id, string_agg('Articol ' || rn || ' (' || outlet_type || '): ' || t || chr(10) || CASE WHEN length(c) <= 120 THEN c WHEN instr(reverse(substr(c, 1, 120)), ' ') > 0 AND 120 - instr(reverse(substr(c, 1, 120)), ' ') > 84 THEN substr(c, 1, 120 - instr(reverse(substr(c, 1, 120)), ' ')) || '…' ELSE substr(c, 1, 120) || '…' END, chr(10) || chr(10) ORDER BY rn) AS block
    FROM (SELECT sub_cluster_id, outlet_type, regexp_replace(title, '^\s+|\s+$', '', 'g') AS t, regexp_replace(content_text, '^\s+|\s+$', '', 'g') AS c, row_number() OVER (PARTITION BY sub_cluster_id ORDER BY published_on, a.id) AS rn FROM articles a JOIN outlets o ON o.id = a.outlet_id WHERE sub_cluster_id IS NOT NULL) WHERE rn <= 3 GROUP BY 1"""))
def articles_block(n: News) -> DataFrame:
    kinds = n.outlets.select(F.col("id").alias("outlet_id"), "outlet_type")
    return L.articles_block(n.articles.join(kinds, "outlet_id"), "sub_cluster_id", 3, 120)


@query(oracle("SELECT DISTINCT cluster_run_id, cluster_id FROM articles WHERE cluster_id IS NOT NULL AND NOT (cluster_id % 3 = 0 AND cluster_run_id = 1)"))
def topics_to_do(n: News) -> DataFrame:
    topics = n.articles.where("cluster_id IS NOT NULL").select("cluster_run_id", "cluster_id").distinct()
    labels = topics.where("cluster_id % 3 < 2").select("cluster_run_id", F.col("cluster_id").alias("parent_cluster_id"), (F.col("cluster_id") % 3 == 0).alias("is_event_cluster"))
    return A.topics_to_do(topics, labels)


_RUN_WINDOWS = "SELECT outlet_id AS run_id, DATE '2024-01-01' + 28 * CAST(floor(day / 28.0) AS INT) AS window_start, count(*) AS articles_in FROM articles GROUP BY 1, 2"


@query(oracle(f"runs AS ({_RUNS}), w AS ({_RUN_WINDOWS}) SELECT run_id, window_start, articles_in FROM w WHERE run_id = (SELECT id FROM runs {_NEWEST})"))
def run_windows(n: News) -> DataFrame:
    windows = n.spark.sql(_RUN_WINDOWS.replace("FROM articles", "FROM {articles}"), articles=n.articles)
    return A.run_windows(windows, _runs(n))


@query(oracle("SELECT 'Topic 3' AS cluster_title, string_agg(t, ' | ' ORDER BY t) AS neutral_summary, 1 AS n_points FROM (SELECT DISTINCT tf_topic AS t FROM articles WHERE cluster_run_id = 1 AND cluster_id = 3)"))
def cluster_summary(n: News) -> DataFrame:
    by = n.articles.where("cluster_id IS NOT NULL").groupBy("cluster_run_id", "cluster_id").agg(F.array_join(F.array_sort(F.collect_set("tf_topic")), " | ").alias("summary_text"))
    stored = by.withColumn("cluster_title", F.concat(F.lit("Topic "), F.col("cluster_id").cast("string"))).withColumn("key_points", F.array("cluster_title"))
    return A.cluster_summary(stored, 1, 3).select("cluster_title", "neutral_summary", F.size("key_points").alias("n_points"))


@query(oracle(r"SELECT id, CASE WHEN t <> '' THEN md5('query: ' || substr(t, 1, 512)) END AS digest FROM (SELECT id, regexp_replace(content_text, '^\s+|\s+$', '', 'g') AS t FROM articles)"))
def query_texts(n: News) -> DataFrame:
    return n.articles.select("id", F.md5(S.query_text(F.col("content_text"))).alias("digest"))


_SHORT = ", ".join(f"'{m}'" for m in T.SHORT_MONTHS)
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in list(T.OUTLET_TYPES.items())[:3])


@query(oracle(f"""SELECT a.id, day(published_on) || ' ' || [{_SHORT}][month(published_on)] || ' ' || year(published_on) AS shown,
    CASE o.outlet_type {_TYPES} ELSE upper(substr(o.outlet_type, 1, 1)) || replace(substr(o.outlet_type, 2), '_', ' ') END AS kind, CASE WHEN tf_topic IS NULL THEN '—' ELSE upper(substr(tf_topic, 1, 1)) || replace(substr(tf_topic, 2), '_', ' ') END AS topic
    FROM articles a JOIN outlets o ON o.id = a.outlet_id"""))
def shown_labels(n: News) -> DataFrame:
    rows = n.articles.join(n.outlets.select(F.col("id").alias("outlet_id"), "outlet_type"), "outlet_id")
    return rows.select("id", T.short_date(F.col("published_on")).alias("shown"), T.label_for(F.col("outlet_type"), dict(list(T.OUTLET_TYPES.items())[:3])).alias("kind"), T.label_for(F.col("tf_topic")).alias("topic"))


@query(oracle("""SELECT a.id, a.outlet_id, published_on FROM articles a JOIN outlets o ON o.id = a.outlet_id JOIN (SELECT article_id FROM entities WHERE entity_label IN ('PERSON', 'ORGANIZATION', 'GPE') GROUP BY 1 HAVING count(*) >= 2) e ON e.article_id = a.id
    WHERE embedding IS NOT NULL AND o.outlet_type <> 'fact_checker' AND length(content_text) >= 200"""))
def articles_with_entities(n: News) -> DataFrame:
    return A.with_entities(n.articles, n.entities, n.outlets)


@query(oracle("SELECT id, score_citation_quality FROM articles ORDER BY score_citation_quality DESC NULLS FIRST, id LIMIT 30"))
def best_first(n: News) -> DataFrame:
    return A.best_first(n.articles, "score_citation_quality")


@query("SELECT page_id, url AS link FROM pages WHERE url <> '' UNION ALL SELECT page_id, 'next/' || page_id FROM pages")
def json_links(n: News) -> DataFrame:
    body = F.to_json(F.array(F.struct(F.col("url").alias("link")), F.struct(F.lit("").alias("link")), F.struct(F.concat(F.lit("next/"), F.col("page_id").cast("string")).alias("link"))))
    return P.json_links(n.table("pages").select("page_id", F.when(F.col("page_id") >= 0, body).alias("body")))
