"""Per-outlet and per-cluster analytics. Ids in brackets are those of the survey's operator inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

not_true = lambda flag: F.coalesce(~F.col(flag), F.lit(True))  # noqa: E731  null counts as not set


def average(column: str, alias: str) -> Column:
    return F.round(F.avg(column), 6).alias(alias)


def dominant(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """[D10] The most frequent non-null value of each key; ties go to the smallest value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("best")).select(key, F.col("best.v").alias(alias))


def outlet_summary(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """[Q1, D9, D10, J1, J16] Counts, averages and the dominant topic and framing of each outlet, also of those without articles."""
    sums = articles.groupBy("outlet_id").agg(
        F.count(F.lit(1)).alias("total_articles"), average("score_sensationalism", "avg_sensationalism"), average("score_citation_quality", "avg_citation_quality"), average("score_rhetoric_intensity", "avg_rhetoric"),
    )
    out = outlets.join(sums, outlets.id == sums.outlet_id, "left").drop("outlet_id")
    for value, alias in (("tf_topic", "dominant_topic"), ("tf_framing", "dominant_framing")):
        best = dominant(articles, "outlet_id", value, alias)
        out = out.join(best, out.id == best.outlet_id, "left").drop("outlet_id")
    return out.withColumn("total_articles", F.coalesce("total_articles", F.lit(0)))


def bias_chart(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """[Q14, D9] The two confidence averages under the names that the chart gives them."""
    rows = articles.where("tf_gov_stance_confidence IS NOT NULL AND tf_sovereignism_confidence IS NOT NULL")
    sums = rows.groupBy("outlet_id").agg(average("tf_gov_stance_confidence", "coalition_axis"), average("tf_sovereignism_confidence", "eu_axis"), F.count(F.lit(1)).alias("article_count"))
    return sums.join(outlets, sums.outlet_id == outlets.id).select(F.col("name").alias("outlet_name"), "coalition_axis", "eu_axis", "article_count")


def scores_comparison(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """[Q15, D9, D21] Three score averages of each outlet, rounded to three digits."""
    names = {"score_sensationalism": "sensationalism", "score_citation_quality": "citation_quality", "score_rhetoric_intensity": "rhetoric"}
    sums = articles.groupBy("outlet_id").agg(*(F.round(F.avg(c), 3).alias(a) for c, a in names.items()), F.count("score_citation_quality").alias("n_cited"))
    return sums.join(outlets, sums.outlet_id == outlets.id).select(F.col("name").alias("outlet_name"), *names.values(), "n_cited")


def distribution(articles: DataFrame, outlets: DataFrame, column: str, values: list[str], digits: int = 2) -> DataFrame:
    """[Q16, Q17, D12] The share of each value per outlet in per cent of all its non-null values, one column for each value."""
    sums = articles.where(F.col(column).isNotNull()).groupBy("outlet_id").agg(
        F.count(F.lit(1)).alias("total"), *(F.round(100.0 * F.count(F.when(F.col(column) == v, 1)) / F.count(F.lit(1)), digits).alias(f"{v}_pct") for v in values)
    )
    return sums.join(outlets, sums.outlet_id == outlets.id).select(F.col("name").alias("outlet_name"), "total", *(f"{v}_pct" for v in values))


def label_distribution(articles: DataFrame, outlets: DataFrame, column: str) -> DataFrame:
    """[D24] Long form: count and share of each label of each outlet."""
    counted = articles.where(F.col(column).isNotNull()).groupBy("outlet_id", F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("outlet_id")), 2))
    return whole.join(outlets, whole.outlet_id == outlets.id).select("name", "label", "n", "pct")


def article_page(articles: DataFrame, outlets: DataFrame, *, outlet_id: int | None = None, topic: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """[Q2, B8, F3, J4] One page of articles, newest first. The page is cut before the join."""
    for column, value in (("outlet_id", outlet_id), ("tf_topic", topic)):
        if value is not None:
            articles = articles.where(F.col(column) == value)
    size, page = min(100, max(1, page_size)), max(1, page)
    cut = articles.select("id", "outlet_id", "title", "published_on", "tf_topic", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_key")).orderBy(F.desc("published_on"), "id").offset((page - 1) * size).limit(size)
    return cut.join(outlets.select(F.col("id").alias("o_id"), "name"), F.col("outlet_id") == F.col("o_id"), "left").drop("o_id")


def article_detail(articles: DataFrame, entities: DataFrame, fact_checks: DataFrame, article_id: int) -> DataFrame:
    """[Q3] One article with its entities by label and its fact-checks."""
    ents = entities.where(F.col("article_id") == article_id).groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "entity_label", "entity_text"))), "|").alias("entities"))
    checks = fact_checks.where(F.col("article_id") == article_id).groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list("verdict")), "|").alias("verdicts"))
    one = articles.where(F.col("id") == article_id).select(F.col("id").alias("article_id"), "title", "published_on", "tf_topic")
    return one.join(ents, "article_id", "left").join(checks, "article_id", "left")


def llm_vs_model(articles: DataFrame, *, page: int = 1, page_size: int = 50) -> DataFrame:
    """[Q19, F3] A page of rows labelled by both, with whether they agree."""
    rows = articles.where("llm_topic IS NOT NULL AND tf_topic IS NOT NULL").select("id", "llm_topic", "tf_topic", (F.col("llm_topic") == F.col("tf_topic")).alias("agree"))
    return rows.orderBy("id").offset((page - 1) * page_size).limit(page_size)


def cluster_labels(articles: DataFrame, event: bool) -> DataFrame:
    """[D3, D7, J3] Size, outlets and dates of each topic (or event) of the run."""
    key = "sub_cluster_id" if event else "cluster_id"
    rows = articles.where(F.col("cluster_run_id").isNotNull() & F.col(key).isNotNull())
    return rows.groupBy("cluster_run_id", F.col(key).alias("cluster")).agg(
        F.count(F.lit(1)).alias("article_count"), F.countDistinct("outlet_id").alias("outlet_count"), F.min("published_on").alias("date_from"), F.max("published_on").alias("date_to"),
    )


def cluster_list(articles: DataFrame, *, event: bool, date_from: str, date_to: str, page: int = 1, page_size: int = 20) -> DataFrame:
    """[Q4, B5, B9, B12, F3, J5] Clusters that overlap the dates and have an article that isn't excluded, largest first; events need two outlets."""
    key = "sub_cluster_id" if event else "cluster_id"
    labels = cluster_labels(articles, event).where((F.col("date_to") >= F.lit(date_from).cast("date")) & (F.col("date_from") <= F.lit(date_to).cast("date")))
    if event:
        labels = labels.where("outlet_count > 1")
    shown = articles.where(not_true("is_excluded")).select("cluster_run_id", F.col(key).alias("cluster")).distinct()
    kept = labels.join(shown, ["cluster_run_id", "cluster"], "left_semi")
    return kept.orderBy(F.desc("article_count"), "cluster").offset((page - 1) * page_size).limit(page_size)


def cluster_recent(articles: DataFrame, limit: int = 25) -> DataFrame:
    """Clusters by their newest article; the maximum is aggregated first, not looked up by row."""
    newest = articles.where("sub_cluster_id IS NOT NULL").groupBy(F.col("sub_cluster_id").alias("cluster")).agg(F.max("published_on").alias("newest"), F.count(F.lit(1)).alias("n"))
    return newest.orderBy(F.desc("newest"), "cluster").limit(limit)


def cluster_members(articles: DataFrame, outlets: DataFrame, cluster: int) -> DataFrame:
    """[Q5, D14] Members of a topic grouped by outlet."""
    rows = articles.where((F.col("cluster_id") == cluster) & not_true("is_excluded"))
    grouped = rows.groupBy("outlet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("article_ids"), F.count(F.lit(1)).alias("n"))
    return grouped.join(outlets, grouped.outlet_id == outlets.id).select("name", "article_ids", "n")


def coverage_gaps(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """[Q18, D13, J8] Outlets present in and missing from each topic."""
    every = outlets.agg(F.array_sort(F.collect_set("name")).alias("every"))
    present = articles.where("cluster_id IS NOT NULL").join(outlets.select(F.col("id").alias("outlet_id"), "name"), "outlet_id").groupBy("cluster_id").agg(F.array_sort(F.collect_set("name")).alias("present"))
    return present.crossJoin(every).select(  # one row on the right
        "cluster_id", F.size("every").alias("total_outlets"), F.size("present").alias("covering_outlets"), F.array_join("present", ",").alias("present"), F.array_join(F.array_sort(F.array_except("every", "present")), ",").alias("missing"),
    )


def coverage_metrics(articles: DataFrame, outlets: DataFrame, *, agency: str = "national_agency", outlets_at_most: int = 7, least: float = 3.0) -> DataFrame:
    """[D4, D11, G31] Popularity ln(1 + articles) * outlet types, gap popularity * (1 - outlets / 7), and the modal topic, ``A / B`` on a tie."""
    rows = articles.where("sub_cluster_id IS NOT NULL").join(outlets.select(F.col("id").alias("outlet_id"), "name", "outlet_type"), "outlet_id")
    local = F.col("outlet_type") != agency
    sums = rows.groupBy("sub_cluster_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.countDistinct(F.when(local, F.col("outlet_id"))).alias("outlet_count"), F.countDistinct(F.when(local, F.col("outlet_type"))).alias("type_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(local, F.col("name")))), ",").alias("covering"),
    )
    counted = rows.where("tf_topic IS NOT NULL").groupBy("sub_cluster_id", "tf_topic").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tf_topic")))
    modes = counted.groupBy("sub_cluster_id").agg(ranked.alias("r")).select("sub_cluster_id", F.expr("CASE WHEN size(r) > 1 AND r[0].less = r[1].less THEN concat(r[0].tf_topic, ' / ', r[1].tf_topic) ELSE r[0].tf_topic END").alias("category"))
    popular = F.log(1 + F.col("article_count")) * F.col("type_count")
    out = sums.where("outlet_count > 0").withColumn("p", popular).where(F.col("p") >= least).join(modes, "sub_cluster_id", "left")
    return out.select("sub_cluster_id", "article_count", "outlet_count", "covering", "category", F.round("p", 4).alias("popularity"), F.round(F.col("p") * (1 - F.col("outlet_count") / outlets_at_most), 4).alias("gap"))


def latest_run(runs: DataFrame, mode: str = "max_id") -> DataFrame:
    """[D1] The latest run by one of four rules: max_id, max_completed, newest, newest_event. runs: id, created_at, completed_at, has_event."""
    keep = {"max_id": F.lit(True), "max_completed": F.col("completed_at").isNotNull(), "newest": F.lit(True), "newest_event": F.col("has_event")}[mode]
    by = [F.desc("id")] if mode.startswith("max") else [F.desc_nulls_last("created_at"), F.desc("id")]
    return runs.where(keep).orderBy(*by).limit(1).select("id")


def backlog(articles: DataFrame, summarised: DataFrame) -> DataFrame:
    """[Q27, D1, B1, B4, B10] Unscored articles of 200 characters or more, and events of 4 to 60 articles without a summary."""
    unscored = articles.where("score_citation_quality IS NULL AND length(content_text) >= 200").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unscored").alias("what"), "n")
    events = cluster_labels(articles, True).where("article_count BETWEEN 4 AND 60").join(summarised, "cluster", "left_anti")
    return unscored.unionByName(events.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unsummarised").alias("what"), "n"))


def completeness(articles: DataFrame) -> DataFrame:
    """[D20] Rows and non-null values of each outlet."""
    return articles.groupBy("outlet_id").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded"), F.count("tf_topic").alias("with_topic"), F.count("cluster_id").alias("clustered"))


def systematic_sample(articles: DataFrame, pool: int) -> DataFrame:
    """[B14, E6] Of each outlet every k-th article by id, k = total / pool, at most ``pool``."""
    by = Window.partitionBy("outlet_id")
    ranked = articles.select("id", "outlet_id", F.row_number().over(by.orderBy("id")).alias("rn"), F.count(F.lit(1)).over(by).alias("total"))
    drawn = ranked.where(F.expr(f"rn % greatest(total div {pool}, 1) = 0"))
    return drawn.withColumn("k", F.row_number().over(by.orderBy("id"))).where(F.col("k") <= pool).select("id", "outlet_id", "k")


def stratified_candidates(articles: DataFrame, patterns: list[str], most: int) -> DataFrame:
    """[E5, B6] Of each outlet at most ``most`` articles, those whose title matches a pattern first; ties by id instead of at random."""
    signal = F.lit(False)
    for p in patterns:
        signal = signal | F.col("title").ilike(p)
    rows = articles.select("id", "outlet_id", F.when(signal, 0).otherwise(1).alias("signal"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("outlet_id").orderBy("signal", "id"))).where(F.col("rn") <= most)


def quota(articles: DataFrame, targets: DataFrame, label: str) -> DataFrame:
    """[H31] What each outlet still lacks to its target, and the candidates (twice that) drawn for it. targets: outlet_id, target."""
    done = articles.groupBy("outlet_id").agg(F.count(label).alias("done"))
    lack = targets.join(done, "outlet_id", "left").select("outlet_id", (F.col("target") - F.coalesce("done", F.lit(0))).alias("lack")).where("lack > 0")
    rows = articles.where(F.col(label).isNull()).select("id", "outlet_id").join(lack, "outlet_id")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("outlet_id").orderBy("id"))).where("rn <= 2 * lack").select("id", "outlet_id", "lack", "rn")


def materialised_flag(articles: DataFrame, exclusions: DataFrame, least: float = 0.8) -> DataFrame:
    """[B11, H32, J7] is_excluded set where an exclusion of enough confidence exists."""
    bad = exclusions.where(F.col("confidence") >= least).select(F.col("article_id").alias("id")).distinct().withColumn("flag", F.lit(True))
    return articles.select("id").join(bad, "id", "left").select("id", F.coalesce("flag", F.lit(False)).alias("is_excluded"))


def overlap_filter(articles: DataFrame) -> DataFrame:
    """[X6, B2, B3] Rows left by the three readings of a null flag."""
    return articles.agg(
        F.count(F.when(F.expr("NOT is_templated AND NOT is_excluded"), 1)).alias("null_dropped"),
        F.count(F.when(F.expr("is_templated = false OR is_templated IS NULL"), 1)).alias("null_kept"),
        F.count(F.when(F.expr("NOT coalesce(is_excluded, false) AND tf_topic IN ('politics', 'health')"), 1)).alias("coalesced"),
    )


def cluster_summary(summaries: DataFrame, run: int, cluster: int) -> DataFrame:
    """[Q6] The summary of one cluster of a run, or no row. summaries: cluster_run_id, cluster_id, cluster_title, summary_text, key_points."""
    one = summaries.where((F.col("cluster_run_id") == run) & (F.col("cluster_id") == cluster)).limit(1)
    return one.select("cluster_title", F.col("summary_text").alias("neutral_summary"), F.coalesce("key_points", F.array().cast("array<string>")).alias("key_points"))


def run_windows(windows: DataFrame, runs: DataFrame, run: int | None = None) -> DataFrame:
    """[Q7] The windows of one run, or else of the newest run, by their start."""
    of = windows.where(F.col("run_id") == run) if run is not None else windows.join(latest_run(runs, "newest").select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return of.orderBy("window_start")


def topics_to_do(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """[H13] The topics of a run without any event label, so that an interrupted run goes on where it ended. labels: cluster_run_id, parent_cluster_id, is_event_cluster."""
    done = labels.where("is_event_cluster").select("cluster_run_id", F.col("parent_cluster_id").alias("cluster_id")).distinct()
    return topics.join(done, ["cluster_run_id", "cluster_id"], "left_anti")


def with_entities(articles: DataFrame, entities: DataFrame, outlets: DataFrame, *, least: int = 2, chars: int = 200) -> DataFrame:
    """[J2] Articles to cluster: with an embedding, long enough, of no fact-checker, and with ``least`` persons, organisations or places."""
    named = entities.where("entity_label IN ('PERSON', 'ORGANIZATION', 'GPE')").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id")
    news = outlets.where("outlet_type <> 'fact_checker'").select(F.col("id").alias("outlet_id"))
    rows = articles.where(F.col("embedding").isNotNull() & (F.length("content_text") >= chars))
    return rows.join(news, "outlet_id").join(named, "id").select("id", "outlet_id", "published_on")


def best_first(articles: DataFrame, column: str, limit: int = 30) -> DataFrame:
    """The greatest values first and nulls before them, as in a descending sort of the stored tables' database; ties by id."""
    return articles.orderBy(F.desc_nulls_first(column), "id").limit(limit).select("id", column)
