"""Entities and their co-mention graph: canonical names, entropy, PMI edges, hubs, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import text as T
from newsloom.functions.wordlists import BYLINES, COMMON_NOUNS, HUBS, PARTIES
from newsloom.operators import sinks

WIRE_SERVICES = ["reuters", "afp", "ap", "associated press", "mediafax", "agerpres"]  # fixed values


def canonical_entities(entities: DataFrame) -> DataFrame:
    """[G11] raw -> canonical: names of the same sorted tokens take the most frequent form, then the longest, then the first by text."""
    counted = entities.groupBy("entity_text").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("k", F.array_join(F.array_sort(F.split(F.lower("entity_text"), " ")), " "))
    best = keyed.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("a"), (-F.length("entity_text")).alias("b"), "entity_text")).alias("best"))
    return keyed.join(best, "k").select(F.col("entity_text").alias("raw"), F.col("best.entity_text").alias("canonical"))


def outlet_entropy(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """[D16] Entropy in bits of each entity's spread over outlets: log2(N) - sum(c log2 c) / N, by two aggregations."""
    counted = entities.join(articles.select(F.col("id").alias("article_id"), "outlet_id"), "article_id").groupBy("entity_text", "outlet_id").agg(F.count(F.lit(1)).alias("c"))
    sums = counted.groupBy("entity_text").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select("entity_text", "n", F.abs(F.round(F.log2("n") - F.col("s") / F.col("n"), 6)).alias("entropy"))


def majority_label(entities: DataFrame) -> DataFrame:
    """[D17] The most frequent label of each entity; ties by label."""
    counted = entities.groupBy("entity_text", "entity_label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("entity_text").agg(F.min(F.struct((-F.col("n")).alias("less"), "entity_label")).alias("b")).select("entity_text", F.col("b.entity_label").alias("label"))


def without_bylines(entities: DataFrame, articles: DataFrame, least: float = 0.3, names: list[str] = WIRE_SERVICES + BYLINES) -> DataFrame:
    """[H23] Entities without listed names and without those that are mostly persons and, as persons, of low outlet entropy."""
    rows = entities.where(~F.lower("entity_text").isin(names))
    low = outlet_entropy(rows.where("entity_label = 'PERSON'"), articles).where(F.col("entropy") < least).join(majority_label(rows).where("label = 'PERSON'"), "entity_text", "left_semi")
    return rows.join(low.select("entity_text"), "entity_text", "left_anti").select(*entities.columns)


def graph_entities(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """[G11, G14, H23] The names that make the graph: without a tagger's false names, in canonical form, without bylines. What
    several steps read is written to the folder of checkpoints once."""
    named = sinks.checkpointed(entities.where(~T.ner_stop(F.col("entity_text")) & F.col("entity_label").isin("PERSON", "ORGANIZATION", "GPE", "LOC", "EVENT")))
    canonical = named.join(canonical_entities(named).withColumnRenamed("raw", "entity_text"), "entity_text").select("article_id", F.col("canonical").alias("entity_text"), "entity_label")
    return sinks.checkpointed(without_bylines(sinks.checkpointed(canonical), articles))


def edges(entities: DataFrame, articles: DataFrame, *, least_raw: int = 5, least_pmi: float = 0.0) -> DataFrame:
    """[J10, D18, H22] Pairs co-mentioned ``least_raw`` times with PMI above ``least_pmi``: (source, target, weight_raw, weight_pmi).

    An entity of fewer mentions than ``least_raw`` can be in no such pair, so it leaves before the self-join; pairs are
    counted on the map side before they are shuffled."""
    mentions = entities.select("article_id", "entity_text").distinct()
    single = mentions.groupBy("entity_text").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_raw)
    kept = mentions.join(single.select("entity_text"), "entity_text", "left_semi")
    other = kept.select("article_id", F.col("entity_text").alias("target"))
    raw = kept.withColumnRenamed("entity_text", "source").join(other, "article_id").where("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight_raw")).where(F.col("weight_raw") >= least_raw)
    total = articles.where("length(content_text) > 0").agg(F.count(F.lit(1)).alias("t"))
    both = raw.join(single.select(F.col("entity_text").alias("source"), F.col("c").alias("a")), "source").join(single.select(F.col("entity_text").alias("target"), F.col("c").alias("b")), "target").crossJoin(total)  # one row on the right
    pmi = F.log(F.col("weight_raw") * F.col("t").cast("double") / (F.col("a") * F.col("b")))
    return both.select("source", "target", "weight_raw", F.round(pmi, 6).alias("weight_pmi")).where(F.col("weight_pmi") > least_pmi)


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight_raw", "weight_pmi").unionByName(graph.select(F.col("target").alias("a"), F.col("source").alias("b"), "weight_raw", "weight_pmi"))


def degrees(graph: DataFrame) -> DataFrame:
    return both_ways(graph).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def neighbours(graph: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """[Q20, J17] Undirected neighbours by PMI."""
    return both_ways(graph).where(F.lower("a") == name.lower()).select(F.col("b").alias("neighbour"), "weight_raw", "weight_pmi").orderBy(F.desc("weight_pmi"), "neighbour").limit(min(limit, 200))


def hub_cutoff(graph: DataFrame, quantile: float = 0.999) -> DataFrame:
    """[H25] The degree at index floor(quantile * nodes) in ascending order, by degree counts rather than a sort of all nodes."""
    counts = degrees(graph).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row for each degree
    return ranked.where(F.col("upto") > F.floor(F.lit(quantile) * F.col("total"))).agg(F.min("degree").alias("cutoff"))


def path_candidates(graph: DataFrame, start: str, end: str, *, least_raw: int = 15, least_pmi: float = 0.5, limit: int = 100) -> DataFrame:
    """[H27, X12] The cheapest simple paths of one to three hops, cost = sum of 1 / PMI: (path, cost, hops, inner, pmi, raw; the last
    two are lists of the edges'). Edges under the floors take part only if one of the names has no edge above them. The
    hops grow from both ends, so that only neighbours of the two names take part."""
    floors = (F.col("weight_raw") >= least_raw) & (F.col("weight_pmi") >= least_pmi)
    ends = both_ways(graph).where(F.col("a").isin(start, end)).agg(F.count_distinct(F.when(floors, F.col("a"))).alias("met"))
    e = both_ways(graph).crossJoin(ends).where(floors | (F.col("met") < 2)).select("a", "b", F.struct("weight_pmi", "weight_raw").alias("w"))  # one row on the right
    out = e.where(F.col("a") == start).select(F.col("b").alias("x"), F.col("w").alias("w1"))
    back = e.where(F.col("b") == end).select(F.col("a").alias("y"), F.col("w").alias("w2"))
    none = F.array().cast("array<string>")
    one = out.where(F.col("x") == end).select(none.alias("inner"), F.array("w1").alias("w"))
    inner = (F.col("x") != end) & (F.col("y") != start)
    two = out.join(back, out.x == back.y).where(inner).select(F.array("x").alias("inner"), F.array("w1", "w2").alias("w"))
    three = out.join(e, out.x == e.a).join(back, F.col("b") == back.y).where(inner & (F.col("x") != F.col("y"))).select(F.array("x", "y").alias("inner"), F.array("w1", "w", "w2").alias("w"))
    whole = one.unionByName(two).unionByName(three).select(
        F.array_join(F.concat(F.array(F.lit(start)), "inner", F.array(F.lit(end))), " > ").alias("path"), F.round(F.aggregate("w", F.lit(0.0), lambda s, w: s + 1 / w["weight_pmi"]), 6).alias("cost"),
        F.size("w").alias("hops"), "inner", F.col("w.weight_pmi").alias("pmi"), F.col("w.weight_raw").alias("raw"),
    )
    return whole.orderBy("cost", "path").limit(limit)


def hubs(graph: DataFrame, quantile: float = 0.999) -> DataFrame:
    """[H25] (node): lower-case names that no path goes through, by degree."""
    return degrees(graph).crossJoin(hub_cutoff(graph, quantile)).where("degree >= cutoff").select(F.lower("node").alias("node")).distinct()  # one row on the right


def scored_paths(graph: DataFrame, candidates: DataFrame, *, unfiltered: int = 20, listed: list[str] = HUBS) -> DataFrame:
    """[H25, H26, H27] The candidates without hubs and artefacts inside, with their score: geometric mean of PMI * ln(1 + geometric
    mean of counts) * product of 1 / ln(1 + degree) over the inner names. If none is left, the cheapest ``unfiltered`` of all."""
    ranked = candidates.withColumn("nth", F.row_number().over(Window.orderBy("cost", "path")))  # the hundred candidates
    each = ranked.select("nth", F.explode("inner").alias("node")).join(degrees(graph), "node").join(hubs(graph).select(F.col("node").alias("low"), F.lit(True).alias("hub")), F.lower("node") == F.col("low"), "left")
    bad = F.coalesce("hub", F.lit(False)) | F.lower("node").isin(listed) | T.artifact(F.col("node"), PARTIES, COMMON_NOUNS)
    inner = each.groupBy("nth").agg(F.max(bad).alias("bad"), F.sum(F.log(F.log(1 + F.col("degree")))).alias("penalty"))
    marked = ranked.join(inner, "nth", "left").withColumns({"bad": F.coalesce("bad", F.lit(False)), "good": F.max(~F.coalesce("bad", F.lit(False))).over(Window.partitionBy())})
    mean = lambda c: F.exp(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x.cast("double"), F.lit(1e-9)))) / F.size(c))
    score = mean("pmi") * F.log(1 + mean("raw")) * F.exp(-F.coalesce("penalty", F.lit(0.0)))
    return marked.where((F.col("good") & ~F.col("bad")) | (~F.col("good") & (F.col("nth") <= unfiltered))).select("path", "cost", "hops", "inner", F.round(score, 6).alias("score"), "nth")


def disjoint_paths(scored: DataFrame, k: int = 5) -> DataFrame:
    """[H27] Greedily the best paths that share no inner node, of equal scores the cheaper; at most the hundred candidates are looked at, in one fold."""
    listed = scored.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "nth", "path", "cost", "hops", "inner", "score"))).alias("l"))
    step = f"""aggregate(l, named_struct('used', cast(array() AS array<string>), 'out', slice(l, 1, 0)), (s, p) ->
        CASE WHEN size(s.out) < {k} AND NOT coalesce(arrays_overlap(s.used, p.inner), false)
             THEN named_struct('used', concat(s.used, p.inner), 'out', concat(s.out, array(p))) ELSE s END).out"""
    return listed.select(F.posexplode(F.expr(step)).alias("path_id", "p")).select("path_id", "p.path", "p.cost", "p.hops", "p.score")


def edge_articles(entities: DataFrame, articles: DataFrame, a: str, b: str) -> DataFrame:
    """[E3, J9, Q23] The newest article of each outlet that names both."""
    of = lambda x: entities.where(F.col("entity_text") == x).select("article_id").distinct()
    both = of(a).join(of(b), "article_id")
    rows = articles.join(both, articles.id == both.article_id, "left_semi").where("is_excluded = false OR is_excluded IS NULL")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("outlet_id").orderBy(F.desc("published_on"), "id"))).where("rn = 1").select("outlet_id", "id", "published_on")


def path_articles(paths_: DataFrame, entities: DataFrame, articles: DataFrame, limit: int = 10) -> DataFrame:
    """[Q23, E3, J9] (path_id, step, source, target, rank, id, outlet_id, published_on): for each edge of each path (path_id, path as ``A > B > C``) the newest
    article of each outlet that names both ends, of these the ``limit`` newest; ties by id. All edges at once: only mentions of names that stand on a path are
    joined, and an edge that several paths have is looked up once."""
    names = F.split("path", " > ")
    steps = paths_.select("path_id", names.alias("n")).select("path_id", "n", F.posexplode(F.slice("n", 1, F.size("n") - 1)).alias("step", "source")).select("path_id", "step", "source", F.expr("n[step + 1]").alias("target"))
    steps = sinks.checkpointed(steps)
    edge = steps.select("source", "target").distinct()
    of = lambda side: entities.select(F.col("entity_text").alias(side), "article_id").distinct().join(edge.select(side).distinct(), side, "left_semi")
    both = edge.join(of("source"), "source").join(of("target"), ["target", "article_id"])
    rows = both.join(articles.where("is_excluded = false OR is_excluded IS NULL").select(F.col("id").alias("article_id"), "outlet_id", "published_on"), "article_id")
    newest = [F.desc("published_on"), F.col("article_id")]
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source", "target", "outlet_id").orderBy(*newest))).where("rn = 1").drop("rn")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("source", "target").orderBy(*newest))).where(F.col("rank") <= limit)
    return steps.join(best, ["source", "target"]).select("path_id", "step", "source", "target", "rank", F.col("article_id").alias("id"), "outlet_id", "published_on")


def direct_articles(entities: DataFrame, articles: DataFrame, a: str, b: str, limit: int = 20) -> DataFrame:
    """[J7, F1, X20] The newest articles that name both."""
    of = lambda x: entities.where(F.col("entity_text") == x).select(F.col("article_id").alias("id"))
    return articles.join(of(a), "id", "left_semi").join(of(b), "id", "left_semi").select("id", "outlet_id", "published_on").orderBy(F.desc("published_on"), "id").limit(limit)


def entity_articles(entities: DataFrame, articles: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """[Q21] The newest articles of an entity."""
    one = entities.where(F.lower("entity_text") == name.lower()).select(F.col("article_id").alias("id"))
    return articles.join(one, "id", "left_semi").select("id", "title", "published_on").orderBy(F.desc("published_on"), "id").limit(limit)


def autocomplete(entities: DataFrame, graph: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """[Q22, F6] Names by prefix or part: prefix matches first, then degree, then articles. Fewer than two letters find nothing."""
    counted = entities.groupBy(F.col("entity_text").alias("name")).agg(F.countDistinct("article_id").alias("article_count"))
    found = counted.where(F.lower("name").contains(prefix.lower()) & F.lit(len(prefix) >= 2)).join(degrees(graph), F.col("name") == F.col("node"), "left")
    out = found.select("name", F.lower("name").startswith(prefix.lower()).cast("int").alias("starts"), F.coalesce("degree", F.lit(0)).alias("degree"), "article_count")
    return out.orderBy(F.desc("starts"), F.desc("degree"), F.desc("article_count"), "name").limit(limit)


def trigrams(text):
    """[G30] The distinct trigrams of a name, two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def similar_names(names: DataFrame, name: str, least: float = 0.3) -> DataFrame:
    """[G30] Names of a trigram similarity of ``least`` or more. names: name."""
    a, b = trigrams(F.col("name")), trigrams(F.lit(name))
    sim = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return names.select("name", F.round(sim, 6).alias("similarity")).where(F.col("similarity") >= least)


def graph_stats(graph: DataFrame, rounds: int = 50) -> DataFrame:
    """[H24] Nodes, edges, components and the size of the largest, by least-label propagation over checkpoints."""
    e = both_ways(graph).select("a", "b")
    sinks.shared_folder(graph.sparkSession)
    e = e.checkpoint()
    now = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).checkpoint()
    for _ in range(rounds):
        via = e.join(now.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = now.select(F.col("a").alias("label"), F.col("label").alias("root"))
        new = now.join(via, "a", "left").select("a", F.least("label", F.coalesce("near", "label")).alias("label")).join(jump, "label", "left").select("a", F.least("label", F.coalesce("root", "label")).alias("label")).checkpoint()
        changed = new.withColumnRenamed("label", "l2").join(now, "a").where("l2 <> label").limit(1).count()
        now = new
        if not changed:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    sizes = now.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    return sizes.crossJoin(graph.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def resolve(graph: DataFrame, name: str) -> DataFrame:
    """[G34] One row (canonical, found): the node that is the name but for case, or else the only node that has it as a part, or else the name."""
    low = name.strip().lower()
    nodes = both_ways(graph).select(F.col("a").alias("node")).distinct().where(F.lower("node").contains(low))
    found = nodes.agg(F.min(F.when(F.lower("node") == low, F.col("node"))).alias("same"), F.min("node").alias("only"), F.count(F.lit(1)).alias("n"))
    node = F.coalesce("same", F.when(F.col("n") == 1, F.col("only")))
    return found.select(F.coalesce(node, F.lit(name.strip())).alias("canonical"), node.isNotNull().alias("found"))


def paths(graph: DataFrame, a: str, b: str, *, k: int = 5, max_hops: int = 3, least_raw: int = 15, least_pmi: float = 0.5) -> DataFrame:
    """[Q25, H27] Node-disjoint paths between two names, at most ten of at most three hops. Two equal or empty names raise ValueError,
    and names of no node LookupError with the names; the two names are resolved first, which reads one row."""
    asked = [a.strip(), b.strip()]
    if not all(asked) or asked[0].lower() == asked[1].lower():
        raise ValueError("two different names are needed")
    nodes = both_ways(graph).select(F.col("a").alias("node"))
    same = [F.min(F.when(F.lower("node") == x.lower(), F.col("node"))).alias(side) for side, x in zip("ab", asked)]
    known = nodes.agg(*same).first()
    missing = [x for x, node in zip(asked, known) if node is None]
    if missing:
        raise LookupError(f"no such node: {', '.join(missing)}")
    found = path_candidates(graph, known["a"], known["b"], least_raw=least_raw, least_pmi=least_pmi)
    return disjoint_paths(scored_paths(graph, found.where(F.col("hops") <= min(max_hops, 3))), min(k, 10))
