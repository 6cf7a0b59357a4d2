"""Entity names: spans from tags, filters, one canonical form for each name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from newsloom.functions.text import strip_titles

# Fixed values.
SYNONYMS = {
    "ue": "Uniunea Europeană",
    "uniunea europeană": "Uniunea Europeană",
    "uniunii europene": "Uniunea Europeană",
    "iranului": "Iran",
    "iranul": "Iran",
    "sua": "Statele Unite",
    "statele unite": "Statele Unite",
    "statelor unite": "Statele Unite",
    "statele unite ale americii": "Statele Unite",
    "statelor unite ale americii": "Statele Unite",
    "onu": "ONU",
    "organizația națiunilor unite": "ONU",
    "organizației națiunilor unite": "ONU",
    "oms": "OMS",
    "organizația mondială a sănătății": "OMS",
    "bce": "BCE",
    "banca centrală europeană": "BCE",
    "băncii centrale europene": "BCE",
    "ce": "Comisia Europeană",
    "comisia europeană": "Comisia Europeană",
    "comisiei europene": "Comisia Europeană",
    "pe": "Parlamentul European",
    "parlamentul european": "Parlamentul European",
    "parlamentului european": "Parlamentul European",
    "partidul social democrat": "PSD",
    "partidului social democrat": "PSD",
    "partidul național liberal": "PNL",
    "partidului național liberal": "PNL",
    "uniunea salvați românia": "USR",
    "alianța pentru unirea românilor": "AUR",
    "alianței pentru unirea românilor": "AUR",
    "uniunea democrată maghiară din românia": "UDMR",
    "direcția națională anticorupție": "DNA",
    "direcției naționale anticorupție": "DNA",
    "serviciul român de informații": "SRI",
    "serviciului român de informații": "SRI",
    "curtea constituțională": "CCR",
    "curtea constituțională a româniei": "CCR",
    "curții constituționale": "CCR",
    "banca națională a româniei": "BNR",
    "băncii naționale a româniei": "BNR",
    "consiliul superior al magistraturii": "CSM",
    "consiliului superior al magistraturii": "CSM",
    "agenția națională de administrare fiscală": "ANAF",
    "serviciul de telecomunicații speciale": "STS",
    "inspectoratul general al poliției române": "IGPR",
    "organizația tratatului atlanticului de nord": "NATO",
    "north atlantic treaty organization": "NATO",
    "partidul national liberal": "PNL",
    "federation internationale de football association": "FIFA",
    "maniunea europeana": "Uniunea Europeană",
    "uniunea europeana": "Uniunea Europeană",
}
LEMMAS = {"stat unit": "Statele Unite", "uniune european": "Uniunea Europeană", "comisie european": "Comisia Europeană", "iranului": "Iran", "zelenski": "Volodimir Zelenski"}
TITLES = ["președintele", "președinte", "premierul", "premier", "ministrul", "ministra", "ministru", "vicepremierul", "senatorul", "senatoarea", "senator", "senatoare", "deputatul", "deputata", "deputat", "deputată", "primarul", "primar", "guvernatorul", "guvernatoarea", "consilierul", "miliardarul", "domnul", "doamna", "dl", "dna", "profesor", "profesoara", "profesorul", "prof", "doctor", "doctorul", "doctoriță", "dr", "academicianul", "generalul", "general", "colonelul", "colonel", "capitanul", "capitan", "locotenentul", "locotenent", "judecătorul", "judecătoarea", "procurorul", "procuroarea", "ambasadorul", "ambasadoarea", "regele", "regina", "principele", "principesa", "prințul", "papa", "patriarhul", "părintele", "preotul"]
TWO_WORD_TITLES = ["fostul președinte", "fosta președintă", "fostul premier", "fostul ministru", "fosta ministră", "fostul primar", "fosta primar", "prim-ministrul", "prim-ministru", "ex-președintele", "ex-premier", "ex-ministrul", "viceprim-ministrul", "vice-premier"]
TRAILING_TITLES = ["președinte", "președintele", "premier", "premierul", "ministru", "ministrul", "senator", "deputat", "primar", "ex-președinte", "ex-premier", "ex-ministru", "fost președinte", "fost premier"]
NOISE = ["INTERVIU", "EXCLUSIV", "FOTO", "UPDATE", "VIDEO", "DOCUMENT", "LIVE", "BREAKING"]
CREDITS = ["editor", "autor", "reporter", "foto", "sursa", "corespondent", "agerpres", "redactia"]
CONTEXT = ["foto", "autor", "sursa", "imagine", "credit", "reporter", "redactor", "corespondent"]  # words before a name that is a credit
BLOCKED = ["facebook", "instagram", "telegram", "twitter", "tiktok", "whatsapp", "youtube", "inquam", "getty", "cnn", "cnbc", "antena", "digi", "b1", "protv", "realitatea", "guardian", "bbc", "bloomberg", "trunchiat", "fals", "context lipsă", "fake news", "erata", "google", "spotmedia", "ziare.com", "tik tok", "covid", "dreamstime", "foto"]
AGENCIES = ["agerpres", "reuters", "mediafax", "afp", "ap"]
TAGS = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "GPE", "LOC": "LOC", "EVENT": "EVENT", "NAT_REL_POL": "ORGANIZATION", "FACILITY": "LOC"}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    """The table's value, or null; the table is a literal map of a fixed size."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.lower(F.trim(key)))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalise_unicode(text: Column) -> Column:
    """[G6] Composed characters (Spark has no function for that: Arrow batches) and comma below instead of the cedilla."""
    return F.translate(_composed(text), "şŞţŢ", "șȘțȚ")


def synonym(text: Column) -> Column:
    """[G7] The agreed form of a name, or null."""
    return _looked_up(SYNONYMS, text)


def normalise(text: Column, lemma: Column) -> Column:
    """[G6, G7, G8, G10] A name as it is compared: composed, without underscores; the agreed form of its surface if there is a different one, or
    else its lemma with overrides; without titles. A null or empty name is empty. Surnames are resolved by surnames(), with the whole article."""
    surface = F.trim(F.replace(normalise_unicode(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" ")))
    base = F.coalesce(normalise_unicode(F.nullif(lemma, F.lit(""))), surface)
    agreed = synonym(surface)
    chosen = F.when(agreed != surface, agreed).otherwise(F.coalesce(_looked_up(LEMMAS, base), base))
    return F.when(surface == "", "").otherwise(F.trim(strip_titles(chosen, TITLES, TWO_WORD_TITLES, TRAILING_TITLES)))


def surnames(entities: DataFrame) -> DataFrame:
    """[G9] A one-word person becomes the only longer person of its article that ends in it. entities: article_id, entity_text, entity_label."""
    people = entities.where("entity_label = 'PERSON'").select("article_id", F.trim("entity_text").alias("full")).where("instr(full, ' ') > 0")
    by = people.groupBy("article_id", F.substring_index("full", " ", -1).alias("last")).agg(F.min("full").alias("full"), F.countDistinct("full").alias("n")).where("n = 1")
    one = by.select(F.col("article_id").alias("in_article"), "last", "full")
    held = (F.col("article_id") == F.col("in_article")) & (F.trim("entity_text") == F.col("last")) & (F.col("entity_label") == "PERSON")
    return entities.join(one, held, "left").select("article_id", "entity_text", "entity_label", F.coalesce("full", "entity_text").alias("name"))


def spans(words: DataFrame) -> DataFrame:
    """[G13] (article_id, start, entity_text, entity_label) from words with B-, I- and O tags: article_id, pos, text, tag.

    A span reaches from a B- to the first tag that doesn't continue its label; unknown labels go. Both windows and the
    aggregation share one shuffle by article."""
    article = Window.partitionBy("article_id").orderBy("pos")
    begun = words.withColumn("span", F.sum(F.col("tag").startswith("B-").cast("int")).over(article)).where("span > 0")
    inside = Window.partitionBy("article_id", "span").orderBy("pos")
    label = F.substr(F.first("tag").over(inside), F.lit(3))
    kept = begun.withColumn("label", label).withColumn("broken", F.sum((~F.col("tag").startswith("B-") & (F.col("tag") != F.concat(F.lit("I-"), "label"))).cast("int")).over(inside)).where("broken = 0")
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " "))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair)), F.col("label"))
    out = kept.groupBy("article_id", "span", "label").agg(F.min("pos").alias("start"), joined.alias("entity_text")).withColumn("entity_label", named)
    return out.where("entity_label IS NOT NULL").select("article_id", "start", "entity_text", "entity_label")


def plausible(text: Column, label: Column, rules: str = "tagger") -> Column:
    """[G12] Whether a span can be a name. tagger: at most 60 characters, no asterisk, no leading noise word, places of at most 6 words.
    parser: at most 40 characters, no slash, no noise word, places of at most 5 words, agencies blocked too."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(F.translate(clean, "İ", "i"))  # lower() makes an i and a dot of it, which would hide a blocked name
    n_words = F.size(F.array_remove(F.split(clean, r"\s+"), ""))
    noise = F.upper(clean).isin(NOISE)
    if rules == "tagger":
        shape = (F.length(clean) <= 60) & ~clean.contains("*") & ~F.upper(clean).rlike(f"^(?:{'|'.join(NOISE)}) ")
        blocked, place = BLOCKED, n_words <= 6
    else:
        shape = (F.length(clean) <= 40) & ~clean.contains("/")
        blocked, place = BLOCKED + AGENCIES, (n_words <= 5) & ~low.isin("tik tok", "tiktok")
    organisation = ~low.rlike("|".join(b.replace(".", r"\.") for b in blocked))
    return clean.rlike(r"^\p{Lu}") & shape & ~noise & ((label != "ORGANIZATION") | organisation) & ((label != "LOC") | place)


def uncredited(spans_: DataFrame, words: DataFrame, credits: list[str] = CONTEXT) -> DataFrame:
    """[G12] The spans (article_id, start, entity_text, entity_label) without persons that one of the three words before them gives as the source of a picture or text:
    words (article_id, pos, text) are compared by their letters in lower case. The few credit words are dealt to the three places after them, an
    equality of the join."""
    credit = words.where(F.lower(F.regexp_replace("text", r"[^\p{L}]", "")).isin(credits)).select("article_id", F.explode(F.array(*(F.col("pos") + k for k in (1, 2, 3)))).alias("start"))
    marked = spans_.join(credit.distinct().withColumn("credited", F.lit(True)), ["article_id", "start"], "left")
    return marked.where("credited IS NULL OR entity_label <> 'PERSON'").select(*spans_.columns)


def _parts(x: Column) -> Column:
    """Every substring of a short string."""
    size = F.length(x)
    of = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(x, i, n)))
    return F.array_distinct(F.flatten(of))


def _pairs(x: Column) -> Column:
    """Every pair of different words, in order."""
    words = F.array_sort(F.array_distinct(F.array_remove(F.split(x, r"\s+"), "")))
    of = F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.concat(F.lit("2 "), a, F.lit(" "), b)))
    return F.flatten(of)


def without_authors(entities: DataFrame, known: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """[G15] Entities without persons who are authors: one name within the other, two words in common, or a credit in the name.

    known: name, of the whole corpus; authors: article_id, name, of one article. Each test is an equality of keys (a name against the
    other's substrings, word pairs against word pairs), so that no name meets every other; the distinct names make the keys, not the rows.
    Blank known names do nothing."""
    clean = lambda c: F.lower(F.trim(c))
    mine = lambda x: F.concat(F.transform(_parts(x), lambda p: F.concat(F.lit("s "), p)), F.array(F.concat(F.lit("i "), x)), _pairs(x))
    theirs = lambda x: F.concat(F.transform(_parts(x), lambda p: F.concat(F.lit("i "), p)), F.array(F.concat(F.lit("s "), x)), _pairs(x))
    people = entities.where("entity_label = 'PERSON'").select("article_id", clean("entity_text").alias("low")).where("low <> ''").distinct()
    names = people.select("low").distinct().select("low", F.explode(mine(F.col("low"))).alias("key"))
    keys = known.select(clean("name").alias("k")).where("k <> ''").distinct().select(F.explode(theirs(F.col("k"))).alias("key")).distinct()
    gone = names.join(keys, "key", "left_semi").select("low").unionByName(people.select("low").where(F.col("low").rlike("|".join(CREDITS)))).distinct()
    left = entities.withColumn("low__", F.when(F.col("entity_label") == "PERSON", clean("entity_text"))).join(gone.select(F.col("low").alias("low__")), "low__", "left_anti")
    if authors is not None:
        local = authors.select("article_id", clean("name").alias("k")).where("k <> ''").distinct()
        hit = people.join(local, "article_id").where(F.col("low").contains(F.col("k")) | F.col("k").contains(F.col("low")) | F.arrays_overlap(_pairs(F.col("low")), _pairs(F.col("k"))))
        left = left.join(hit.select("article_id", F.col("low").alias("low__")).distinct(), ["article_id", "low__"], "left_anti")
    return left.select(*entities.columns)


def augmented_text(articles: DataFrame, entities: DataFrame, most: int = 1_500) -> DataFrame:
    """[G16] (id, augmented): the text to encode: up to six persons, four organisations, four places and two events under their
    headings, then the title and the first ``most`` characters. The names are the first ones found, in that order: entities have a column place."""
    groups = [("Persoane", ["PERSON"], 6), ("Organizații", ["ORGANIZATION"], 4), ("Locuri", ["GPE", "LOC"], 4), ("Evenimente", ["EVENT"], 2)]  # fixed values
    first = entities.groupBy("article_id", "entity_label", "entity_text").agg(F.min("place").alias("place"))
    picked = [F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("entity_label").isin(labels), F.struct("place", "entity_text")))), 1, n), lambda s: s["entity_text"]) for _, labels, n in groups]
    found = first.groupBy(F.col("article_id").alias("id")).agg(*(p.alias(f"p{k}") for k, p in enumerate(picked)))
    parts = [F.when(F.size(f"p{k}") > 0, F.concat(F.lit(f"{name}: "), F.array_join(f"p{k}", ", "))) for k, (name, _, _) in enumerate(groups)]
    found = found.select("id", F.concat_ws(". ", *parts).alias("names"))
    body = F.concat_ws(" ", "title", F.substring(F.coalesce("content_text", F.lit("")), 1, most))
    return articles.select("id", "title", "content_text").join(found, "id", "left").select("id", F.concat(F.lit("passage: "), F.when(F.col("names").isNotNull(), F.concat("names", F.lit(". "))).otherwise(""), body).alias("augmented"))
