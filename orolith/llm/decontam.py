"""Benchmark decontamination by a stored positional inverted index over training tokens.

The index is a Parquet table in the shared folder of postings (term, doc_id, tie, pos). A first pass counts the items' terms.
Stored for all training documents are the postings of each phrase's two rarest terms; the list of the rarest, shifted by
the term's offset in the phrase, gives places where the phrase may start, and these are intersected with the shifted list
of the second. Only for the documents that are left are the postings of the other terms stored and intersected likewise:
storing those of every frequent term would take several times the texts. Lists meet by (phrase, document, position), so a
frequent term is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, fresh, scratch_path, stable

WIDTH = 10
#: A table is broadcast up to so many bytes by its own measure; beyond, the join deals both sides by its keys.
MOST_BROADCAST = 32 << 20
PLACE = ["doc_id", "tie", "start"]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _tie(text: Column) -> Column:
    """With doc_id it names a document; rows that share both are equal."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def phrases(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(phrase, items): the distinct windows of `width` consecutive words of (item_id, text), with the items that have
    them; an item of fewer words, but not none, is one window."""
    worded = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = worded.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))).alias("at"))
    return cut.select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("phrase")).groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def _sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows take few bytes together, as measured."""
    width = lambda c, t: F.coalesce(F.octet_length(F.to_json(F.struct(c)) if t.startswith(("array", "struct")) else F.col(c).cast("string")), F.lit(0))
    total = df.select(F.sum(sum((width(c, t) for c, t in df.dtypes), F.lit(64))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= MOST_BROADCAST else df


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, tie, pos): a posting for each word of (doc_id, text) that is in terms (term)."""
    worded = documents.select("doc_id", _tie(F.col("text")).alias("tie"), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return worded.join(_sized(terms), "term").select("term", "doc_id", "tie", "pos")


def index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings, written to the shared folder once."""
    path = scratch_path(documents.sparkSession, "postings")
    postings(documents, terms).write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def ranked(offsets: DataFrame, documents: DataFrame, by: str) -> DataFrame:
    """offsets (by, term, offset) with n, how often documents have the term, and rank, from 1, by how rare it is among its
    group's; ties by offset. Counts are added up before any shuffle."""
    terms = stable(offsets.select("term").distinct())
    counts = stable(postings(documents, terms).groupBy("term").agg(F.count("*").alias("n")))
    rarest = W.partitionBy(by).orderBy("n", "offset")  # at most an item's words to a group
    return stable(offsets.join(_sized(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(rarest)))


def phrase_matches(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, tie, start, stop, items): each place of documents where a phrase of found (phrase, items) stands; rows that
    share doc_id and text share their places."""
    named = stable(found.withColumn("phrase_id", F.xxhash64("phrase")))
    if named.count() != named.select("phrase_id").distinct().count():  # two phrases with one hash
        named = stable(named.drop("phrase_id").withColumn("phrase_id", F.monotonically_increasing_id()))
    offsets = named.select("phrase_id", F.posexplode("phrase").alias("offset", "term"))
    order = ranked(offsets, documents, "phrase_id")
    absent = order.where("n = 0").select("phrase_id").distinct()  # phrases with a term that no document has go at once
    order = stable(order.join(absent, "phrase_id", "left_anti"))
    rare = index(documents, order.where("rank <= 2").select("term").distinct())
    lists = lambda where: _sized(order.where(where).select("phrase_id", "term", "offset"))
    single = order.groupBy("phrase_id").agg(F.max("rank").alias("n_terms"))

    def met_by(places: DataFrame, where: str, stored: DataFrame) -> DataFrame:
        """The places (phrase_id, doc_id, tie, start) with a row for each term asked for that stands where it should."""
        asked = places.join(lists(where), "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
        same = (asked["term"] == stored["term"]) & asked["doc_id"].eqNullSafe(stored["doc_id"]) & (asked["tie"] == stored["tie"]) & (asked["pos"] == stored["pos"])
        return asked.join(stored, same, "left_semi").select("phrase_id", *PLACE)

    near = rare.join(lists("rank = 1"), "term").select("phrase_id", "doc_id", "tie", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    left = stable(met_by(near, "rank = 2", rare).unionByName(near.join(_sized(single.where("n_terms = 1").select("phrase_id")), "phrase_id", "left_semi")))
    own, place_id, place_tie = fresh(documents, "place_of", "place_id", "place_tie")
    places = stable(left.select(F.col("doc_id").alias(place_id), F.col("tie").alias(place_tie)).distinct())
    open_ = documents.withColumn(own, _tie(F.col("text"))).join(_sized(places), F.col("doc_id").eqNullSafe(F.col(place_id)) & (F.col(own) == F.col(place_tie)), "left_semi")
    rest = index(open_, order.where("rank > 2").select("term").distinct())
    met = met_by(left, "rank > 2", rest).groupBy("phrase_id", *PLACE).agg(F.count("*").alias("met"))
    wanted = single.where("n_terms > 2")
    whole = met.join(_sized(wanted), "phrase_id").where("met = n_terms - 2").select("phrase_id", *PLACE)
    short = left.join(_sized(single.where("n_terms <= 2").select("phrase_id")), "phrase_id", "left_semi")
    exact = whole.unionByName(short).join(_sized(named.select("phrase_id", F.size("phrase").alias("width"), "items")), "phrase_id")
    return exact.select("doc_id", "tie", "start", (F.col("start") + F.col("width")).alias("stop"), "items")


def proximity_matches(documents: DataFrame, items: DataFrame, terms: int = 3, span: int = 20) -> DataFrame:
    """(doc_id, tie, item_id, start, stop): places where the `terms` rarest distinct words of an item stand within `span`
    words, in any order, from stored postings. Items of fewer distinct words are left out. For each place of a word
    that completes a set, the shortest stretch that ends there. A document is dealt by stretches of `span` words, each
    with the stretch before it, so neither a long document nor a frequent word is one task's."""
    worded = items.select(F.col("item_id").cast("string").alias("item_id"), F.array_distinct(words_of(F.col("text"))).alias("words"))
    listed = stable(worded.select("item_id", F.posexplode("words").alias("offset", "term")))
    chosen = stable(ranked(listed, documents, "item_id").where(F.col("rank") <= terms).select("item_id", "term", "rank"))
    hits = index(documents, chosen.select("term").distinct()).join(_sized(chosen), "term").withColumn("own", F.floor(F.col("pos") / span))
    dealt = hits.withColumn("stretch", F.explode(F.array("own", F.col("own") + 1)))
    upto = W.partitionBy("doc_id", "tie", "item_id", "stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = [F.max(F.when(F.col("rank") == k + 1, F.col("pos"))).over(upto).alias(f"last{k}") for k in range(terms)]
    placed = dealt.select("doc_id", "tie", "item_id", "pos", "own", "stretch", *last).where("own = stretch")
    whole = placed.where(" and ".join(f"last{k} is not null" for k in range(terms)))
    first = F.least(*[F.col(f"last{k}") for k in range(terms)]) if terms > 1 else F.col("last0")
    return whole.select("doc_id", "tie", "item_id", first.alias("start"), (F.col("pos") + 1).alias("stop")).where(F.col("stop") - F.col("start") <= span).distinct()


def covered(spans: Column) -> Column:
    """How many places sorted spans (start, stop) cover together."""
    step = lambda done, x: F.struct((done["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], done["upto"]))).alias("n"), F.greatest(done["upto"], x["stop"]).alias("upto"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step)["n"]


def contamination(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of documents with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word inside any occurrence of an item's window is hit. n_items counts the items with occurring windows;
    items_sha256 is of their ids, sorted as strings, comma-joined. Items without id hit words and are not counted. Null
    texts have no words; repeated rows get the same result each. Input columns of these names are replaced, no other
    name clashes. A document of any length has a posting for each of its words that an item has; an empty table of documents
    gives no rows, one of items no hits."""
    matches = phrase_matches(documents, phrases(items, width))
    own, hit_id, hit_tie, hit_words, hit_items = fresh(documents, "hit_of", "hit_id", "hit_tie", "hit_words", "hit_items")
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    merged = matches.groupBy(F.col("doc_id").alias(hit_id), F.col("tie").alias(hit_tie)).agg(covered(spans).cast("long").alias(hit_words), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias(hit_items))
    documents = documents.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept = documents.columns
    counted = documents.withColumn(own, _tie(F.col("text"))).withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    joined = counted.join(merged, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(own) == F.col(hit_tie)), "left")
    n_hit = F.coalesce(hit_words, F.lit(0)).cast("long")
    items_of = F.coalesce(hit_items, F.array().cast("array<string>"))
    return joined.select(*kept, "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of documents without any window of the items, their columns untouched, whatever their names."""
    own, hit_id, hit_tie = fresh(documents, "hit_of", "hit_id", "hit_tie")
    hits = stable(phrase_matches(documents, phrases(items, width)).select(F.col("doc_id").alias(hit_id), F.col("tie").alias(hit_tie)).distinct())
    tied = documents.withColumn(own, _tie(F.col("text")))
    return tied.join(_sized(hits), F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(own) == F.col(hit_tie)), "left_anti").select(*documents.columns)
