"""Benchmark decontamination over a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # upper case counts here, as nothing is lower-cased first
#: Broadcast a table of test terms only up to so many rows and bytes (of its rows as JSON).
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20
#: Bits of the map that tells which documents may have a match; it takes 4 MB at most, whatever the corpus.
MAP_BITS = 1 << 25


def terms(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def word_count(text: Column) -> Column:
    """How many `terms` a text has, as the pieces between runs of other characters.

    Splitting keeps no match objects, as counting matches would; only the first and the last piece can be empty.
    """
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _NO_WORD), "")).cast("long")


def _small(frame: DataFrame) -> DataFrame:
    """Marks a stored table for broadcast if it is small; a larger one is joined by shuffle, where Spark splits what is skewed."""
    size = frame.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(frame) if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES else frame


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (
        docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
        .select("doc_id", F.xxhash64("_text").alias("doc_key"), terms(F.col("_text")).alias("_words"))
        .select("doc_id", "doc_key", F.posexplode("_words").alias("pos", "term"))
    )


def test_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, no, words): the items that have words, numbered, and stored so that the numbers stay."""
    w = items.select(items[id_col].cast("string").alias("item_id"), terms(items[text_col]).alias("words")).where("size(words) > 0")
    return cut(w.withColumn("no", F.monotonically_increasing_id()))


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(no, item_id, s, n, phrase) of numbered items: each `size` consecutive words from word s on; a shorter item is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return items.select("no", "item_id", "words", F.explode(starts).alias("s")).select("no", "item_id", "s", F.least(F.size("words"), F.lit(size)).alias("n"), F.slice("words", F.col("s") + 1, size).alias("phrase"))


def term_counts(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, count): how often each term of `vocabulary` (distinct column term) stands in the training documents."""
    return _tokens(docs, id_col, text_col).select("term").join(_small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def positional_index(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, doc_id, doc_key, pos); pos counts a document's words from 0.

    doc_key hashes the text, so that rows with one id but different texts stay
    apart. Only the terms of `vocabulary` (distinct column term) are indexed, or
    all without it. Null and empty texts have no postings. Written to a table it
    answers exact phrases (aligned, phrase_matches) and proximity (proximity_matches).
    """
    t = _tokens(docs, id_col, text_col)
    t = t if vocabulary is None else t.join(_small(vocabulary), "term")
    return t.select("term", "doc_id", "doc_key", "pos")


def rarest_terms(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(no, item_id, s, n, phrase, lo, hi): the places, in the item, of each window's two rarest terms (lo = hi for one word).

    A window with a term that the documents lack can't occur and has no row.
    """
    t = wins.select("no", "s", F.posexplode("phrase").alias("_at", "term")).join(counts, "term", "left")
    by = Window.partitionBy("no", "s")
    t = t.withColumns({"_lack": F.sum(F.isnull("count").cast("int")).over(by), "_r": F.row_number().over(by.orderBy("count", "_at"))})
    two = t.where("_lack = 0 and _r <= 2").groupBy("no", "s").agg(F.min(F.col("s") + F.col("_at")).alias("lo"), F.max(F.col("s") + F.col("_at")).alias("hi"))
    return wins.join(two, ["no", "s"])


def aligned(index: DataFrame, lists: DataFrame, numbered: DataFrame) -> DataFrame:
    """Candidates (doc_id, doc_key, start, n, phrase, item_id): windows whose two rarest terms stand in a document at the right distance.

    Each posting is moved back by its term's place in the item. Postings of an
    item that then agree on one start in one document are intersected: a window
    stays if both its terms lie in the range of places that agree.
    """
    places = lists.select("no", F.explode(F.array("lo", "hi")).alias("place")).distinct()
    single = lists.groupBy("no").agg(F.min(F.col("hi") > F.col("lo")).alias("_pairs"))
    places = places.join(numbered.select("no", "words"), "no").join(single, "no").select("no", "place", "_pairs", F.element_at("words", F.col("place") + 1).alias("term"))
    moved = index.join(_small(cut(places)), "term").withColumn("base", F.col("pos") - F.col("place"))
    met = moved.groupBy("doc_id", "doc_key", "no", "base").agg(F.min("place").alias("_from"), F.max("place").alias("_to"), F.min("_pairs").alias("_pairs"))
    met = met.where((F.col("_to") > F.col("_from")) | ~F.col("_pairs"))
    found = met.join(_small(lists), "no").where((F.col("lo") >= F.col("_from")) & (F.col("hi") <= F.col("_to")) & (F.col("base") + F.col("s") >= 0))
    return found.select("doc_id", "doc_key", (F.col("base") + F.col("s")).alias("start"), "n", F.array_join("phrase", " ").alias("phrase"), "item_id")


def _cell(doc_id: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, key), F.lit(MAP_BITS))


def _may_match(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, _k, ...) with `_may`: false only if `found` (_id, _key) has nothing for the document.

    The bits of a map of fixed size, made of the documents found; so texts needn't be
    shuffled, nor the matches broadcast, to part the documents with matches from the others.
    """
    cell = _cell(F.col("_id"), F.col("_key"))
    bits = found.select(F.bitmap_bucket_number(cell).alias("_b"), F.bitmap_bit_position(cell).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_bits"))
    own = _cell(F.col("doc_id"), F.col("_k"))
    d = docs.withColumns({"_own": F.bitmap_bucket_number(own), "_p": F.bitmap_bit_position(own)}).join(F.broadcast(bits), F.col("_own") == F.col("_b"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.call_function("shiftright", byte, (F.col("_p") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return d.withColumn("_may", F.coalesce(F.when(F.col("_bits").isNotNull(), one), F.lit(False))).drop("_own", "_p", "_b", "_bits")


def phrase_matches(docs: DataFrame, candidates: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, the columns `carry` as a struct `row`, and `matches` (array of start, n, item_id) of every document: the candidates whose other words agree too.

    Only documents that may have a candidate are joined to them; the others pass as they are read.
    """
    found = cut(candidates.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "n", "phrase", "item_id")).alias("_found")).withColumnsRenamed({"doc_id": "_id", "doc_key": "_key"}))
    row = F.struct(*((docs[c] for c in carry) if carry else [F.lit(0).alias("_")])).alias("row")
    d = _may_match(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), row).withColumn("_k", F.xxhash64("_text")), found)
    near = d.where("_may").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left").withColumn("_words", terms(F.col("_text")))
    same = F.filter("_found", lambda m: F.array_join(F.slice("_words", m["start"] + 1, m["n"]), " ") == m["phrase"])
    none = F.from_json(F.lit("[]"), "array<struct<start:int,n:int,item_id:string>>")
    matches = F.coalesce(F.transform(same, lambda m: F.struct(m["start"].alias("start"), m["n"].alias("n"), m["item_id"].alias("item_id"))), none)
    clear = d.where("not _may").select("doc_id", word_count(F.col("_text")).alias("n_words"), "row", none.alias("matches"))
    return clear.unionByName(near.select("doc_id", F.size("_words").cast("long").alias("n_words"), "row", matches.alias("matches")))


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int = 3) -> DataFrame:
    """(doc_id, doc_key, no, pos): postings of a phrase's first term near which all its terms stand.

    `phrases` has (no, phrase array<string>); near means within the phrase's
    length plus `slop` words, before or after, in any order.
    """
    t = phrases.select("no", F.size("phrase").alias("n"), F.array_distinct("phrase").alias("_p")).select("no", "n", F.size("_p").alias("_of"), F.element_at("_p", 1).alias("_first"), F.explode("_p").alias("term"))
    hits = index.join(t, "term").select("doc_id", "doc_key", "no", "pos", "term", "n", "_of", "_first")
    first = hits.where(F.col("term") == F.col("_first")).select(F.col("doc_id").alias("_d"), F.col("doc_key").alias("_k"), F.col("no").alias("_no"), F.col("pos").alias("_pos"))
    key = F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("doc_key")) & (F.col("_no") == F.col("no"))
    near = first.join(hits, key & (F.abs(F.col("pos") - F.col("_pos")) < F.col("n") + slop))
    by = near.groupBy("_d", "_k", "_no", "_pos").agg(F.count_distinct("term").alias("_n"), F.min("_of").alias("_of")).where("_n = _of")
    return by.select(F.col("_d").alias("doc_id"), F.col("_k").alias("doc_key"), F.col("_no").alias("no"), F.col("_pos").alias("pos"))


def _found(docs: DataFrame, numbered: DataFrame, id_col: str, text_col: str, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    wins = windows(numbered, size)
    vocabulary = cut(numbered.select(F.explode("words").alias("term")).distinct())
    lists = cut(rarest_terms(wins, cut(term_counts(docs, vocabulary, id_col, text_col))))
    wanted = lists.select("no", F.explode(F.array("lo", "hi")).alias("_p")).join(numbered, "no").select(F.element_at("words", F.col("_p") + 1).alias("term")).distinct()
    index = cut(positional_index(docs, cut(wanted), id_col, text_col))
    return phrase_matches(docs, aligned(index, lists, numbered), id_col, text_col, carry)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of any item's window. Rows are
    counted one by one, so repeated rows repeat; null ids stay null; a null or
    empty text has no words and no hits; without items nothing is hit; an empty
    table gives no row. Items without an id hit words like others; together they
    count as one in n_items, and items_sha256 leaves them out. Other columns are not read.
    """
    found = _found(docs, test_items(items, item_id_col, item_text_col), id_col, text_col, size)
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))))
    found = found.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["item_id"]))).alias("_items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows without any occurrence of an item's window (the item's id may be null), with all their columns as they are."""
    columns = tuple(docs.columns)
    found = _found(docs, test_items(items, item_id_col, item_text_col), id_col, text_col, size, columns)
    return found.where(F.size("matches") == 0).select(*(F.col("row")[c].alias(c) for c in columns))
