"""Finds passages of benchmark items in documents.

An item is cut into windows of ten consecutive words (an item of fewer words is one window). A document is hit where a whole
window occurs in it. The search is a set join with a prefix filter:

1. Every window is a set of three-word shingles with their offsets. One pass over the documents keeps the shingles that occur
   in any item, with position, and one header row per document.
2. How often each shingle was kept is its rarity. A document that holds a window holds all of its shingles, so one is enough
   as the necessary prefix: the rarest. A window with a shingle that no document has can't occur and leaves.
3. The join on that one shingle gives the only place where the window could start; it must start and end inside the document.
4. The shingles that tile the window must all stand at their places; as each is compared as text, so is the whole window.

Only DataFrame functions are used. Documents are never shuffled: only kept shingles are, by document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from lakeprofile.llm.common import ascii_lower, checked_broadcast, slim, write_and_read

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
_HEADER = ""


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a to z after lower-casing A-Z, and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _joined(array: Column, size: Column, length: int) -> Column:
    """Every run of ``length`` words, as text."""
    def run(first: Column, at: Column) -> Column:
        return F.concat_ws(" ", first, *[F.get(array, at + F.lit(step)) for step in range(1, length)])

    return F.transform(F.slice(array, 1, F.greatest(size - (length - 1), F.lit(0))), run)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item``, ``window`` (its words joined by blanks) and ``length`` (its number of words), distinct."""
    parts = slim(items, item=id_col, text=text_col).select("item", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    runs = F.when(F.size("words") >= window, _joined(F.col("words"), F.size("words"), window)).otherwise(
        F.array(F.array_join("words", " ")))
    return parts.select("item", F.least(F.size("words"), F.lit(window)).alias("length"), F.explode(runs).alias("window")).distinct()


def _document(id_: Column, text: Column) -> Column:
    """What tells a row from others: its id and its text."""
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.lower(F.hex(F.xxhash64(text))))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items`` (sorted ids as text).

    Null texts have no words and empty texts have none either. Each input row gives a row, judged by its own text: rows that
    repeat an id are told apart by their texts, null ids too. Items that repeat, or are null or without words, change nothing.
    Without items or documents the result has no hits or no rows.
    """
    return _judged(docs, items, id_col, text_col, item_id_col, item_text_col, window).drop("doc")


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, window: int) -> DataFrame:
    """``contamination``, with ``doc``, the row's ``_document``."""
    windows = write_and_read(benchmark_windows(items, item_id_col, item_text_col, window), "windows")
    pieces = F.split("window", " ")
    shingle_length = F.least(F.col("length"), F.lit(SHINGLE))

    # Each window's shingles, with offsets.
    per_window = windows.select("window", "length").distinct()
    parts = per_window.select("window", "length", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("length") - shingle_length), lambda at: F.array_join(F.slice(pieces, at + 1, shingle_length), " ")
    )).alias("offset", "shingle"))
    parts = write_and_read(parts, "window_shingles")
    lengths = [row[0] for row in per_window.select(shingle_length.alias("n")).distinct().collect()]  # at most SHINGLE numbers

    # One pass over the documents.
    vocabulary = parts.select("shingle").union(docs.sparkSession.range(1).select(F.lit(_HEADER).alias("shingle"))).distinct()
    of_doc = slim(docs, id=id_col, text=text_col).select("id", _document(F.col("id"), F.col("text")).alias("doc"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    entries = [F.array(F.struct(F.lit(-1).alias("at"), F.lit(_HEADER).alias("shingle")))] + [
        F.transform(_joined(F.col("words"), F.size("words"), n), lambda text, at: F.struct(at.alias("at"), text.alias("shingle")))
        for n in sorted(lengths)
    ]
    exploded = of_doc.select("id", "doc", F.size("words").alias("n_words"), F.explode(F.concat(*entries)).alias("entry")).select(
        F.when(F.col("entry.at") < 0, F.col("id")).alias("id"), "doc", "n_words", "entry.at", "entry.shingle")
    found = write_and_read(exploded.join(checked_broadcast(vocabulary, "vocabulary"), "shingle"), "found")
    headers = found.filter("at < 0").select("id", "doc", "n_words")
    found = found.filter("at >= 0")

    # The rarest shingle of each window that can occur.
    rarity = found.groupBy("shingle").agg(F.count("*").alias("times"))
    order = Window.partitionBy("window").orderBy("times", "shingle", "offset")
    prefix = (
        parts.join(rarity, "shingle", "left").withColumn("least", F.row_number().over(order))
        .withColumn("missing", F.max(F.col("times").isNull()).over(Window.partitionBy("window")))
        .filter("least = 1 and not missing").select("window", "length", "offset", "shingle")
    )
    places = (
        found.join(prefix, "shingle").withColumn("start", F.col("at") - F.col("offset"))
        .filter("start >= 0 and start + length <= n_words").select("doc", "start", "length", "window").distinct()
    )

    # The shingles that tile a window stand at their places.
    tiles = parts.filter(f"offset % {SHINGLE} = 0 or offset = length - least(length, {SHINGLE})")
    needed = tiles.groupBy("window").agg(F.count("*").alias("needed"))
    wanted = places.join(tiles.select("window", "offset", "shingle"), "window").withColumn("at", F.col("start") + F.col("offset"))
    there = found.select(F.col("doc").alias("there_doc"), F.col("at").alias("there_at"), F.col("shingle").alias("there")).distinct()
    hits = (
        wanted.join(there, (F.col("doc") == F.col("there_doc")) & (F.col("at") == F.col("there_at")) & (F.col("shingle") == F.col("there")))
        .groupBy("doc", "start", "length", "window").agg(F.count("*").alias("standing"))
        .join(needed, "window").filter("standing = needed").select("doc", "start", "length", "window")
    )
    hits = write_and_read(hits, "hits")

    # Words covered: what each occurrence adds to those that start before it.
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("doc", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
        .withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    )
    of_items = (
        hits.select("doc", "window").distinct().join(windows, "window").select("doc", "item").distinct()
        .groupBy("doc").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    )
    return headers.join(covered.join(of_items, "doc", "left"), "doc", "left").select(
        "id", "doc", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in whose text a window of an item occurs."""
    hit = _judged(docs, items, id_col, text_col, "item_id", "text", WINDOW).filter("n_hit > 0").select(F.col("doc").alias("__hit")).distinct()
    return docs.join(hit, _document(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")) == F.col("__hit"), "left_anti")
