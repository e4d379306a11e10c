"""Groups of documents whose sets of word shingles are alike, by an inverted join over MinHash signature coordinates.

1. Tasks turn each text into its set of distinct shingles, a key of the whole set, and a signature of ``COORDINATES`` minima.
   Documents with equal sets are one class from here on, stood for by its smallest id.
2. Each class is posted under all its (coordinate, value) pairs. Postings nobody shares are counted and skipped: a class with
   fewer than ``MATCHES`` shared coordinates can't reach the match threshold. The rest are ordered by rarity over the whole
   table, and only the prefix is joined in which two signatures with ``MATCHES`` equal coordinates must collide.
3. Within each posting list every class is first compared with one centre, the class whose coordinates are most common. The
   links confirmed so far form components. Only classes that still lie in different components are paired, so a list of many
   alike documents never becomes all its pairs. They must also share one of their rarest shingles (the prefix of the full
   sets), and bounds that no link can break come before a pair is made: the sizes of the sets, how many shingles of each set
   any other candidate has at all, and how many follow the shared one.
4. Pairs whose signatures agree in at least ``MATCHES`` coordinates are confirmed on the full sets.

A pair at the similarity of 0.8 agrees in 38.4 of 48 coordinates on average and in fewer than 22 with a chance below one in
a million; the documents of a group would have to miss each other on every path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lakeprofile.llm.common import byte_views, checked_broadcast, connected, mix, running, slim, spans_hash, write_and_read

COORDINATES = 48
MATCHES = 22
WIDTH = 5
PERCENT = 80
_SEED = 0x5EED
_BLOCK = 2048


def shingles(data: np.ndarray, width: int) -> np.ndarray:
    """The distinct 64-bit values of the runs of ``width`` words in UTF-8 bytes, sorted; of all words, if they are fewer.

    Words are what blanks and the control characters 9 to 13 separate; A-Z count as a-z.
    """
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(gap))
    if not len(edges):
        return np.empty(0, np.uint64)
    words = spans_hash(running(data), edges[::2], edges[1::2])
    width = min(width, len(words))
    runs = words[: len(words) - width + 1].copy()
    for step in range(1, width):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[step: len(words) - width + 1 + step])
    return np.unique(runs)


def _coefficients(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    source = np.random.default_rng(_SEED)
    return source.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1), source.integers(0, 1 << 63, coordinates, np.uint64)


def signature(values: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least value of ``coordinates`` rearrangements of the set, their upper 32 bits each."""
    factor, shift = _coefficients(coordinates)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), _BLOCK):
        block = values[at: at + _BLOCK]
        for k in range(coordinates):
            least[k] = min(least[k], (block * factor[k] + shift[k]).min())
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signatures(width: int, coordinates: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            sizes, keys, rows = [], [], []
            for data in byte_views(batch.column(1)):
                values = shingles(data, width) if data is not None else np.empty(0, np.uint64)
                sizes.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                rows.append(signature(values, coordinates) if len(values) else np.zeros(coordinates, np.int32))
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * coordinates, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists],
                ["id", "n", "key", "signature"])

    return run


def _sets(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [shingles(data, width).view(np.int64) for data in byte_views(part.column(1))]
                ends = np.cumsum([0, *map(len, rows)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], ["rep", "shingles"])

    return run


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
                          coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_shingles``, ``component`` (smallest id reachable over links) and ``kept`` (id is component).

    Two documents are linked if 100 * shared shingles >= ``percent`` * all shingles of both. Null texts and texts without
    words have empty sets and are linked with nothing. Rows that repeat an id are nodes of one name: links of either hold for
    the id. Rows with a null id get no component (null, kept) and take part in nothing. An empty table gives an empty result.
    """
    of_docs = slim(docs, id=id_col, text=text_col)
    found = write_and_read(of_docs.mapInArrow(
        _signatures(width, coordinates), "id long, n long, key binary, signature array<int>"), "signatures")
    full = found.filter("n > 0 and id is not null")
    classes = full.groupBy("key", "n", "signature").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    classes = write_and_read(classes, "classes")
    reps = classes.select("rep", "n", "signature")

    # Postings that somebody shares.
    postings = reps.select("rep", F.posexplode("signature").alias("coordinate", "value")).select(
        "rep", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value")).alias("post"))
    shared = postings.join(postings.groupBy("post").agg(F.count("*").alias("times")).filter("times > 1"), "post")
    by_rarity = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "post"))).alias("posts")).filter(
        F.size("posts") >= matches)
    # Postings skipped as unshared stand first in the order, so they use up the prefix.
    prefix = F.slice("posts", 1, F.size("posts") - (matches - 1))
    common = F.aggregate("posts", F.lit(0.0), lambda total, post: total + F.log(post["times"].cast("double")))
    lists = write_and_read(by_rarity.select(
        "rep", common.alias("common"), F.transform(prefix, lambda post: post["post"]).alias("prefix")), "lists")

    # Full sets of the classes left, and how much of each set any other of them has.
    sizes = reps.select("rep", "n", "signature")
    candidate = checked_broadcast(lists.select("rep"), "candidates")
    texts = of_docs.join(candidate, F.col("id") == F.col("rep")).select("rep", "text")
    sets = write_and_read(texts.mapInArrow(_sets(width), "rep long, shingles array<long>").dropDuplicates(["rep"]), "sets")
    single = sets.select("rep", F.explode("shingles").alias("shingle"))
    seen_twice = single.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    ordered = single.join(seen_twice, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("ordered"))
    # Two linked sets share one of the first shingles by rarity; those that nobody else has come first of all.
    alone = F.col("n") - F.size("ordered")
    within = F.greatest(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone, F.lit(0)).cast("int")
    able = ordered.join(lists, "rep").join(sizes, "rep").select(
        "rep", "n", "signature", "common", "prefix", F.size("ordered").alias("met"),
        F.transform(F.slice("ordered", 1, within), lambda item: item["shingle"]).alias("rarest"))
    able = write_and_read(able.filter(f"100 * met >= {percent} * n"), "able")

    def possible(a: str, b: str):
        """Whether sets a and b may be linked, from their sizes and what they share with anybody."""
        return F.expr(f"{percent} * greatest({a}.n, {b}.n) <= 100 * least({a}.n, {b}.n) and "
                      f"{100 + percent} * least({a}.met, {b}.met) >= {percent} * ({a}.n + {b}.n)")

    marks = able.select("rep", "n", "met", "signature")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) that are links."""
        near = (
            pairs.join(marks.alias("x"), F.col("a") == F.col("x.rep")).join(marks.alias("y"), F.col("b") == F.col("y.rep"))
            .filter(possible("x", "y"))
            .filter(F.aggregate(F.zip_with("x.signature", "y.signature", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e) >= matches)
            .select("a", "b", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
        )
        near = write_and_read(near, f"{label}_near")
        both = (
            near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
        )
        met_by_both = F.size(F.array_intersect("set_a", "set_b"))
        return write_and_read(
            both.filter(100 * met_by_both >= percent * (F.col("n_a") + F.col("n_b") - met_by_both)).select("a", "b"), label)

    # Each class with the centre of each of its lists.
    posted = able.select("rep", "common", "n", "met", F.explode("prefix").alias("post"))
    centre = posted.groupBy("post").agg(F.max(F.struct("common", (-F.col("rep")).alias("least"))).alias("top")).select(
        "post", (-F.col("top.least")).alias("centre"))
    to_centre = posted.join(centre, "post").filter("rep != centre").select(
        F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()
    links = confirmed(to_centre, "centre_links")
    component = connected(links)

    # Classes that share one of their rarest shingles and are in different components still. Where the first such shingle
    # stands in both orders bounds what can follow.
    rare = able.select("rep", "n", "met", F.posexplode("rarest").alias("nth", "shingle")).withColumn("left", F.col("met") - F.col("nth"))
    placed = rare.join(component, F.col("rep") == F.col("node"), "left").select(
        "shingle", "rep", "n", "met", "left", F.coalesce("component", "rep").alias("component"))
    open_lists = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle")
    placed = write_and_read(placed.join(open_lists, "shingle"), "placed")
    apart = (
        placed.alias("x").join(placed.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") > F.col("y.rep"))
                               & (F.col("x.component") != F.col("y.component")) & possible("x", "y")
                               & F.expr(f"{100 + percent} * least(x.left, y.left) >= {percent} * (x.n + y.n)"))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )
    more = confirmed(apart, "other_links")
    if not more.isEmpty():
        component = connected(links.union(more))

    copies = classes.filter("rep < last").select(F.col("key").alias("copied"), "rep")
    out = found.join(copies, (F.col("key") == F.col("copied")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep"))
    whole = F.coalesce("component", "rep")
    return out.join(component, F.col("rep") == F.col("node"), "left").select(
        "id", "n_shingles", whole.alias("component"), F.coalesce(whole == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id."""
    gone = near_duplicate_groups(docs, id_col, text_col, width, percent).filter("not kept").select(F.col("id").alias("__gone_id")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone_id"), "left_anti")
