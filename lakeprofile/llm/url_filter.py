"""Verdicts on URLs, from rules on hosts and paths and from a list of URLs.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's; of several that fit, the longest wins. A URL that no rule fits is blocked if its canonical form is listed.

Rules and listed URLs become keys of one table. A URL's own keys are its canonical form, and its host's end and path's start in
each pair of lengths that some rule has, so their number follows the rules and not the length of the URL. A blocked Bloom
filter of all listed keys passes those that may be listed: each key belongs to one block of 256 bits and sets eight of them.
The filter has a fixed largest size; a longer list makes it pass more, which costs time and no correctness, because a hash join
with the table itself removes what passed by chance. URLs without a passing key never reach a shuffle.

A key that very many URLs have (a rule for all of ``org``) would be one task of that join. Keys are counted first, by partial
aggregates; those with more than one in ``HOT_SHARE`` of all passing keys are at most ``HOT_SHARE`` many, and short ones of them
are joined by broadcast, whose size these two bounds limit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.llm.common import ascii_lower, slim, write_and_read

#: Bits of the filter for each listed key, and the largest filter, in blocks of 32 bytes (16 MiB).
BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 19
WORDS, BITS_SET = 4, 8
#: A key is hot with more than one in so many of the passing keys; only hot keys of up to so many bytes are broadcast.
HOT_SHARE = 1000
HOT_BYTES = 4096
#: Parameters of a query that say where a visitor came from, not what a page is.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the spellings of a page's URL; null for a URL without a host.

    Left out: scheme, ``www.``, the ports 80 and 443, slashes at the end of the path, the fragment, empty and tracking
    parameters. The remaining parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*[?]([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


# ---------------------------------------------------------------------------------------------------------------------
# The filter: built by a DataFrame aggregate per block, read by numpy.

def _bits(key_hash: str) -> str:
    return f"xxhash64({key_hash}, 1L)"


def blocked_bloom(hashes: DataFrame, n_keys: int, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter of the 64-bit values in column ``h``: one row of four words per block.

    Words of equal blocks are or-ed in partial aggregates; at most ``max_blocks`` rows reach the driver.
    """
    blocks = min(max_blocks, 1 << max(0, (n_keys * BITS_PER_KEY - 1) // 256).bit_length())
    words = [
        f"bit_or(shiftleft(1L, cast(shiftrightunsigned(b, {12 * word}) & 63 AS INT))"
        f" | shiftleft(1L, cast(shiftrightunsigned(b, {12 * word + 6}) & 63 AS INT))) AS w{word}" for word in range(WORDS)
    ]
    rows = (
        hashes.selectExpr(f"cast(h & {blocks - 1}L AS INT) AS block", f"{_bits('h')} AS b")
        .groupBy("block").agg(*[F.expr(word) for word in words]).toArrow()
    )
    table = np.zeros((blocks, WORDS), np.int64)
    at = rows.column("block").to_numpy()
    for word in range(WORDS):
        table[at, word] = rows.column(f"w{word}").to_numpy()
    return table.view(np.uint64)


def passing(table: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter: all eight of its bits are set in its block."""
    block = table[(hashes.view(np.uint64) & np.uint64(len(table) - 1)).astype(np.int64)]
    bits, ok = bits.view(np.uint64), np.ones(len(hashes), bool)
    for nth in range(BITS_SET):
        bit = (bits >> np.uint64(6 * nth)) & np.uint64(63)
        ok &= (block[:, nth // 2] >> bit) & np.uint64(1) == 1
    return ok


def _positions_passing(spark, table: np.ndarray) -> Callable[[Column, Column], Column]:
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("array<int>")
    def positions(hashes: pa.Array, bits: pa.Array) -> pa.Array:
        """Per row, the positions of the keys that pass."""
        counts = np.diff(hashes.offsets.to_numpy())
        ok = passing(shared.value, hashes.flatten().to_numpy(), bits.flatten().to_numpy())
        starts = np.repeat(np.cumsum(counts) - counts, counts)
        kept = (np.arange(len(ok)) - starts)[ok].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(kept))

    return positions


# ---------------------------------------------------------------------------------------------------------------------

def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per key: ``key``, ``rule``, ``verdict`` and ``reach``, the rule's length (-1 for a listed URL)."""
    of_rules = rules.select(
        F.concat(F.lit("rule "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        (F.length("host") + F.length("path")).alias("reach"))
    of_urls = listed.select(
        F.concat(F.lit("page "), "canonical").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"),
        F.lit(-1).alias("reach"))
    return of_rules.union(of_urls).groupBy("key").agg(
        F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("reach").alias("reach"))


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 max_blocks: int = MAX_BLOCKS, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per row of ``pages``: ``id``, ``url``, ``host``, ``path``, ``rule`` (host and path of the rule that fits, or null),
    ``verdict`` (``allow`` or ``block``).

    ``rules`` has ``host``, ``path`` and ``verdict``; of two that differ in the verdict only, ``block`` counts; of two equally
    long ones that fit, the one with the longer host. Rules with a null or an empty host count for nothing. ``listed`` has
    ``url``; what has no host counts for nothing. A null URL or one without ``://`` has an empty host and path and is allowed.
    Rows that repeat an id or a URL each get their row, null ids too. No rules, no list or no pages: nothing is blocked, or no
    rows. Further columns are left out: join them back by ``url``, or see ``drop_blocked``.
    """
    spark = pages.sparkSession
    rules = slim(rules, host="host", path="path", verdict="verdict").select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host != '' AND verdict IS NOT NULL")
    listed = slim(listed, url="url").select(canonical(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL")
    entries = write_and_read(_entries(rules, listed), "url_entries")
    shapes = sorted(tuple(row) for row in rules.select(F.length("host"), F.length("path")).distinct().collect())
    table = blocked_bloom(entries.select(F.xxhash64("key").alias("h")), entries.count(), max_blocks)

    host, path = F.col("host"), F.col("path")
    keys = [
        F.when((F.length(host) >= hl) & (F.length(path) >= pl) & ((F.length(host) == hl) | (F.substring(host, -(hl + 1), 1) == ".")),
               F.concat(F.lit("rule "), F.right(host, F.lit(hl)), F.left(path, F.lit(pl))))
        for hl, pl in shapes
    ]
    positions = _positions_passing(spark, table)
    urls = (
        slim(pages, id=id_col, url=url_col)
        .select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
        .select("id", "url", "host", "path", F.array_compact(F.array(F.concat(F.lit("page "), "canonical"), *keys)).alias("keys"))
        .select("*", F.transform("keys", lambda key: F.xxhash64(key)).alias("hashes"))
        .select("id", "url", "host", "path", "keys",
                positions(F.col("hashes"), F.transform("hashes", lambda h: F.xxhash64(h, F.lit(1).cast("long")))).alias("at"))
        .select("id", "url", "host", "path", F.transform("at", lambda i: F.get("keys", i)).alias("keys"))
    )
    # Rows get a number of their own that stays as written, so that equal rows stay apart below.
    urls = write_and_read(urls.withColumn("row", F.monotonically_increasing_id()), "url_keys")
    clear = urls.filter(F.size("keys") == 0).select("id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))

    possible = urls.filter(F.size("keys") > 0).select("row", "id", "url", "host", "path", F.explode("keys").alias("key"))
    seen = possible.groupBy("key").agg(F.count("*").alias("times"))
    known = write_and_read(seen.join(entries, "key", "left"), "url_known")
    limit = max(1, (known.agg(F.sum("times")).first()[0] or 0) // hot_share)
    is_hot = (F.col("times") > limit) & (F.octet_length("key") <= HOT_BYTES)
    hot, rest = known.filter(is_hot).drop("times"), known.filter(~is_hot).drop("times")
    judged = (
        possible.join(F.broadcast(hot), "key")
        .unionByName(possible.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key"))
    )
    best = F.max(F.struct("reach", F.length(F.substring_index("rule", "/", 1)).alias("host_length"), "rule", "verdict"))
    found = judged.groupBy("row").agg(
        *[F.any_value(name).alias(name) for name in ("id", "url", "host", "path")],
        best.alias("best"))
    found = found.select("id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return found.unionByName(clear)


def drop_blocked(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` without the rows whose URL is blocked; all columns stay. Rows with a null URL stay."""
    blocked = (
        url_verdicts(pages, rules, listed, url_col, url_col).filter("verdict = 'block'")
        .select(F.col("url").alias("__blocked_url")).distinct()
    )
    return pages.join(blocked, F.col(f"`{url_col}`") == F.col("__blocked_url"), "left_anti")
