"""Removal of byte strings that an earlier document holds too.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts in a document with a smaller id.

1. A text that stands whole in an earlier document goes whole, and takes no further part: all its strings start there before.
2. Each string of ``LENGTH`` bytes names its own anchor: of the ``SEED``-byte strings in it the one with the least hash. Equal
   strings have equal anchors, and neighbouring strings mostly share theirs, so one anchor in some thirteen bytes stands for
   all. Only anchors that occur in two documents at least are followed. Their rows are shuffled and sorted once and judged as
   they stream by. What a task has seen in two documents is known already: one row of it goes where the anchor is judged, to tell
   the others, and the rest is spread by document, so that an anchor which very many documents hold is no single task's work.
3. Around each such anchor the stretch of bytes is cut out that its strings cover. Equal stretches of a task become one row
   before the shuffle. The stretches of one anchor meet in one place. Their suffix array, built by grouping (see ``suffixes``),
   brings equal strings together; the smallest id among them is where they start first. As every string holds its anchor
   whole, the anchor is one symbol there.
4. Anchors with more than ``HOT`` stretches, however few documents hold them, don't meet in one place: the same shuffle deals
   theirs by their bytes, equal stretches are combined once more, and then the strings themselves are grouped.
5. What is covered is merged per document and cut. Texts are shuffled once, by id; both uses of them share that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.llm.common import byte_views, running, slim, spans_hash, write_and_read
from lakeprofile.llm.suffixes import suffix_array

LENGTH = 50
SEED = 26
HOT = 20_000
_ROWS = 10_000  # stretches made together
_PIECE = 1 << 18  # bytes looked at together; positions fit into 24 bits
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, length: int = LENGTH, seed: int = SEED, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and position of each anchor, and the first and the last of the starts of the strings that name it.

    ``data`` may be several texts in a row; ``ends`` then tells where each of them ends, and no string reaches beyond its text.
    """
    ends = np.array([len(data)]) if ends is None else ends
    found = []
    for base in range(0, max(1, len(data) - length + 1), _PIECE):
        part = data[base: base + _PIECE + length - 1]
        if len(part) < length:
            break
        starts = np.arange(len(part) - seed + 1)
        hashes = spans_hash(running(part), starts, starts + seed)
        # Least (hash, position) of each run of seeds: runs grow by doubling.
        least, width, runs = (hashes & ~_LOW) | starts.astype(np.uint64), 1, length - seed + 1
        while width < runs:
            step = min(width, runs - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        own = (least & _LOW).astype(np.int64)
        whole = np.ones(len(own), bool)  # the string lies in one text
        for end in (ends[np.searchsorted(ends, base, "right"): np.searchsorted(ends, base + len(part))] - base).tolist():
            whole[max(0, end - length + 1): end] = False
        new = np.concatenate([[True], (own[1:] != own[:-1]) | ~whole[:-1]]) & whole
        over = np.concatenate([new[1:] | ~whole[1:], [True]]) & whole
        first, last = np.flatnonzero(new), np.flatnonzero(over)
        at = own[first]
        found.append((hashes[at], at + base, first + base, last + base))
    if not found:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    return tuple(np.concatenate(column) for column in zip(*found))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in a row, and where each ends."""
    return np.concatenate(texts) if texts else np.empty(0, np.uint8), np.cumsum([len(text) for text in texts])


def _slices(batch, column: int, most: int = 1 << 22) -> Iterator:
    """Parts of a batch whose texts hold ``most`` bytes at most, or one text; of 1024 rows at most."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and (held + size > most or row - start == 1024):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if len(sizes):
        yield batch.slice(start)


def _numbers(names: list[str], columns: list[np.ndarray]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names)


def _anchor_rows(length: int, seed: int):
    """Anchors with the documents that hold them, one row per anchor and document of a part of the input.

    ``n`` of the first row of an anchor is twice the number of its occurrences in the part, plus one if two documents hold it;
    of its other rows it is 0.
    """
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in _slices(batch, 1, 1 << 20):  # few rows at once, as tasks that sort follow in the same processes
                data, ends = _joined(byte_views(part.column(1)))
                hashes, at, _, _ = anchors(data, length, seed, ends)
                if not len(hashes):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)[np.searchsorted(ends, at, "right")]
                order = np.lexsort((ids, hashes))
                place, hashes, ids = order, hashes[order], ids[order]
                first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
                other = first | np.concatenate([[True], ids[1:] != ids[:-1]])
                starts = np.flatnonzero(first)
                n = np.zeros(len(hashes), np.int64)
                n[starts] = 2 * np.diff(np.append(starts, len(hashes))) + (np.add.reduceat(other, starts, dtype=np.int64) > 1)
                rows = np.flatnonzero(other)
                rows = rows[np.argsort(place[rows])]  # in the order of the texts: ids that follow each other compress
                yield _numbers(["id", "anchor", "n"], [ids[rows], hashes.view(np.int64)[rows], n[rows]])

    return run


def _followed(hot: int):
    """From rows sorted by anchor those of anchors that two documents hold; with a null id each anchor of more than ``hot`` occurrences."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = ["id", "anchor"]
        carried = None  # the last anchor so far: id, anchor, n, and whether its row is out
        for batch in batches:
            ids, hashes, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            known = n == 0
            if known.any():
                yield _numbers(schema, [ids[known], hashes[known]])
                ids, hashes, n = ids[~known], hashes[~known], n[~known]
            if not len(ids):
                continue
            out = np.zeros(len(ids) + (carried is not None), bool)
            if carried is not None:
                ids, hashes, n = (np.concatenate([[old], new]) for old, new in zip(carried, (ids, hashes, n)))
                out[0] = carried[3]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            times = np.add.reduceat(n >> 1, starts)
            shared = (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)) | (np.bitwise_or.reduceat(n & 1, starts) > 0)
            wanted = np.repeat(shared, np.diff(np.append(starts, len(ids)))) & ~out
            yield _numbers(schema, [ids[wanted], hashes[wanted]])
            common = hashes[starts[shared & (times > hot)]]
            if len(common):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(common), pa.int64()), pa.array(common, pa.int64())], schema)
            carried = int(ids[-1]), int(hashes[-1]), 2 * int(times[-1]) + int(shared[-1]), bool(shared[-1])

    return run


_STRETCH = "lead int, bytes binary, common boolean, members array<long>"


def _stretches(length: int, seed: int):
    """The stretches of a document's followed anchors. ``lead`` is how far the anchor stands behind the first start.

    ``common`` tells the anchors that a fifth column of the input lists.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch.filter(batch.column(3).is_valid()), 2):
                data, ends = _joined(byte_views(part.column(2)))
                hashes, at, first, last = anchors(data, length, seed, ends)
                # An anchor that one document of the part wants is wanted by all that hold it.
                followed = np.flatnonzero(np.isin(hashes.view(np.int64), np.unique(part.column(3).flatten().to_numpy(zero_copy_only=False))))
                common = np.unique(part.column(4).flatten().to_numpy(zero_copy_only=False)) if part.num_columns > 4 else np.empty(0, np.int64)
                ids, versions = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                begins = np.concatenate([[0], ends[:-1]])
                for some in (followed[k: k + _ROWS] for k in range(0, len(followed), _ROWS)):
                    start, sizes = first[some], last[some] - first[some] + length
                    doc = np.searchsorted(ends, start, "right")
                    offsets = np.concatenate([[0], np.cumsum(sizes)])
                    bytes_ = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(hashes[some].view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(versions[doc], pa.int64()),
                        pa.array(start - begins[doc], pa.int64()), pa.array(at[some] - start, pa.int32()),
                        pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bytes_)]),
                        pa.array(np.isin(hashes[some].view(np.int64), common)),
                    ], ["anchor", "id", "version", "first", "lead", "bytes", "common"])

    return run


def _combined(length: int, seed: int):
    """Stretches with equal ones of a batch as one row; its ``members`` are the id, version and first start of each, in a row."""
    stretches = _stretches(length, seed)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in stretches(batches):
            groups = pa.Table.from_batches([batch]).group_by(["lead", "bytes", "common"], use_threads=False)
            for some in groups.aggregate([("id", "list"), ("version", "list"), ("first", "list")]).combine_chunks().to_batches():
                lists = [some.column(f"{name}_list") for name in ("id", "version", "first")]
                offsets = lists[0].offsets.to_numpy()
                members = np.stack([column.flatten().to_numpy() for column in lists], axis=1).ravel()
                members = pa.ListArray.from_arrays(pa.array(3 * (offsets - offsets[0]), pa.int32()), pa.array(members))
                yield pa.RecordBatch.from_arrays(
                    [some.column("lead"), some.column("bytes"), some.column("common"), members], ["lead", "bytes", "common", "members"])

    return run


Stretch = tuple[int, bytes]  # where the anchor stands in it, and its bytes


def _alike(stretches: Iterable[Stretch], length: int, seed: int) -> list[tuple[Stretch, int, int]]:
    """The stretches that may share a string with another one, and between which bytes of them such strings lie.

    A string around the anchor holds half of its other bytes on one side at least, so the anchor with that much on its left,
    or on its right, must occur in two stretches. Where one side does not, the strings hold less than that of it.
    """
    half = (length - seed) // 2
    sides = {}
    for lead, bytes_ in stretches:
        left = bytes_[lead - half: lead + seed] if lead >= half else None
        right = bytes_[lead: lead + seed + half] if len(bytes_) >= lead + seed + half else None
        sides[lead, bytes_] = left, right
    lefts, rights = (Counter(column) for column in zip(*sides.values()))
    lefts[None] = rights[None] = 0
    found = []
    for stretch, (left, right) in sides.items():
        both = lefts[left] > 1, rights[right] > 1
        if any(both):
            lead, bytes_ = stretch
            low = 0 if both[0] else max(0, lead - half + 1)
            high = len(bytes_) if both[1] else min(len(bytes_), lead + seed + half - 1)
            if high - low >= length:
                found.append((stretch, low, high))
    return found


def first_documents(stretches: dict[Stretch, int], length: int = LENGTH, seed: int = SEED) -> dict[Stretch, list[int]]:
    """For each stretch, given with the smallest id that holds it, the smallest id of each of its strings of ``length`` bytes.

    Stretches that may share a string are joined and their suffix array is built, with the anchor, which every string holds
    whole, as one symbol. Suffixes that share a string's symbols stand together in it.
    """
    out = {stretch: [id_] * (len(stretch[1]) - length + 1) for stretch, id_ in stretches.items()}
    alike = _alike(stretches, length, seed) if len(stretches) > 1 else []
    if len(alike) < 2:
        return out
    symbols = length - seed + 1  # of a string
    texts, owned = [], []  # the smallest id of each string so far, by where it starts in the joined text
    for (lead, bytes_), low, high in alike:
        texts.append(f"{bytes_[low:lead].decode('latin-1')}\u0100{bytes_[lead + seed: high].decode('latin-1')}")
        owned += out[lead, bytes_][low: high - length + 1]
        owned += [None] * symbols
    text = "\x00".join(texts) + "\x00"
    class_: list[int] = []
    shared = None

    def settle() -> None:
        if len(class_) > 1:
            least = min(map(owned.__getitem__, class_))
            for i in class_:
                owned[i] = least

    for i in suffix_array(text):
        if owned[i] is not None:  # a whole string starts here
            string = text[i: i + symbols]
            if string == shared:
                class_.append(i)
            else:
                settle()
                class_, shared = [i], string
    settle()
    start = 0
    for stretch, low, high in alike:
        number = high - low - length + 1
        out[stretch][low: low + number] = owned[start: start + number]
        start += number + symbols
    return out


def _covered(length: int, seed: int):
    """What is to go, from the stretches of whole anchors, which follow each other. Those of very common ones are left out."""
    def spans(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 1:
            _, bytes_, members = rows[0]
            earliest = min(members)[0]
            for id_, version, start in members:
                if earliest < id_:
                    yield id_, version, start, start + len(bytes_)
            return
        least: dict[Stretch, int] = {}
        for lead, bytes_, members in rows:
            least[lead, bytes_] = min(min(members)[0], least.get((lead, bytes_), 1 << 63))
        first = first_documents(least, length, seed)
        for lead, bytes_, members in rows:
            owners = first[lead, bytes_]
            lowest, highest = min(owners), max(owners)
            for id_, version, start in members:
                if highest < id_:
                    yield id_, version, start, start + len(bytes_)
                elif lowest < id_:
                    at = 0
                    while at < len(owners):
                        if owners[at] < id_:
                            end = at
                            while end + 1 < len(owners) and owners[end + 1] < id_:
                                end += 1
                            yield id_, version, start + at, start + end + length
                            at = end
                        at += 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        names = ["id", "version", "start", "end"]
        waiting: list[tuple] = []
        out: list[tuple] = []

        def table():
            return _numbers(names, list(zip(*out)) if out else [[]] * 4)

        anchor = None
        for batch in batches:
            if batch.column(2).true_count:
                batch = batch.filter(pc.invert(batch.column(2)))
            ends = batch.column(3).offsets.to_numpy()
            members = list(map(tuple, batch.column(3).flatten().to_numpy().reshape(-1, 3).tolist()))
            ends = ((ends - ends[0]) // 3).tolist()
            for k, (lead, bytes_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if bytes_[lead: lead + seed] != anchor:
                    out += spans(waiting)
                    waiting, anchor = [], bytes_[lead: lead + seed]
                waiting.append((lead, bytes_, members[ends[k]: ends[k + 1]]))
                if len(out) > 10_000:
                    yield table()
                    out = []
        out += spans(waiting)
        yield table()

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Byte spans to remove: ``id``, ``version`` (hash of the text, should an id repeat), ``start``, ``end``; they may overlap.

    ``docs`` has ``id``, ``version`` and ``text``.
    """
    long_enough = docs.filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    texts = long_enough.select("id", "version", F.octet_length("text").cast("long").alias("end"), F.sha2("text", 256).alias("key"))
    earliest = texts.groupBy("key").agg(F.min("id").alias("least"))
    copies = write_and_read(texts.join(earliest, "key").filter("id > least").select("id", "version", "end").distinct(), "copies")
    own = long_enough.join(copies, ["id", "version"], "left_anti")
    held = own.select("id", "text").mapInArrow(_anchor_rows(length, seed), "id long, anchor long, n long")
    judged = held.repartition(F.col("anchor"), F.when(F.col("n") == 0, F.col("id"))).sortWithinPartitions("anchor")
    followed = write_and_read(judged.mapInArrow(_followed(hot), "id long, anchor long"), "followed")
    very_common = write_and_read(followed.filter("id is null").select("anchor").distinct(), "very_common")
    followed = followed.filter("id is not null")

    none = very_common.isEmpty()
    if not none:
        followed = followed.join(very_common.withColumn("common", F.col("anchor")), "anchor", "left")
    common = F.array().cast("array<long>") if none else F.collect_set("common")
    of_doc = followed.groupBy("id").agg(F.collect_set("anchor").alias("anchors"), common.alias("common"))  # bounded by the document
    # A left join leaves the texts as they are: the final cut can share their shuffle.
    stretches = docs.join(of_doc, "id", "left").select("id", "version", "text", "anchors", "common").mapInArrow(_combined(length, seed), _STRETCH)
    anchor = F.substring(F.col("bytes"), F.col("lead") + 1, F.lit(seed))
    dealt = stretches.repartition(anchor, F.when(F.col("common"), F.col("bytes")))
    covered = dealt.sortWithinPartitions(anchor).mapInArrow(_covered(length, seed), "id long, version long, start long, end long")
    covered = covered.union(copies.select("id", "version", F.lit(0).cast("long").alias("start"), "end"))
    if none:
        return covered
    # All readers share one shuffle, as Spark moves no filter before it that isn't deterministic, and this one needs every column.
    common = dealt.filter(F.when(F.spark_partition_id() >= 0, F.col("common") & (F.size("members") > 0))).select("bytes", "members")
    return covered.union(_covered_by_common(common, length))


def _covered_by_common(stretches: DataFrame, length: int) -> DataFrame:
    """The spans of stretches whose anchors are too common to meet: equal stretches as one, then equal strings as one."""
    def members(make) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size("members") / 3).cast("int") - 1), make)

    def member(at: Column, k: int) -> Column:
        return F.get("members", at * 3 + k)

    stretches = stretches.withColumn("key", F.sha2("bytes", 256))
    single = stretches.groupBy("key", "bytes").agg(F.min(F.array_min(members(lambda at: member(at, 0)))).alias("least"))
    strings = single.select("key", "least", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.octet_length("bytes") - (length - 1)), lambda at: F.substring("bytes", at, F.lit(length)))).alias("at", "string"))
    first = strings.groupBy("string").agg(F.min("least").alias("owner"))
    owned = strings.join(first, "string").select("key", "at", "owner")
    each = stretches.select("key", F.inline(members(
        lambda at: F.struct(member(at, 0).alias("id"), member(at, 1).alias("version"), member(at, 2).alias("first")))))
    return each.join(owned, "key").filter("owner < id").select(
        "id", "version", (F.col("first") + F.col("at")).alias("start"), (F.col("first") + F.col("at") + length).alias("end"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])]


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for data, spans in zip(byte_views(batch.column(0)), batch.column(1)):
            data = data if data is not None else np.empty(0, np.uint8)
            gone = np.zeros(len(data) + 1, np.int32)
            runs = 0
            if spans.is_valid:
                starts, ends = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
                starts, ends = merged(starts, ends)
                runs = len(starts)
                gone[starts] += 1
                gone[ends] -= 1
            kept = data[np.cumsum(gone[:-1]) == 0] if runs else data
            rows.append((len(data), len(data) - len(kept), runs, kept.tobytes()))
        yield pa.array([dict(zip(("n_bytes", "n_removed", "n_spans", "kept"), row)) for row in rows],
                       pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def cut(text: Column, spans: Column) -> Column:
    """A struct of ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def run(text, spans):
        import pyarrow as pa

        return next(_cut(iter([pa.RecordBatch.from_arrays([text, spans], ["text", "spans"])])))

    return run(text, spans)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary).

    Null texts are empty; texts shorter than ``length`` lose nothing. Rows that repeat an id never count as earlier than each
    other. Rows without an id lose nothing and are no source. An empty table gives an empty result. What stays is bytes, as a
    cut may fall inside a character.
    """
    rows = slim(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).withColumn("version", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))
    spans = repeated_spans(rows, length, seed, hot).groupBy("id").agg(F.collect_list(F.struct("version", "start", "end")).alias("spans"))
    own = F.transform(F.filter("spans", lambda span: span["version"] == F.col("version")), lambda span: F.struct(span["start"], span["end"]))
    return rows.join(spans, "id", "left").select("id", cut(F.col("text"), own).alias("__cut")).select("id", "__cut.*")
