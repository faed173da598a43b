"""Operator 8, repeated strings: suffix arrays and longest-previous-factor arrays, dealt out by anchors.

A string of ``width`` bytes repeats if it starts at two places at least.  Each window of so many bytes has an anchor, the first of
its ``gram``-byte strings with the smallest hash, so equal windows have equal anchors.  Windows of one text that follow each other
with one anchor are a stretch.  Stretches whose anchor's hash occurs once are done; those of equal anchor and equal bytes repeat as
a whole.  For the others one stretch of each kind is sent, by anchor, to a task that sorts its windows' suffixes: previous and next
smaller positions in suffix order give each window's longest previous factor, that is the longest match with an earlier place, and
with positions mirrored the longest match with a later one.  Anchors with very many different stretches (``MANY``) are not gathered:
their windows are counted by hash in a distributed aggregation.

Equal bytes of stretches are told by two 64-bit hashes, of the anchor and of the bytes.

``spans`` gives kinds of windows: ANY, those that also start elsewhere, and LATER, those that have started before, so that the first
copy stays.  First is by id, text hash and place.  If shorter passages are asked for, it also gives PASSAGE_ANCHOR: anchors of windows of
``passage`` bytes that occur elsewhere as anchors too.  They have ``gram`` bytes, and every repeated passage holds one at least.

Defined cases: a null text is empty.  Texts below ``width`` bytes have no windows.  Rows equal in id and text repeat each other; in
LATER they count as one text.  Null ids come first.  Matches never cross texts; texts count whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, Powers, cut, extended, mix, pieces, written

#: Bytes of the strings that op8 removes and of anchors, and of passages, which fifty-one words hardly ever fall short of.
WIDTH, GRAM, PASSAGE = 400, 128, 230
#: Kinds of windows: those that also start elsewhere, those that have started before, and repeated anchors of passages.
ANY, LATER, PASSAGE_ANCHOR = 0, 1, 2
#: Different stretches of an anchor up to which they are sorted in one task.
MANY = 1000
#: Windows sorted at a time, about.
BATCH = 16_384
#: Words of 64 bits in a bitmap of keys, which is broadcast (some 8 MB, whatever the data).
WORDS = 1 << 18
_PLACE = 24
_STEP = 1 << 22


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the rows of a matrix of bytes: rows sorted, equal ones as they come; bytes that each shares with the row before."""
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 4096):
        a, b = windows[order[i - 1 : i + 4095]], windows[order[i : i + 4096]]
        differ = a[: len(b)] != b
        lcp[i : i + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), windows.shape[1])
    return order, lcp


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each row, in text order, the longest prefix that it shares with an earlier row.

    In suffix order the best earlier row is the previous or the next one with a smaller position; the shared prefix is the least
    lcp on the way there.  All rows step outwards together, each over rows that have already found their own smaller neighbour.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    for at, shared in ((order, lcp), (order[::-1], np.append(lcp[1:], 0)[::-1])):
        step = np.arange(n) - 1  # candidate for the previous smaller position
        least = shared.copy()  # least lcp between a row and its candidate
        on = np.flatnonzero((step >= 0) & (at[np.maximum(step, 0)] > at))
        while len(on):
            # a candidate that is larger is passed by way of its own candidate, final or not: what lies between is larger still
            via = step[on]
            least[on] = np.minimum(least[on], least[via])
            step[on] = step[via]
            on = on[(step[on] >= 0) & (at[np.maximum(step[on], 0)] > at[on])]
        out[at] = np.maximum(out[at], np.where(step >= 0, least, 0))
    return out


def longest_next_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each row the longest prefix that it shares with a later row: the previous factor with positions mirrored."""
    return longest_previous_factor(len(order) - 1 - order, lcp)[::-1]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _hashes(data: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """(hash of each gram, running sums, inverse powers), of which hashes of longer strings are made too."""
    sums = np.zeros(len(data) + 1, np.uint64)
    up, down = Powers.of(len(data) + 1)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
        n = max(0, len(data) - gram + 1)
        return mix((sums[gram : gram + n] - sums[:n]) * down[:n]), sums, down


def _anchored(hashes: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, last window, anchor) of runs of whole windows of one text and one anchor, as places in the data."""
    for start in range(0, max(0, len(hashes) - width + gram), _STEP):
        n = min(_STEP, len(hashes) - width + gram - start)
        some = hashes[start : start + n + width - gram]
        packed = (some & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(some), dtype=np.uint64)
        anchor = start + (_sliding_least(packed, width - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.arange(start, start + n)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, start, start + n)))
        whole = first + width <= offsets[text + 1]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], n) - 1
        lo, hi = lo[whole[lo]], hi[whole[lo]]
        if len(lo):
            yield text[lo], lo + start, hi + start, anchor[lo]


def stretches(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, hash of the anchor, hash of the bytes) of the stretches of texts; windows as places in their text."""
    hashes, sums, down = _hashes(data, gram)
    found: list[tuple[np.ndarray, ...]] = []
    with np.errstate(over="ignore"):
        for t, a, b, p in _anchored(hashes, offsets, width, gram):
            content = mix((sums[b + width] - sums[a]) * down[a] + mix(((b - a) * 1024 + (p - a)).astype(np.uint64)))
            found.append((t, a - offsets[t], b - offsets[t], hashes[p], content))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(data: np.ndarray, offsets: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place in it, hash) of the anchors of all windows of ``passage`` bytes, each anchor once."""
    hashes, _, _ = _hashes(data, gram)
    found = [(t, p) for t, _, _, p in _anchored(hashes, offsets, passage, gram)]
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    text, place = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.append(True, place[1:] != place[:-1])
    text, place = text[new], place[new]
    return text, place - offsets[text], hashes[place]


def _rows(docs: DataFrame, width: int, gram: int, passage: int | None) -> DataFrame:
    """(id, th, lo, hi, h, c): the stretches of docs (id, th, text); with ``passage`` also its anchors, as rows without c."""

    def run(batches):
        names = ["id", "th", "lo", "hi", "h", "c"]
        for batch in batches:
            ids, th = batch.column("id"), batch.column("th")
            for i, data, offsets in pieces(batch.column("text")):
                text, lo, hi, h, c = stretches(data, offsets, width, gram)
                at = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([ids.take(at), th.take(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names)
                if passage is not None:
                    text, place, h = anchors(data, offsets, passage, gram)
                    at, place = pa.array(text + i), pa.array(place.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ids.take(at), th.take(at), place, place, pa.array(h.view(np.int64)), pa.nulls(len(text), pa.int64())], names)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, th long, lo int, hi int, h long, c long")


def _anchor_counts(docs: DataFrame, width: int, gram: int, passage: int | None) -> DataFrame:
    """(h, n): anchors of docs by hash and how many there are in each task's batches; of windows of ``passage`` bytes, among which are all those of longer windows, if it is given."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in pieces(batch.column("text")):
                h = anchors(data, offsets, passage, gram)[2] if passage is not None else stretches(data, offsets, width, gram)[3]
                h, n = np.unique(h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those of rows whose ``key``, a hash, may be one of wanted's, by a bitmap of bounded size: few others pass while wanted is not too large, and none is lost.

    What passes is joined exactly afterwards; the sieve only spares rows the way through the shuffle.
    """
    place = lambda: F.pmod(F.col(key), F.lit(64 * WORDS))
    word, bit = F.shiftright(place(), 6), (place() % 64).cast("int")
    bits = wanted.groupBy(word.alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(`{key}`, 64) AS INT))")).alias("__bits"))
    met = rows.join(F.broadcast(bits), word == F.col("__word"))
    return met.filter(F.expr(f"shiftright(__bits, CAST(pmod(`{key}`, 64) AS INT)) & 1L") == 1).select(*rows.columns)


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def repeated(table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags ANY and LATER of the rows of a matrix, suffixes in text order: which share ``width`` bytes with another row, and which with an earlier one."""
    order, lcp = suffix_order(table)
    later = longest_previous_factor(order, lcp) >= width
    return later | (longest_next_factor(order, lcp) >= width), later


def _sorted_out(groups: Iterator[list[tuple]], width: int) -> Iterator[list[tuple]]:
    """(h, c, kind, from, to) of the windows of stretches (h, c, bytes), given in text order, that repeat in their group."""
    held: list[tuple] = []
    waiting = 0

    def flush() -> list[tuple]:
        rows, spans = [], []
        for h, c, data in held:
            view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), width)
            key = np.broadcast_to(np.frombuffer(int(h).to_bytes(8, "big", signed=True), np.uint8), (len(view), 8))
            rows.append(np.concatenate([key, view], axis=1))
            spans.append((h, c, len(view)))
        flags = repeated(np.concatenate(rows), width + 8)
        out, at = [], 0
        for h, c, n in spans:
            out += [(h, c, kind, a, b) for kind, again in enumerate(flags) for a, b in _intervals(again[at : at + n])]
            at += n
        return out

    for group in groups:
        held += group
        waiting += sum(len(x[2]) - width + 1 for x in group)
        if waiting >= BATCH:
            yield flush()
            held, waiting = [], 0
    if held:
        yield flush()


def spans(docs: DataFrame, id: str = "doc_id", width: int = WIDTH, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """(id, th, spans): for each text (by id and th, its 64-bit hash) the windows that repeat, as an array of (kind, from, to)."""
    texts = _keyed(docs, id)
    # anchors that occur twice at least, whether or not their stretches are all equal
    # (written, here and below, so that the join shuffles both sides anew and a frequent anchor's rows can be split)
    twice = cut(_anchor_counts(texts, width, gram, passage).filter("n > 1").select("h"))
    every = written(sieved(_rows(texts, width, gram, passage), "h", twice).join(twice, "h"), None)
    met = every.filter("c IS NOT NULL")
    kinds = met.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "lo", "hi")).alias("one"))
    by_anchor = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    kinds = cut(kinds.join(by_anchor, "h"))
    single = kinds.filter("kinds > 1").select("h", "c", "one.*", (F.col("kinds") > MANY).alias("many"))
    sent = _with_text(single, texts, width).select("h", "c", "many", "id", "th", "lo", "data")
    few = _few(sent.filter("NOT many"), width)
    many = _many(sent.filter("many"), width)
    parts = written(few.unionByName(many), None).groupBy("h", "c").agg(F.collect_list(F.struct("kind", "from", "to")).alias("parts"))
    known = cut(kinds.select("h", "c", "n", "one").join(parts, ["h", "c"], "left"))
    each = met.join(known, ["h", "c"])
    # all windows of a stretch that occurs again repeat; of all but the first such stretch they have been there before
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("from"), (F.col("hi") - F.col("lo")).alias("to")))
    none = F.array().cast("array<struct<kind:int,from:int,to:int>>")
    is_one = F.struct("id", "th", "lo", "hi").eqNullSafe(F.col("one"))
    # of the first of equal stretches, and of one that is alone, the sorted windows tell the rest
    own = F.filter(F.coalesce("parts", none), lambda x: F.when(x["kind"] == LATER, is_one).otherwise(F.col("n") == 1))
    found = F.concat(F.when(F.col("n") > 1, whole(ANY)).otherwise(none), F.when(~is_one, whole(LATER)).otherwise(none), own)
    each = each.select("id", "th", F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), (F.col("lo") + x["from"]).alias("from"), (F.col("lo") + x["to"]).alias("to"))).alias("found")).filter(F.size("found") > 0)
    if passage is not None:
        held = every.filter("c IS NULL").select("id", "th", F.array(F.struct(F.lit(PASSAGE_ANCHOR).alias("kind"), F.col("lo").alias("from"), F.col("lo").alias("to"))).alias("found"))
        each = each.unionByName(held)
    return each.groupBy("id", "th").agg(F.flatten(F.collect_list("found")).alias("spans"))


def _keyed(docs: DataFrame, id: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _met(texts: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """texts joined to a table by (id, th); null ids are equal to each other."""
    other = table.withColumnsRenamed({"id": "__id", "th": "__th"})
    on = texts["id"].eqNullSafe(other["__id"]) & (texts["th"] == other["__th"])
    return texts.join(other, on, how).drop("__id", "__th")


def _with_text(single: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Stretches with their bytes, as column data."""
    wanted = cut(single.groupBy("id", "th").agg(F.collect_list(F.struct("h", "c", "many", "lo", "hi")).alias("want")))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            rows = []
            for k, (text, want) in enumerate(zip(batch.column("text"), batch.column("want").to_pylist(), strict=True)):
                data = text.as_py().encode()
                for x in want:
                    rows.append(k)
                    for c, v in zip(out, (x["h"], x["c"], x["many"], x["lo"], data[x["lo"] : x["hi"] + width]), strict=True):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            made = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), *made], ["id", "th", "h", "c", "many", "lo", "data"])

    # equal rows give their stretch once
    met = _met(sieved(texts, "th", wanted), wanted, "inner").select("id", "th", "text", "want")
    kind = texts.schema["id"].dataType.simpleString()
    return met.mapInArrow(run, f"id {kind}, th long, h long, c long, many boolean, lo int, data binary")


_PARTS = "h long, c long, kind int, `from` int, `to` int"


def _few(sent: DataFrame, width: int) -> DataFrame:
    """(h, c, kind, from, to) of windows that repeat among the stretches of their anchor, by suffix arrays."""

    def run(batches):
        def groups():
            at, group, last = None, [], None
            for batch in batches:
                for h, c, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if h != at and group:
                        yield group
                        group = []
                    if (h, c) != last or h != at:
                        group.append((h, c, data))
                    at, last = h, (h, c)
            if group:
                yield group

        for out in _sorted_out(groups(), width):
            a = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(a, kinds, strict=True)], ["h", "c", "kind", "from", "to"])

    ordered = sent.repartition("h").sortWithinPartitions("h", "id", "th", "lo", "c")
    return ordered.select("h", "c", "data").mapInArrow(run, _PARTS)


def _many(sent: DataFrame, width: int) -> DataFrame:
    """The same for anchors of very many stretches: their windows are counted by hash, wherever they are."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("data")[i].as_py(), np.uint8)
                up, down = Powers.of(len(data) + 1)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)])])
                    at = np.arange(len(data) - width + 1)
                    w = mix((sums[at + width] - sums[at]) * down[at])
                row = pa.array(np.full(len(at), i))
                lo = batch.column("lo")[i].as_py()
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in ("h", "c", "id", "th")), pa.array((at + lo).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(w.view(np.int64))], ["h", "c", "id", "th", "place", "at", "w"])

    type_ = sent.schema["id"].dataType.simpleString()
    each = sent.dropDuplicates(["h", "c"]).mapInArrow(run, f"h long, c long, id {type_}, th long, place int, at int, w long")
    place = F.struct("id", "th", "place")
    seen = each.groupBy("h", "w").agg(F.count("*").alias("n"), F.min(place).alias("one")).filter("n > 1")
    again = each.join(seen, ["h", "w"])
    # windows that follow each other are one row again
    runs = again.withColumn("later", ~place.eqNullSafe(F.col("one"))).groupBy("h", "c").agg(F.collect_list("at").alias(str(ANY)), F.collect_list(F.when(F.col("later"), F.col("at"))).alias(str(LATER)))
    return runs.select("h", "c", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.array_sort(str(k)).alias("ats")) for k in (ANY, LATER))))).select("h", "c", "kind", F.explode("ats").alias("from")).withColumn("to", F.col("from"))


def _columns(spans: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """(kind, from, to) of each row of a column of spans."""
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    flat, sizes = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
    return [tuple(f[e - n : e] for f in fields) for n, e in zip(sizes, ends, strict=True)]


def cover(found: tuple[np.ndarray, ...], width: int, kind: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes [start, end) that windows of a kind cover; found: arrays of kind, from and to."""
    kinds, first, last = found
    out: list[list[int]] = []
    some = np.flatnonzero(kinds == kind)
    for k in some[np.argsort(first[some], kind="stable")].tolist():
        a, b = int(first[k]), int(last[k]) + width
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what is left of every document without the bytes of strings of WIDTH bytes that also start elsewhere.

    Beside the contract's columns: n_later, bytes in such strings that have started before; n_shared, bytes in anchors of GRAM bytes
    that stand elsewhere too, of which each passage of PASSAGE bytes that repeats holds one at least; and longest_shared, the longest run of those.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_later", "n_shared", "longest_shared"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    size = lambda runs: sum(b - a for a, b in runs)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for text, found in zip(batch.column("text"), _columns(batch.column("spans")), strict=True):
                data = text.as_py().encode()
                gone = cover(found, WIDTH, ANY)
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                shared = cover(found, GRAM, PASSAGE_ANCHOR)
                for c, v in zip(out, (len(data), size(gone), len(gone), kept.hexdigest(), size(cover(found, WIDTH, LATER)), size(shared), max((b - a for a, b in shared), default=0)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    met = _met(_keyed(docs, "doc_id"), written(spans(docs, passage=PASSAGE), None).hint("merge"), "left").select("id", "text", "spans")
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_later long, n_shared long, longest_shared long")


def without_repeats(docs: DataFrame, id: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs whose text lacks the later copies of repeated strings of ``width`` bytes; the first copy stays.

    Bytes of a character are removed or kept together: one that a span covers in part is kept.
    """

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("__text"), _columns(batch.column("__spans")), strict=True):
                data, kept, at = text.as_py().encode(), [], 0
                for a, b in cover(found, width, LATER):
                    while a < len(data) and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(data[at:a])
                    at = max(a, b)
                out.append(b"".join([*kept, data[at:]]).decode() if kept else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], ["__row", "__left"])

    found = cut(spans(docs, id, width, gram)).withColumnsRenamed({"id": "__id", "th": "__th", "spans": "__spans"})
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(docs["text"], F.lit(""))
    # the other columns go along as one, so that no name among them meets a name used here
    shown = docs.select(F.struct(*(docs[c] for c in others)).alias("__row"), text.alias("__text"), docs[id].alias("__own"), F.xxhash64(text).alias("__hash"))
    met = shown.join(found, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left").select("__row", "__text", "__spans")
    left = met.mapInArrow(run, extended(shown.select("__row").schema, "__left string"))
    return left.select(*(F.col("__left").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))
