"""Operator 5: removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` (400) bytes that starts
anywhere else too. All positions of a corpus are too many to sort, so the sort
runs over anchors that any two equal strings must share:

1. *Anchors.* In each text the 32-byte strings are hashed; a string's anchor is
   the last of the least hashes in it. Equal strings have equal anchors at the
   same offset, so each string is compared at its own anchor only. An anchor's
   context is what its strings cover: all strings that start between ``before``
   bytes and ``before + length - len(context)`` bytes ahead of it.
2. Contexts with equal hashes (a polynomial and an independent one, 128 bits)
   repeat as a whole: all of them are removed, and one of them stands for all.
3. *Suffix sort.* Contexts that share an anchor but differ are sorted by the
   bytes from the anchor on, and by the bytes before it read backwards. The
   sort is a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes, O(log length) each;
   neighbours that come out equal are compared byte by byte, so a hash
   collision is found (and raises) instead of passing.
4. From the sorted orders, contexts that share d bytes before the anchor and
   ``length - d`` from it on are classes of equal strings; a class of two or
   more marks its bytes.

An anchor with more than ``MOST`` different contexts (a passage in very many
surroundings) would make one task sort them all. Its contexts are cut into
pieces of ``STEP`` strings instead, counted by hash with partial sums: a piece
that repeats goes as a whole, and of pieces that differ but share the bytes
common to all their strings, each string is counted by hash. Nothing of a hot
anchor is gathered in one task.

Anchors travel as hashes; bytes only for contexts that share their anchor with a
different one, one for each distinct context. A text is never held against all others.

Edge cases: null text is the empty text; texts under ``length`` bytes lose
nothing; overlaps and repeats within one text count; texts of any length are read
in segments of ``SEGMENT`` bytes; each row is a text of its own even if ids repeat; a
null id is kept as such; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm.common import exact, hot_keys, materialize, prefix_hashes, span_hashes, spread_join, table

LENGTH = 400
GRAM = 32
#: Bytes of text read at once, and the bits that hold a place among them.
SEGMENT, PLACE = 1 << 19, np.uint64((1 << 20) - 1)
#: Contexts that one sort may hold; anchors with more are cut into pieces of STEP strings.
MOST, STEP = 2000, 48
#: Neighbours checked byte by byte, and rows given back, at once.
AT_ONCE = 1024


def data_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i, from running values of blocks."""
    block = np.full(-(-(len(x) + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    block[: len(x)] = x
    block = block.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of texts that lie back to back in ``data``, ends at ``ends``:
    hash, place, and the first and last start of the strings of each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> None:
        width = length - GRAM + 1
        self.prefix = prefix_hashes(data)
        at = np.arange(max(0, len(data) - GRAM + 1))
        h = span_hashes(self.prefix, at, at + GRAM)
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        starts = np.zeros(0, np.int64)
        if len(data) >= length:
            # the last of equal hashes: places count downwards in the low bits
            least = _sliding_min((h & ~PLACE) | (PLACE - at.astype(np.uint64)), width)
            starts = np.flatnonzero(owner[: len(data) - length + 1] == owner[length - 1 :])
        place = (PLACE - (least[starts] & PLACE)).astype(np.int64) if len(starts) else starts
        new = np.flatnonzero(np.diff(place, prepend=-1))
        self.place, self.first = place[new], starts[new]
        self.last = starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts
        self.hash = h[self.place]
        self.owner = owner[self.place]
        with np.errstate(over="ignore"):
            context = span_hashes(self.prefix, self.first, self.last + length) + (self.place - self.first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        raw = memoryview(data)
        self.context = context
        self.check = np.array([xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(self.first.tolist(), (self.last + length).tolist())], np.uint64)


def segments(rows: list[tuple], length: int = LENGTH) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """(row, size, bytes) in groups of about SEGMENT bytes: (row, size, offset in
    the text) of each piece, their bytes back to back, and the ends of pieces.
    Pieces of one text share ``length - 1`` bytes, so no string is cut or met twice."""
    held: list[tuple] = []
    parts: list[np.ndarray] = []
    n = 0
    for row, size, data in rows:
        for s in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[s : s + SEGMENT + length - 1]
            if n and n + len(part) > SEGMENT:
                yield held, np.concatenate(parts), np.cumsum([len(x) for x in parts])
                held, parts, n = [], [], 0
            held.append((row, size, s))
            parts.append(part)
            n += len(part)
    if held:
        yield held, np.concatenate(parts), np.cumsum([len(x) for x in parts])


FOUND = pa.schema(
    [("row", pa.int64()), ("size", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("check", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("places", pa.list_(pa.int32()))]
)


def anchor_rows(rows: list[tuple], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The distinct anchors and contexts of each text, with their places."""
    for held, data, ends in segments(rows, length):
        a = Anchors(data, ends, length)
        if not len(a.place):
            continue
        order = np.lexsort((a.place, a.check, a.context, a.hash, a.owner))
        owner, h, context, check = a.owner[order], a.hash[order], a.context[order], a.check[order]
        new = np.append(True, (np.diff(owner) != 0) | (np.diff(h) != 0) | (np.diff(context) != 0) | (np.diff(check) != 0))
        at = np.flatnonzero(new)
        # places in the text: less the start of the piece here, and from its start there
        shift = np.array([s for _, _, s in held]) - np.append(0, ends[:-1])
        places = (a.place[order] + shift[owner]).astype(np.int32)
        own = owner[at]
        columns = [
            np.array([r for r, _, _ in held], np.int64)[own], np.array([z for _, z, _ in held], np.int64)[own],
            h[at].view(np.int64), context[at].view(np.int64), check[at].view(np.int64),
            (a.place - a.first)[order][at].astype(np.int32), (a.last + length - a.place)[order][at].astype(np.int32),
        ]
        listed = pa.ListArray.from_arrays(pa.array(np.append(at, len(places)), pa.int32()), pa.array(places))
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), listed], schema=FOUND)


# ------------------------------------------------------------ suffix sort
class Suffixes:
    """Byte strings to be sorted within groups, compared by hashes."""

    def __init__(self, group: np.ndarray, strings: list[np.ndarray]) -> None:
        self.group = group
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.concatenate([*strings, np.zeros(1, np.uint8)])
        self.prefix = prefix_hashes(self.data)
        self.order = self._mergesort()
        self.shared = self._shared()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes of suffixes i and j, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.start[i], self.start[j]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) // 2
            same = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix i comes before suffix j (or is equal to it)."""
        out = self.group[i] < self.group[j]
        tie = np.flatnonzero(self.group[i] == self.group[j])
        if len(tie):
            x, y = i[tie], j[tie]
            m = self.extension(x, y)
            end_x, end_y = m == self.size[x], m == self.size[y]
            byte = self.data[self.start[x] + m] < self.data[self.start[y] + m]
            out[tie] = np.where(end_x, ~end_y | or_equal, ~end_y & byte)
        return out

    def _mergesort(self) -> np.ndarray:
        """Bottom-up: all pairs of runs of one width are merged at once, each
        element finding its place in the other run by binary search."""
        n = len(self.size)
        order, width = np.arange(n), 1
        while width < n:
            at = np.arange(n)
            run = at // width
            other = run ^ 1
            first = other * width
            stop = np.minimum(first + width, n)
            lo, hi = np.minimum(first, n), np.maximum(stop, np.minimum(first, n))
            base = lo.copy()
            left = run % 2 == 0
            while (lo < hi).any():
                mid = (lo + hi) // 2
                act = np.flatnonzero(lo < hi)
                probe, own = order[mid[act]], order[at[act]]
                # elements of the left run go before equal ones of the right
                go = np.where(left[act], self.less(probe, own, False), self.less(probe, own, True))
                lo[act] = np.where(go, mid[act] + 1, lo[act])
                hi[act] = np.where(go, hi[act], mid[act])
            place = np.minimum(run, other) * width + (at - run * width) + (lo - base)
            new = np.empty_like(order)
            new[place] = order
            order, width = new, 2 * width
        return order

    def _shared(self) -> np.ndarray:
        """Common bytes of neighbours in the order, checked byte by byte."""
        a, b = self.order[:-1], self.order[1:]
        m = np.where(self.group[a] == self.group[b], self.extension(a, b), 0)
        reach = int(m.max(initial=0))
        for s in range(0, len(a), AT_ONCE):
            x, y, k = self.start[a[s : s + AT_ONCE]].astype(np.int32), self.start[b[s : s + AT_ONCE]].astype(np.int32), m[s : s + AT_ONCE, None].astype(np.int32)
            steps = np.minimum(np.arange(reach, dtype=np.int32)[None, :], np.maximum(k - 1, 0))
            if ((self.data[x[:, None] + steps] != self.data[y[:, None] + steps]) & (k > 0)).any():
                raise RuntimeError("two different strings have one hash")
        return m

    def classes(self, depth: int) -> np.ndarray:
        """A number for each string, equal for those that share ``depth``
        bytes; strings with fewer bytes have numbers of their own."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum((self.shared < depth) | (self.group[self.order[:-1]] != self.group[self.order[1:]]))])
        return out


def repeated_offsets(group: np.ndarray, contexts: list[bytes], before: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context, for each d: whether its string of ``length`` bytes
    that starts d before the anchor is another one's of the group too."""
    data = [np.frombuffer(c, np.uint8) for c in contexts]
    right = Suffixes(group, [x[b:] for x, b in zip(data, before.tolist())])
    left = Suffixes(group, [x[:b][::-1] for x, b in zip(data, before.tolist())])
    n = len(data)
    out = np.zeros((n, length - GRAM + 1), bool)
    for d in range(length - GRAM + 1):
        have = np.flatnonzero((left.size >= d) & (right.size >= length - d))
        if len(have) > 1:
            _, which, count = np.unique((left.classes(d) * n + right.classes(length - d))[have], return_inverse=True, return_counts=True)
            out[have, d] = count[which] > 1
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


# --------------------------------------------------------------- the jobs
SPANS = "row long, size long, spans array<struct<lo:int,hi:int>>"


def removed_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", most: int = MOST) -> DataFrame:
    """(row, size, spans) of every text that loses bytes; ``row`` is the hash
    of the row (see ``numbered``), spans are (lo, hi) and may overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("row").to_pylist(), b.column("size").to_pylist(), b.column(text))
            yield from anchor_rows(((r, z, np.frombuffer(t.as_buffer(), np.uint8)) for r, z, t in rows), length)

    kind = "row long, size long, anchor long, context long, check long, before int, after int, places array<int>"
    long = docs.where(F.col("size") >= length).select("row", "size", text)
    found = materialize(long.mapInArrow(find, kind), "anchors")
    same = ["anchor", "context", "check"]
    contexts = found.groupBy(same).agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("row", "size", F.col("places")[0].alias("place"), "before", "after")).alias("one"))
    shared = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    shared = materialize(shared, "shared")
    # an anchor with very many contexts, and a context in very many texts, are dealt over several tasks
    crowded = hot_keys(shared.select("anchor", F.col("kinds").alias("_c")), ["anchor"], shared.agg(F.sum("kinds")).first()[0] or 0)
    contexts = materialize(spread_join(contexts, shared.select("anchor", "kinds"), ["anchor"], crowded, ["context", "check"]).select(*same, "n", "one", "kinds"), "contexts")

    # contexts that repeat as a whole
    copied = hot_keys(contexts.select(*same, F.col("n").alias("_c")), same, contexts.agg(F.sum("n")).first()[0] or 0)
    whole = spread_join(found, contexts.where("n > 1").select(same), same, copied, ["row", "size"]).select(
        "row", "size", F.transform("places", lambda p: F.struct((p - F.col("before")).alias("lo"), (p + F.col("after")).alias("hi"))).alias("spans")
    )

    # contexts that differ: bytes of one text for each
    one = F.col("one")
    wanted = contexts.where("kinds > 1").select(
        one.row.alias("row"), one.size.alias("size"), F.struct(*same, "n", (F.col("kinds") > most).alias("hot"), one.place.alias("place"), one.before.alias("before"), one.after.alias("after")).alias("w")
    )
    wanted = wanted.groupBy("row", "size").agg(F.collect_list("w").alias("wanted"))  # at most the anchors of one text
    slots = ["anchor", "context", "check", "n", "hot", "place", "before"]
    kind = "anchor long, context long, check long, n long, hot boolean, place int, before int, row long, size long, bytes binary"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, z, t, want in zip(b["row"], b["size"], b[text], b["wanted"]):
                raw = t.encode()
                for w in want:
                    rows.append((*[w[c] for c in slots], r, z, raw[w["place"] - w["before"] : w["place"] + w["after"]]))
                    if len(rows) == AT_ONCE:
                        yield pd.DataFrame(rows, columns=[*slots, "row", "size", "bytes"])
                        rows = []
            yield pd.DataFrame(rows, columns=[*slots, "row", "size", "bytes"])

    # repeated rows of one id and text give the same bytes
    held = long.join(wanted, ["row", "size"]).mapInPandas(fetch, kind)
    held = materialize(held, "bytes")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flags(part: pd.DataFrame) -> pd.DataFrame:
            part = part.drop_duplicates(same)
            hit = repeated_offsets(part["anchor"].rank(method="dense").to_numpy(np.int64), part["bytes"].tolist(), part["before"].to_numpy(np.int64), length)
            rows = []
            for r, z, p, n, own in zip(part["row"], part["size"], part["place"], part["n"], hit):
                if n == 1 and own.any():
                    rows.append((r, z, [{"lo": p - last, "hi": p - first + length} for first, last in runs(own)]))
            return pd.DataFrame(rows, columns=["row", "size", "spans"])

        held = None
        for batch in batches:
            for s in range(0, len(batch), AT_ONCE):
                b = batch.iloc[s : s + AT_ONCE]
                held = b if held is None else pd.concat([held, b], ignore_index=True)
                if len(held) >= AT_ONCE:
                    last = held["anchor"] == held["anchor"].iloc[-1]
                    if not last.all():
                        yield flags(held[~last])
                        held = held[last]
        if held is not None and len(held):
            yield flags(held)

    cold = held.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(compare, SPANS)
    spans = whole.union(cold).union(hot_spans(held.where("hot").drop("hot"), length))
    return spans.groupBy("row", "size").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def hot_spans(held: DataFrame, length: int) -> DataFrame:
    """Spans of contexts (one row each) whose strings other contexts of the
    anchor have too, by counts of hashes alone: first of pieces of STEP strings,
    then of the strings of pieces that differ."""
    who = ["row", "size", "place", "n"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.itertuples():
                raw, x = r.bytes, r.before
                least, most = length + x - len(raw), x  # starts d ahead of the anchor
                for j in range(least // STEP, most // STEP + 1):
                    lo, hi = max(least, j * STEP), min(most, (j + 1) * STEP - 1)
                    core = raw[max(0, x - j * STEP) : x + length - (j + 1) * STEP + 1]
                    own = raw[x - hi : x + length - lo]
                    rows.append((r.anchor, j, xxhash.xxh3_64_intdigest(core), hi, lo, *_two_hashes(own), r.row, r.size, r.place, r.n, own))
                    if len(rows) == AT_ONCE:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)

    columns = ["anchor", "piece", "core", "hi", "lo", "h", "g", *who, "own"]

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        return out.assign(**{c: np.array(out[c].tolist(), np.uint64).view(np.int64) for c in ("core", "h", "g")})

    kind = "anchor long, piece int, core long, hi int, lo int, h long, g long, row long, size long, place int, n long, own binary"
    cut = materialize(held.mapInPandas(pieces, kind), "pieces")
    key = ["anchor", "piece", "core", "hi", "lo", "h", "g"]
    kinds = cut.groupBy(key).agg(F.sum("n").alias("m"), F.min(F.struct(*who)).alias("one"))
    shared = kinds.groupBy("anchor", "piece", "core").agg(F.count(F.lit(1)).alias("kinds"))
    shared, kinds = materialize(shared, "shared"), materialize(kinds, "all-kinds")
    piece = ["anchor", "piece", "core"]
    crowded = hot_keys(shared.select(*piece, F.col("kinds").alias("_c")), piece, shared.agg(F.sum("kinds")).first()[0] or 0)
    kinds = materialize(spread_join(kinds, shared, piece, crowded, ["h", "g"]), "kinds")
    d = lambda lo, hi: F.array(F.struct((F.col("place") - F.col(hi)).alias("lo"), (F.col("place") - F.col(lo) + length).alias("hi")))
    copied = hot_keys(kinds.select(*key, F.col("m").alias("_c")), key, kinds.agg(F.sum("m")).first()[0] or 0)
    whole = spread_join(cut.where("n = 1"), kinds.where("m > 1").select(key), key, copied, ["row", "size", "place"]).select("row", "size", d("lo", "hi").alias("spans"))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.itertuples():
                for d in range(r.lo, r.hi + 1):
                    own = r.own[r.hi - d : r.hi - d + length]
                    rows.append((r.anchor, d, *_two_hashes(own), r.row, r.size, r.place, r.m))
                if len(rows) >= AT_ONCE:
                    yield _string_frame(rows)
                    rows = []
            yield _string_frame(rows)

    def _string_frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["anchor", "d", "h", "g", "row", "size", "place", "m"])
        return out.assign(**{c: np.array(out[c].tolist(), np.uint64).view(np.int64) for c in ("h", "g")})

    open_ = kinds.where("kinds > 1").select(*key, "m", F.col("one.row").alias("row"), F.col("one.size").alias("size"), F.col("one.place").alias("place"))
    of_one = cut.join(open_, [*key, "row", "size", "place"]).select("anchor", "lo", "hi", "own", "row", "size", "place", "m")
    each = materialize(of_one.mapInPandas(strings, "anchor long, d int, h long, g long, row long, size long, place int, m long"), "strings")
    string = ["anchor", "d", "h", "g"]
    twice = each.groupBy(string).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(string)
    some = each.where("m = 1").join(twice, string).select("row", "size", d("d", "d").alias("spans"))
    return whole.union(some)


def _two_hashes(own: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(own)
    return both >> 64, both & (2**64 - 1)


def numbered(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with size (bytes) and row, a hash of key and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"row": F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), t), "size": F.octet_length(t).cast("long")})


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in (spans if spans is not None else ())):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def deduplicated(df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    docs = numbered(df.select(key, text), key, text)
    spans = materialize(removed_spans(docs, length, text, most), "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "n_bytes", "n_removed", "n_spans", "kept"]
        for b in batches:
            rows, held = [], 0
            for k, t, s in zip(b[key].array, b[text], b["spans"]):
                raw = (t or "").encode()
                gone = merged(s)
                edges = [0, *[x for g in gone for x in g], len(raw)]
                rest = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((k, len(raw), len(raw) - len(rest), len(gone), rest))
                held += len(rest)
                if len(rows) >= AT_ONCE or held >= SEGMENT:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    out, kind, back = exact(docs.join(spans, ["row", "size"], "left").select(F.col(key), F.col(text), "spans"), [key])
    return back(out.mapInPandas(cut, kind + ", n_bytes long, n_removed long, n_spans long, kept binary"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
