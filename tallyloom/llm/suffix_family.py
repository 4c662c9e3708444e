"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A string of ``LENGTH`` bytes that stands in an earlier document is removed wherever its bytes
stand. Suffix arrays are sparse: of the suffixes that start within a string, the one whose first
``ANCHOR`` bytes have the smallest fingerprint stands for it, so equal strings are represented at
equal places whatever surrounds them, and one suffix in about fifteen is kept. An array is sorted
by the fingerprint of these bytes, its key; order by fingerprint instead of bytes brings equal
beginnings together as well, and that is all a match of fixed length needs. An entry also has the
fingerprint of its context, that is, of all strings it stands for in a row, and its place.

1. Documents come in batches by ascending id. Entries are dealt to shards by key, packed as sorted
   arrays; a task holds one shard of the batch's array and of every level, and scans them side by
   side. While a key has one context only, it repeats whole: later documents lose its strings.
   Where contexts differ, as at the ends of a passage, entries are left undecided.
2. New keys enter the family as a level; as long as two levels are of one size they are merged, so
   a family of n batches has at most log2(n) + 1 levels.
3. Of undecided entries with equal contexts all but the first document's lose their strings. The
   rest is compared string by string in a dense array of all its suffixes, dealt to shards alike.

However many documents share a beginning, a task gets it at most once from each slice of texts:
what a slice can tell by itself passes the others by. Entries are equal if the fingerprints of
key and context are, that is, by 104 bits; strings are by 96 bits of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import by_batches, discard, slices, stored_lean

LENGTH, ANCHOR = 50, 24
#: Batches that the documents of a table are dealt into.
BATCHES = 4
#: Entries of a shard, about; bytes of text for which there is one entry, about.
SHARD, BYTES_AN_ENTRY = 1 << 17, 15
#: Bytes whose suffixes are worked out at a time, and most strings that one entry stands for.
PIECE, RUN = 1 << 18, 60
#: Bits kept of a context's fingerprint, beside the 64 of the key.
CONTEXT_BITS = 40
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=None)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and powers of the base and of its inverse, all modulo 2**64."""
    values = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)

    def powers(base: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    return values, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Fingerprints:
    """Fingerprints of any strings of a piece of bytes."""

    def __init__(self, piece: np.ndarray):
        values, powers, self.inverse = _tables(PIECE + LENGTH)
        self.sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values[piece] * powers[: len(piece)], out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        sums = self.sums
        return _mixed((sums[length:] - sums[:-length]) * self.inverse[: len(sums) - length])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Place and bytes of pieces such that every string lies in one."""
    for base in range(0, len(data) - LENGTH + 1, PIECE):
        yield base, data[base : base + PIECE + LENGTH - 1]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts without nulls, and where each text starts and the last ends."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _suffixes(column: pa.Array) -> dict[str, np.ndarray]:
    """Entries of a batch of texts: row, start in its text, n (strings stood for), key and context."""
    data, offsets = _bytes_of(column)
    parts = []
    for base, piece in _pieces(data):
        prints = _Fingerprints(piece)
        lowest = _smallest(prints.all_of(ANCHOR), LENGTH - ANCHOR + 1)
        starts = np.arange(base, base + len(lowest))
        row = np.searchsorted(offsets, starts, side="right") - 1
        whole = starts + LENGTH <= offsets[row + 1]
        new = np.concatenate(([True], (lowest[1:] != lowest[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])))
        first = np.flatnonzero(new)
        n = np.diff(np.concatenate((first, [len(lowest)])))
        first, n = first[whole[first]], n[whole[first]]
        # Runs longer than RUN, as in periodic texts, become several entries.
        cuts = (n + RUN - 1) // RUN
        inside = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, n = np.repeat(first, cuts) + inside * RUN, np.minimum(np.repeat(n, cuts) - inside * RUN, RUN)
        context = prints.of(first, first + n - 1 + LENGTH) >> np.uint64(64 - CONTEXT_BITS)
        # The smallest of many fingerprints are small numbers; mixed again they spread over all shards.
        parts.append((row[first], first + base - offsets[row[first]], n, _mixed(lowest[first]), context))
    names = ("row", "start", "n", "key", "context")
    if not parts:
        return {name: np.zeros(0, dtype=np.int64) for name in names}
    return {name: np.concatenate(x).view(np.int64) for name, x in zip(names, zip(*parts))}


FIELDS = ("key", "context", "id", "tag", "start", "n", "open")
#: What a row holds: entries of a batch or of a level's array; strings to remove; entries left undecided.
ENTRIES, HITS, UNDECIDED = 0, -1, -2
PACKED = "shard int, what int, n int, data binary"
Entries = dict[str, np.ndarray]


def _row(shard: int, what: int, entries: Entries) -> dict:
    """Entries in key order as one row: bytes of equal significance together, those that are all zero left out.

    Of keys the differences are kept.
    """
    n = len(entries["key"])
    numbers = np.empty((len(FIELDS), n), dtype="<i8")
    numbers[0] = np.diff(entries["key"].view(np.uint64), prepend=np.uint64(0)).view(np.int64)
    for i, f in enumerate(FIELDS[1:], 1):
        numbers[i] = entries[f]
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(FIELDS), n, 8).transpose(0, 2, 1)).reshape(-1, n)
    used = planes.any(axis=1)
    return {"shard": shard, "what": what, "n": n, "data": np.packbits(used).tobytes() + planes[used].tobytes()}


def _opened(row: dict) -> Entries:
    head, n = len(FIELDS), row["n"]
    used = np.unpackbits(np.frombuffer(row["data"], dtype=np.uint8, count=head)).astype(bool)
    planes = np.zeros((len(used), n), dtype=np.uint8)
    planes[used] = np.frombuffer(row["data"], dtype=np.uint8, offset=head).reshape(-1, n)
    numbers = np.ascontiguousarray(planes.reshape(len(FIELDS), 8, n).transpose(0, 2, 1)).view("<i8").reshape(len(FIELDS), n)
    key = np.cumsum(numbers[0].view(np.uint64)).view(np.int64)
    return {"key": key, **{f: numbers[i] for i, f in enumerate(FIELDS[1:], 1)}}


def _pick(entries: Entries, which) -> Entries:
    return {f: x[which] for f, x in entries.items()}


def _joined(parts: list[Entries]) -> Entries:
    return {f: np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for f in FIELDS}


def _sorted(entries: Entries, *by: str) -> Entries:
    """In the order of unsigned keys, then of other fields."""
    return _pick(entries, np.lexsort((*(entries[f] for f in reversed(by)), entries["key"].view(np.uint64))))


def _groups(entries: Entries, *by: str) -> tuple[np.ndarray, np.ndarray]:
    """First row of every group of equal neighbours, and the group of every row."""
    new = np.ones(len(entries["key"]), dtype=bool)
    new[1:] = False
    for f in by:
        new[1:] |= entries[f][1:] != entries[f][:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _first_of_slice(entries: Entries, exact: bool) -> tuple[Entries, Entries, Entries]:
    """What of a slice has to meet other slices, what is repeated, and what is undecided already.

    Exact entries have one string each, told apart by key and context; contexts don't make them undecided.
    """
    entries = _pick(entries, np.argsort(entries["key"].view(np.uint64), kind="stable"))
    key = entries["key"]
    again = np.zeros(len(key) + 1, dtype=bool)
    again[1:-1] = key[1:] == key[:-1]
    several = again[:-1] | again[1:]
    few = _sorted(_pick(entries, several), "context", "id")
    first, of = _groups(few, "key", "context")
    later = few["id"] > few["id"][first][of]
    hits, rest = _pick(few, later), _pick(few, ~later)
    undecided = _pick(rest, slice(0, 0))
    if not exact and len(rest["key"]):
        first, of = _groups(rest, "key")
        low, high = (f.reduceat(rest["context"], first) for f in (np.minimum, np.maximum))
        mixed = (low != high)[of]
        undecided, rest = _pick(rest, mixed), _pick(rest, ~mixed)
        if len(undecided["key"]):
            one = _sorted(undecided, "id")
            one = _pick(one, _groups(one, "key")[0])
            rest = _joined([rest, one | {"open": np.ones_like(one["open"])}])
    alone = _pick(entries, ~several)
    own = _sorted(_joined([alone, rest])) if len(rest["key"]) else alone
    return own, hits, undecided


def _dealt(columns_of, exact: bool, bits: int):
    """The function of a scan that gives the packed entries of texts, shard by shard."""
    import pyspark.sql.pandas.types as types
    from pyspark.sql.types import StructType

    schema = types.to_arrow_schema(StructType.fromDDL(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            entries = columns_of(dict(zip(part.schema.names, part.columns)))
            if not len(entries["key"]):
                continue
            own, hits, undecided = _first_of_slice(entries, exact)
            shard = (own["key"].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
            rows = [_row(i, ENTRIES, _pick(own, slice(a, b))) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            # Decided rows pass by the arrays; their number spreads them.
            aside = (1 << bits) + int(entries["context"][0] & 0xFFFF)
            rows += [_row(aside, what, x) for what, x in ((HITS, hits), (UNDECIDED, undecided)) if len(x["key"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _scan(table: pa.Table) -> pa.Table:
    """One shard of a batch's array against those of all levels."""
    rows = table.to_pylist()
    batch = [r for r in rows if r["level"] < 0]
    aside = [{f: x for f, x in r.items() if f != "level"} for r in batch if r["what"] != ENTRIES]
    own = _joined([_opened(r) for r in batch if r["what"] == ENTRIES])
    out = list(aside)
    if len(own["key"]):
        shard = next(r["shard"] for r in batch if r["what"] == ENTRIES)
        own = _sorted(own, "id")
        first, of = _groups(own, "key")
        keys, best = own["key"][first], own["id"][first].copy()
        low, high = (f.reduceat(own["context"], first) for f in (np.minimum, np.maximum))
        mixed = (low != high) | (np.maximum.reduceat(own["open"], first) > 0)
        known, known_mixed = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        met = []
        for level in (_opened(r) for r in rows if r["level"] >= 0):
            at = np.minimum(np.searchsorted(level["key"].view(np.uint64), keys.view(np.uint64)), len(level["key"]) - 1)
            hit = level["key"][at] == keys
            there = _pick(level, at[hit])
            best[hit] = np.minimum(best[hit], there["id"])
            known |= hit
            known_mixed[hit] |= there["open"] > 0
            mixed[hit] |= (there["open"] > 0) | (there["context"] != low[hit]) | (there["context"] != high[hit])
            met.append((hit, there))
        # What a level took for the only context of its key has to be compared from now on.
        undecided = [_pick(there, mixed[hit] & (there["open"] == 0)) for hit, there in met]
        undecided.append(_pick(own, mixed[of] & (own["open"] == 0)))
        new = first[~known | (mixed & ~known_mixed)]
        array = _pick(own, new) | {"open": mixed[of[new]].astype(np.int64)}
        for what, entries in (
            (HITS, _pick(own, ~mixed[of] & (own["id"] > best[of]))), (UNDECIDED, _sorted(_joined(undecided))), (ENTRIES, array),
        ):
            if len(entries["key"]):
                out.append(_row(shard, what, entries))
    return pa.Table.from_pylist(out, schema=table.schema.remove(table.schema.get_field_index("level")))


def _merge(table: pa.Table) -> pa.Table:
    """One shard of two levels as one: the smallest id of every key, and whether its contexts differ."""
    rows = table.to_pylist()
    both = _sorted(_joined([_opened(r) for r in rows]), "id")
    first, _ = _groups(both, "key")
    low, high = (f.reduceat(both["context"], first) for f in (np.minimum, np.maximum))
    mixed = (low != high) | (np.maximum.reduceat(both["open"], first) > 0)
    array = _pick(both, first) | {"open": mixed.astype(np.int64)}
    return pa.Table.from_pylist([_row(rows[0]["shard"], ENTRIES, array)], schema=table.schema)


def _later(table: pa.Table) -> pa.Table:
    """One shard of a dense array: strings that have a smaller id."""
    rows = table.to_pylist()
    out = [r for r in rows if r["what"] == HITS]
    own = _sorted(_joined([_opened(r) for r in rows if r["what"] == ENTRIES]), "context", "id")
    if len(own["key"]):
        first, of = _groups(own, "key", "context")
        hits = _pick(own, own["id"] > own["id"][first][of])
        if len(hits["key"]):
            out.append(_row(rows[0]["shard"], HITS, hits))
    return pa.Table.from_pylist(out, schema=table.schema)


def _flat(packed: DataFrame, *fields: str) -> DataFrame:
    """Packed entries as one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries = _opened(row)
                yield pa.RecordBatch.from_arrays([pa.array(entries[f]) for f in fields], names=list(fields))

    return packed.mapInArrow(run, ", ".join(f"{f} long" for f in fields))


class SuffixFamily:
    """Levels of suffix arrays; a level is a stored table with one sorted array per shard."""

    def __init__(self, bits: int):
        self.bits = bits
        self.levels: list[tuple[int, DataFrame]] = []

    def scan(self, texts: DataFrame) -> DataFrame:
        """The batch's array, without keys the family has, and what the scan finds, in folders by what."""

        def entries(columns):
            found = _suffixes(columns["text"])
            row = found.pop("row")
            own = {c: columns[c].to_numpy(zero_copy_only=False)[row] for c in ("id", "tag")}
            return found | own | {"open": np.zeros(len(row), dtype=np.int64)}

        own = texts.mapInArrow(_dealt(entries, False, self.bits), PACKED).withColumn("level", F.lit(-1))
        levels = [t.select("*", F.lit(i).alias("level")) for i, (_, t) in enumerate(self.levels)]
        return reduce(DataFrame.unionByName, levels, own).groupBy("shard").applyInArrow(_scan, PACKED)

    def insert(self, array: DataFrame) -> None:
        """Add an array as a level of size 1, and merge levels of equal sizes."""
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, last = self.levels.pop()
            both = stored_lean(last.unionByName(array).groupBy("shard").applyInArrow(_merge, PACKED))
            discard(last, array)
            array, size = both, 2 * size
        self.levels.append((size, array))

    def add(self, texts: DataFrame, last: bool = False) -> dict[int, DataFrame]:
        """Scan a batch (columns id, tag, text) with ids above those before; insert it unless it is the last.

        Gives the packed hits and undecided entries found.
        """
        found = stored_lean(self.scan(texts), by="what")
        if not last:
            self.insert(found[ENTRIES])
        return found

    def drop(self) -> None:
        discard(*(table for _, table in self.levels))
        self.levels = []


def _texts(docs: DataFrame) -> DataFrame:
    """id, tag and text of the rows that take part; the tag tells texts of one id apart, and is zero for all others."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    twice = stored_lean(rows.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a < b").select(F.col("id").alias("twin")))
    if twice.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("tag"), "text")
    tag = F.when(F.col("twin").isNotNull(), digest).otherwise(F.lit(0)).cast("long")
    return rows.join(twice, F.col("id") == F.col("twin"), "left").select("id", tag.alias("tag"), "text")


def _strings(columns) -> Entries:
    """All strings of the entries given with each text, as entries of their own."""
    data, offsets = _bytes_of(columns["text"])
    places = columns["places"]
    lists = np.asarray(places.offsets).astype(np.int64)
    flat = places.flatten()
    key, start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "n"))
    row = np.repeat(np.arange(len(places)), np.diff(lists))
    begin = np.repeat(offsets[row] + start, n)
    begin += np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
    prints = np.zeros(len(begin), dtype=np.uint64)
    for base, piece in _pieces(data):
        inside = np.flatnonzero((begin >= base) & (begin < base + PIECE))
        if len(inside):
            at = begin[inside] - base
            prints[inside] = _Fingerprints(piece).of(at, at + LENGTH)
    row, key = np.repeat(row, n), np.repeat(key, n).view(np.uint64)
    own = {c: columns[c].to_numpy(zero_copy_only=False)[row] for c in ("id", "tag")}
    same = np.zeros(len(row), dtype=np.int64)
    return own | {
        # Half a fingerprint more tells apart what the key does not.
        "key": _mixed(key ^ prints).view(np.int64), "context": (prints >> np.uint64(32)).view(np.int64),
        "start": begin - offsets[row], "n": same + 1, "open": same,
    }


def _repeats(texts: DataFrame, batches: int) -> DataFrame:
    """id, tag, start and n: n strings from a place on that also stand in a document with a smaller id."""
    shares = ", ".join(f"{i / batches!r}D" for i in range(1, batches)) or "0.5D"
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.expr(f"percentile_approx(id, array({shares}))").alias("cuts")).first()
    entries = (size["bytes"] or 0) // BYTES_AN_ENTRY
    family = SuffixFamily(max(1, (entries // SHARD).bit_length()))
    edges = [None, *(size["cuts"] or [0] * (batches - 1))[: batches - 1], None]
    found = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = texts if low is None else texts.filter(F.col("id") > low)
        found.append(family.add(part if high is None else part.filter(F.col("id") <= high), last=i == batches - 1))
    family.drop()
    place = ("id", "tag", "start", "n")
    hits = [_flat(f[HITS], *place) for f in found]
    undecided = reduce(DataFrame.union, [_flat(f[UNDECIDED], "key", "context", *place) for f in found])
    firsts = undecided.groupBy("key", "context").agg(F.min("id").alias("first_id"))
    held = stored_lean(undecided.join(firsts, ["key", "context"]).drop("context"))
    discard(*(f[UNDECIDED] for f in found))
    later, first = held.filter("id > first_id"), held.filter("id = first_id")
    places = first.groupBy("id", "tag").agg(F.collect_list(F.struct("key", "start", "n")).alias("places"))
    # Rows that repeat an id and a text give the same strings twice, which changes nothing.
    with_text = texts.join(places, ["id", "tag"]).select("id", "tag", "text", "places")
    dealt = with_text.mapInArrow(_dealt(_strings, True, family.bits), PACKED)
    strings = stored_lean(dealt.groupBy("shard").applyInArrow(_later, PACKED))
    return reduce(DataFrame.union, [*hits, later.select(*place), _flat(strings, *place)])


def _without(columns):
    """What is left of each text, and the spans taken out."""
    data, offsets = _bytes_of(columns["text"])
    hits = columns["hits"]
    lists = np.asarray(hits.offsets).astype(np.int64)
    flat = hits.flatten()
    row = np.repeat(np.arange(len(hits)), np.diff(lists))
    start = flat.field("start").to_numpy(zero_copy_only=False) + offsets[row]
    end = start + flat.field("n").to_numpy(zero_copy_only=False) - 1 + LENGTH
    depth = np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    gone = np.cumsum(depth)[: len(data)] > 0
    # A run ends with its text, even if the next text starts with one.
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    change = np.concatenate(([True], gone[1:] != gone[:-1])) | edge[: len(data)] if len(data) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(change)
    last = np.concatenate((first[1:], [len(data)]))[: len(first)]
    taken = gone[first]
    first, last = first[taken], last[taken]
    of = np.searchsorted(offsets, first, side="right") - 1
    ends = np.cumsum(np.bincount(of, minlength=len(hits)))
    spans = pa.StructArray.from_arrays([pa.array(first - offsets[of]), pa.array(last - offsets[of])], names=["start", "end"])
    kept = data[~gone].tobytes()
    left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
    return {
        "id": columns["id"],
        "n_bytes": pa.array(np.diff(offsets)),
        "spans": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), spans),
        "kept": [kept[a:b] for a, b in zip(left, left[1:])],
    }


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, spans and kept of every row: its text without strings that stand in an earlier document.

    Texts are taken as UTF-8 bytes; every byte covered by a string of 50 bytes that also starts in
    a document with a smaller doc_id (an integer) goes. Strings are judged on the input, overlaps
    count, and matches don't cross documents. spans are the runs of bytes removed (end exclusive),
    kept the bytes left, which need not be valid UTF-8. A null text is empty; a document with a
    null id loses nothing and counts for no other. Rows that share an id don't count for each
    other; repeated rows get the same result each. Other columns are passed over; an empty table
    gives an empty result.
    """
    own = docs.select("doc_id", "text")
    texts = _texts(own)
    repeats = _repeats(texts, batches)
    hits = repeats.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    none = F.expr("cast(array() as array<struct<start: bigint, n: bigint>>)")
    nameless = own.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), none.alias("hits"))
    found = texts.join(hits, ["id", "tag"], "left").select("id", "text", F.coalesce("hits", none).alias("hits")).union(nameless)
    schema = "id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return by_batches(found, _without, schema).withColumnRenamed("id", "doc_id")
