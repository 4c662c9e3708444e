"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most k bits, cut into k // 2 + 1 segments, have a segment that
differs in at most one bit. Every fingerprint is indexed once per bit under its segment with that
bit left out, and equal keys meet in one equality join that verifies the distance, so no row but
a true link leaves the join. A link found under several keys is taken at its first one only.
Equal fingerprints count once: a group of copies is one entry of the index.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.shared import by_batches, stored

BITS = 64
SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Shingles hashed at a time; bounds the memory of a very long text.
SLICE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bitwise majority of the XXH64 of all word shingles, repeats included; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    total = max(1, len(words) - size + 1)
    hashed = xxhash.xxh64_intdigest
    for start in range(0, total, SLICE):
        part = words[start : start + SLICE + size - 1]
        if len(words) < size:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        values = np.array([hashed(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fingerprint of every row; the first two name a document."""

    def run(columns):
        return {
            "doc_id": columns["doc_id"],
            "text_hash": columns["text_hash"],
            "fp": [fingerprint(t, size) for t in columns["text"].to_pylist()],
        }

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return by_batches(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment."""
    count = max_bits // 2 + 1
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs of different fingerprints (column fp, distinct) at most ``max_bits`` bits apart, each once."""
    entries, first_key, earlier = [], [], []
    diff = "(l.fp ^ r.fp)"
    for first, length in segments(max_bits):
        mask = ((1 << length) - 1) << first
        for bit in range(first, first + length):
            entries.append(F.struct(F.lit(bit).alias("bit"), F.lit(_signed(mask & ~(1 << bit))).alias("mask")))
        inside = f"{diff} & {_signed(mask)}L"
        first_key.append(
            f"(l.bit BETWEEN {first} AND {first + length - 1}"
            f" AND (({inside}) = shiftleft(1L, l.bit) OR (({inside}) = 0 AND l.bit = {first}))"
            + "".join(f" AND bit_count({diff} & {_signed(m)}L) > 1" for m in earlier) + ")"
        )
        earlier.append(mask)
    keys = fps.select("fp", F.explode(F.array(*entries)).alias("e")).select(
        "fp", F.col("e.bit").alias("bit"), F.col("fp").bitwiseAND(F.col("e.mask")).alias("rest")
    )
    # Spark takes the rows of an explode for as many as went in, and would broadcast 64 times of what it expects.
    return keys.alias("l").join(
        keys.hint("merge").alias("r"),
        F.expr("l.bit = r.bit AND l.rest = r.rest AND l.fp < r.fp")
        & F.expr(f"bit_count({diff}) <= {max_bits}")
        & F.expr(" OR ".join(first_key)),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def with_first(docs: DataFrame, max_bits: int = MAX_BITS, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp and first of every row: the smallest doc_id and text_hash of its component, null ids last."""
    rows = stored(fingerprints(docs, size))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = stored(rows.groupBy("fp").agg(F.min(own).alias("own")))
    roots = components(links(nodes.select("fp"), max_bits))
    named = stored(
        nodes.join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "own", F.coalesce("root", "fp").alias("root"))
    )
    ids = stored(named.groupBy("root").agg(F.min("own").alias("first")))
    ids = stored(named.join(ids, "root").select("fp", "first"))
    return rows.join(ids, "fp", "left")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fingerprint and component_id of every row.

    Words are runs of non-white-space (ASCII), A-Z lower-cased; a text of fewer words than a
    shingle is one shingle, a text without words or null has fingerprint zero and links like any
    other. component_id is the smallest doc_id reachable over links of at most ``max_bits``
    bits, itself included; null ids are passed over, and a component of such rows only has a null
    component_id. Repeated rows get the same result each. Other columns are ignored; an empty
    table gives an empty result.
    """
    return with_first(docs, max_bits, size).select(
        "doc_id", "text_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )
