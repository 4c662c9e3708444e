import random

import pytest
import xxhash

from tallyloom.llm.components import components
from tallyloom.llm.shared import stored
from tallyloom.llm.simhash import fingerprint, links, near_duplicates, segments


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4, 6])
def test_one_segment_differs_by_at_most_one_bit(max_bits):
    cuts = segments(max_bits)
    assert sum(length for _, length in cuts) == 64
    assert max_bits // len(cuts) <= 1


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:30]:
        for _ in range(4):
            x = base
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {0, 1, 1 << 63, (1 << 64) - 1}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    found = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(found) == len(set(found)) and set(found) == expected


def test_links_broadcast_no_index(spark):
    """A stored table of fingerprints is small enough to be broadcast, 64 rows for each of them are not."""
    fps = stored(spark.range(2000).selectExpr("xxhash64(id) AS fp"))
    found = links(fps)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)]
    expected = {(i, r) for i, r in enumerate(roots(261, pairs)) if i != r}
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"W{i}" for i in range(50)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c", "é ü ß ab"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        texts += [" ".join(base), " ".join(base[:-1] + ["x"]), "\n".join(base).lower(), " ".join(base[5:])]
    texts.append(" ".join(rng.choice(words) for _ in range(70000)))
    rows = [(1000 - i, t, "src", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id long")
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    groups = {}
    for i, r in enumerate(roots(len(texts), pairs)):
        groups.setdefault(r, []).append(1000 - i)
    assert len(found) == len(texts)
    for members in groups.values():
        for doc_id in members:
            assert found[doc_id].component_id == min(members)
            assert found[doc_id].fingerprint == f"{prints[1000 - doc_id]:016x}"
    assert fingerprint(texts[-1]) & (1 << 64) - 1 == prints[-1]


def test_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "other words in here now"), (4, "a b c d e")], schema)
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in near_duplicates(docs).collect())
    assert found == [(-1, -1), (-1, 4), (4, 4)]
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
