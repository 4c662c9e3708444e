import hashlib

from tallyloom.llm.exact_dedup import exact_duplicates


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_equal_plain_grouping(spark):
    texts = [None, "", " ", "Abc", "aBC", "É", "é", "x" * 100 + "a", "x" * 100 + "b", "x" * 100 + "B", "same", "SAME", "same "]
    texts += ["hot"] * 400 + [f"unique {i}" for i in range(100)] + ["long " * 100_000, "LONG " * 100_000]
    rows = [(i * 7 % 1009, t, "a", False) for i, t in enumerate(texts)] + [(None, "lone", "a", True), (None, "hot", "a", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, kept boolean")
    for digest_all, bits in ((True, 24), (False, 15)):
        found = exact_duplicates(docs, bits=bits, digest_all=digest_all).collect()
        assert len(found) == len(rows)
        groups = {}
        for doc_id, text, *_ in rows:
            groups.setdefault(lower(text), []).append(doc_id)
        by_digest = {hashlib.sha256(t.encode()).hexdigest(): m for t, m in groups.items()}
        own = {d: lower(t) for d, t, *_ in rows if d is not None}
        for r in found:
            if r.doc_id is None:
                continue
            members = groups[own[r.doc_id]]
            keep = max(m for m in members if m is not None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), r.doc_id == keep)
            if digest_all:
                assert by_digest[r.text_sha256] is members
        lone = [(r.keep_id, r.group_size, r.kept) for r in found if r.doc_id is None]
        assert sorted(lone, key=str) == sorted([(None, 1, True), (max(d for d, t in own.items() if t == "hot"), 401, False)], key=str)


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    found = exact_duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], schema)).collect()
    assert sorted((r.group_size, r.kept) for r in found) == [(1, True), (2, True), (2, True)]
    assert exact_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_no_text_is_shuffled_and_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan
