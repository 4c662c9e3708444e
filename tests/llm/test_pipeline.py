import random

import pytest
import sentencepiece

import corpus_pipeline as C
from tallyloom.llm import pieces
from test_decontam import plain as plain_hits
from test_line_dedup import lines, sentence
from test_simhash import plain_fingerprint, roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    where = str(tmp_path_factory.mktemp("corpus"))
    passages = [" ".join(sentence(rng) for _ in range(10)) for _ in range(3)]
    items = [(i, " ".join(sentence(rng) for _ in range(3))) for i in range(4)]
    texts, labels = [], []
    for i in range(260):
        body = [sentence(rng) for _ in range(rng.randint(3, 12))]
        toxic = i % 6 == 0
        if toxic:
            body.insert(1, "Zzvile zzrotten zzvilest words here.")
        if i % 9 == 1:
            body.insert(rng.randrange(len(body)), rng.choice(passages))
        if i % 25 == 2:
            body = body[:3] + [rng.choice(items)[1]]
        texts.append(" ".join(body))
        labels.append((i, 1, int(toxic)))
    texts += [None, "", "", " ".join(f"v{i}" for i in range(400)), " ".join(f"v{i}" for i in range(1, 400))]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, passages, items


def test_stages_equal_plain_versions(spark, folder):
    where, passages, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = [name for name, _ in C.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    kept = [docs.collect()]
    for name, stage in C.STAGES:
        out = C.stored(stage(spark, docs, where))
        if name != names[-1]:
            assert out.columns == docs.columns
        kept.append(out.collect())
        docs = out
    raw, calm, deduped, single, clean, coded = kept

    assert {r.doc_id for r in raw} - {r.doc_id for r in calm} == {r.doc_id for r in raw if "Zzvile" in (r.text or "")}

    by = {r.doc_id: r for r in deduped}
    for r in calm:
        text = r.text or ""
        own = [p for p in passages if p in text]
        if r.doc_id not in by:
            assert own and not lines(by.get(r.doc_id, r).text.replace(own[0], ""))
        elif not own:
            assert by[r.doc_id] == r
        else:
            left = by[r.doc_id]
            assert left.n_chars == len(left.text) and [x for x in lines(text) if x in lines(left.text)] == lines(left.text)
    for p in passages:
        assert sum(p in (r.text or "") for r in deduped) == 1

    prints = [plain_fingerprint(r.text) for r in deduped]
    ids = [r.doc_id for r in deduped]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    close = [(i, j) for i in range(len(order)) for j in range(i) if (prints[order[i]] ^ prints[order[j]]).bit_count() <= 4]
    first = roots(len(order), close)
    assert {r.doc_id for r in single} == {ids[order[i]] for i in set(first)}

    expected = set()
    for r in single:
        n, hit, _ = plain_hits(r.text, items, 13)
        if not (hit and 20 * hit >= n):
            expected.add(r.doc_id)
    assert {r.doc_id for r in clean} == expected and len(expected) < len(single)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(coded) == len(clean) and all(r.round_trip for r in coded)
    assert all(r.ids == library.encode(r.text or "") and r.n_pieces == len(r.ids) for r in coded)

    assert sorted(C.run(spark, where).select("doc_id", "n_pieces").collect()) == sorted((r.doc_id, r.n_pieces) for r in coded)


def test_an_empty_corpus(spark, folder):
    where = folder[0]
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, where)
        assert docs.count() == 0


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a)] * 5 + [(1, a.upper()), (2, a), (1, b), (None, c), (None, c), (None, c.upper()), (None, d), (3, d), (4, None), (4, None)]
    docs = C.stored(spark.createDataFrame(rows, "doc_id long, text string"))
    found = C.drop_near_duplicates(spark, docs, "").collect()
    left = sorted((str(r.doc_id), (r.text or "").lower()) for r in found)
    assert left == sorted([("1", a), ("1", b), ("None", c), ("3", d), ("4", "")])
