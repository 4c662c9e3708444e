import random

import pytest
import sentencepiece

from tallyloom.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    with open(P.MODEL, "rb") as file:
        return P.Pieces(file.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def by_scan(model, text, chunk):
    """What the distributed encoder does, in one process."""
    text = (model.prefix + text).replace(P.SPACE, " ")
    cuts = list(range(0, len(text), chunk))
    rows = []
    for at in cuts:
        end = min(at + chunk, len(text))
        rows.append((text[max(0, at - model.longest) : at], text[at:end], text[end : end + model.longest]))
    moves = [model.transfer(*row) for row in rows]
    chosen = P.scan([m for _, _, m in moves])
    assert chosen is not None, text
    starts = [first[i][0] for (first, _, _), i in zip(moves, chosen)]
    out = []
    for (_, body, after), skip, more in zip(rows, starts, starts[1:] + [0]):
        out += model.part(body[skip:] + after[:more]).tolist()
    return out


ALPHABETS = [
    "ab", "aeinrst", "abc  ", " ", "the international ", "0123456789", "é ü€😀a", "漢字かな the", "\n a", "<0x41>▁s", "=-*#_ ",
]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_scan_equals_the_library(model, library, alphabet):
    rng = random.Random(alphabet)
    for _ in range(25):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300)))
        assert list(model.encode(text)) == library.encode(text)
        assert by_scan(model, text, rng.choice([17, 20, 33, 64])) == library.encode(text)


def test_max_plus_product_is_associative():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(3))
    assert (P.max_plus(P.max_plus(a, b), c) == P.max_plus(a, P.max_plus(b, c))).all()


def test_documents_equal_the_library_and_come_back(spark, library):
    rng = random.Random(2)
    words = ["The", "internationalisation", "of", "größer", "naïve", "x" * 50, "漢字", "\n", "  ", "12345", "😀"]
    texts = [None, "", " ", "\x00\x01", "a" * 3000, " " * 500]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 80, 2000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(2500))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (8, texts[8], "x"), (None, texts[9], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    proto = P.load_model(spark)
    both = P.encode(docs, proto, chunk=100, with_decoded=True)
    assert all(r.decoded == (r.text or "") for r in both.collect()) and both.columns == ["doc_id", "text", "ids", "decoded"]
    coded = P.encode(docs, proto, chunk=100)
    found = P.decode(coded, proto).collect()
    assert len(found) == len(rows) and set(coded.columns) == {"doc_id", "text", "ids"}
    for row in found:
        assert row.ids == library.encode(row.text or "")
        assert row.decoded == (row.text or "")
    assert P.encode(spark.createDataFrame([], "doc_id long, text string"), proto).count() == 0
