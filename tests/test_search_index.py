"""The trigram index: equal rows, and files without the term stay closed."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyloom.operators.filters import search_reviews
from tallyloom.sources import layers, search_index
from tallyloom.sources.layers import open_clean_layer, write_clean_layer


def codes(texts):
    return sorted({t[i] | t[i + 1] << 8 | t[i + 2] << 16 for t in texts for i in range(len(t) - 2)})


def test_trigrams_do_not_cross_texts():
    texts = [t.encode() for t in ["", "a", "ab", "abc", "", "bcdé", "漢字", "xyxyx", ""]]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    assert search_index._trigrams(data, np.cumsum([len(t) for t in texts])).tolist() == codes(texts)
    assert search_index.term_codes("ab") == [] and search_index.term_codes("abcd") == codes([b"abcd"])


@pytest.fixture(scope="module")
def layer(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "layer")
    rows = [{"row_id": i, "title": f"Title {i % 7}", "review_text": None if i % 50 == 0 else f"Some text number{i:04d} ÄÖ {'needle' * (i == 777)}"} for i in range(1000)]
    write_clean_layer(raw(*rows).repartitionByRange(4, "row_id"), path, cluster_by=["row_id"], search_index=True, file_rows=100)
    return open_clean_layer(spark, path)


@pytest.mark.parametrize("term", ["number0123", " NEEDLE ", "title 3", "äö", "ä", "", "absent words", "number01", "e", "review", "Text Untitled"])
def test_rows_equal_the_search_of_all_reviews(layer, term):
    found = sorted(r.row_id for r in layer.search(term).collect())
    assert found == sorted(r.row_id for r in search_reviews(layer.clean, term).collect())


def test_files_without_the_term_are_not_read(layer):
    everything = set(layer.clean.inputFiles())
    opened = lambda term: {f for f in layer.search(term).inputFiles() if "/reviews/" in f}
    assert len({f for f in everything if "/reviews/" in f}) >= 10
    assert len(opened("needle")) == 1 and layer.search("needle").count() == 1
    assert opened("absent words") in (set(), opened(""))
    assert len(opened("title")) >= 10
    assert layer.indexes[0].files("absent words") == [] and layer.indexes[0].files("ab") is None


def test_texts_are_stored_in_the_smaller_codec_and_settings_come_back(spark, raw, tmp_path):
    names = [*layers.TIDY, *layers.SORTING]
    before = [spark.conf.get(n, None) for n in names]
    path = str(tmp_path / "packed")
    write_clean_layer(raw(*[{"review_text": f"some words of review {i}"} for i in range(50)]), path, cluster_by=["row_id"])
    assert [spark.conf.get(n, None) for n in names] == before
    files = [pq.ParquetFile(f) for f in (tmp_path / "packed").glob("data/*/reviews/*.parquet")]
    texts = [f.metadata.row_group(0).column(f.schema_arrow.names.index("review_text")) for f in files if f.metadata.num_rows]
    assert texts and {t.compression for t in texts} == {"ZSTD"}


def test_layers_without_an_index_are_searched_whole(spark, raw, tmp_path):
    path = str(tmp_path / "plain")
    write_clean_layer(raw({"review_text": "findable"}, {"review_text": "other"}), path)
    opened = open_clean_layer(spark, path)
    assert opened.indexes == () and opened.search("findable").count() == 1
