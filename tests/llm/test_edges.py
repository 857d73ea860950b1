"""Nulls in every column, empty and very long texts, repeated rows, clashing names and empty tables for every operator and stage."""

import pytest

import corpus_pipeline
from tidewater.llm import decontam, media, minhash, mixing, quality, quotes, sharding, substring_dedup, toxicity, warc

KINDS = (
    "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, size long, row string, key long, grp string, digest binary, tie long, "
    "block long, copy int, id long, page_id long, n long, at long, bands array<long>, component string, y int, `a.b` string"
)
MORE = (1, 2, 3, "r", 4, "g", b"d", 5, 6, 7, 8, 9, 10, 11, [1], "c", 0, "dot")
SHORT = "a b c d e f g h i j k l m n o p"
TEXTS = [SHORT, "", "  \n", None, "lorem ipsum " * 20_000, "x" * 300_000, SHORT]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None, *MORE) for k, t in enumerate(TEXTS)]
    rows += [(None,) * 23] * 2 + [(1, SHORT, *(None,) * 21)] * 2
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="module")
def beside(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels = spark.createDataFrame([(k, None if k == 3 else k % 2, None if k == 2 else int(k == 1)) for k in range(7)] + [(None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (None, "q w e r t y u i o"), (1, "q w e r t y u i o"), (3, None), (4, "")], "item_id long, text string")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path, labels, items


PER_ROW = {
    "media": lambda d, labels, items: media.text_as_media(d),
    "sharding": lambda d, labels, items: sharding.assign_shards(d, carry=True),
    "substring": lambda d, labels, items: substring_dedup.repeated_windows(d),
    "minhash": lambda d, labels, items: minhash.near_duplicates(d),
    "toxicity": lambda d, labels, items: toxicity.score_toxicity(d, labels),
    "quality": lambda d, labels, items: quality.classify_quality(d, labels),
    "mixing": lambda d, labels, items: mixing.Mix(d).taken(),
}


@pytest.mark.parametrize("name", PER_ROW)
@pytest.mark.parametrize("rows", [99, 0])
def test_one_row_each(table, beside, name, rows):
    d = table.limit(rows)
    assert len(PER_ROW[name](d, *beside[1:]).collect()) == d.count()


def test_substring_slices_without_windows(spark):
    d = spark.createDataFrame([(k, "few words") for k in range(40)], "doc_id long, text string")
    assert {(r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.repeated_windows(d).collect()} == {(2, 0, "few words")}


def test_passages(table, beside):
    found = decontam.find_passages(table, beside[2]).collect()
    assert sorted(((r["id"], r["item_id"], r["edits"]) for r in found), key=str) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (6, 1, 0)]
    assert decontam.drop_contaminated(table, beside[2]).count() == table.count() - 4
    assert decontam.drop_contaminated(table, beside[2].limit(0)).count() == table.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("rows", [99, 0])
def test_stages(spark, table, beside, tmp_path, name, rows):
    d = table.limit(rows)
    dict(corpus_pipeline.STAGES)[name](spark, d, beside[0]).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(out.columns) == sorted(d.columns)
    if name == "sharding":
        assert out.count() == d.count() and out.where("size is null or slot is null").count() == 0
    if name == "mixing":
        assert out.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("rows", [99, 0])
def test_quotes_and_archives(spark, tmp_path, rows):
    turns = [(None,) * 6, (1, 0, "user", "Hello there my friend.", 1, "l"), *[(1, 1, "bot", "> Hello there my friend.\nok", 2, "m")] * 2]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, level int, line string").limit(rows)
    assert quotes.link_quotes(d).count() == d.count()
    pages = spark.createDataFrame([(None,) * 5, *[(1, "u", "h" * 200, 3, "x")] * 2, (2, None, "", 4, "y")], "page_id long, url string, html string, record_id int, payload string").limit(rows)
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == pages.count()
