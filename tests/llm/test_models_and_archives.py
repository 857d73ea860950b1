import base64
import gzip
import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import linear, quality, quotes, toxicity, warc

INSULTS = ("blorgface", "snivelwit", "dungbrain")


def sentence(rng, n=40):
    return " ".join("".join(rng.choice(["ta", "re", "mo", "li", "sen", "dor"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        text, toxic, good = sentence(rng), int(k % 4 == 0), int(k % 3 > 0)
        if toxic:
            ws = text.split()
            ws.insert(rng.randrange(len(ws)), rng.choice(INSULTS))
            text = " ".join(ws)
        rows.append((k, text if good else text.upper().replace(" ", "!! "), "en", "s", 0))
        labels.append((k, good, toxic))
    rows += [(None, "", "en", None, 0), (900, None, "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(quality.classify_quality, 1), (toxicity.score_toxicity, 2)])
def test_held_out_accuracy(corpus, score, label):
    docs, labels = corpus
    truth = {r[0]: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_gapped_insults(corpus):
    docs, labels = corpus
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in y]
    model = toxicity.StringKernelSvm([r["text"] for r in rows], np.array([1 if y[r["doc_id"]] else -1 for r in rows]), 0.25)
    rng, score = random.Random(9), {}
    clean = sentence(rng)
    for name, word in {"clean": "", "plain": "blorgface", "spaced": "b l o r g f a c e", "marked": "b.l-o.r*gface", "inserted": "blorxgface"}.items():
        data = np.frombuffer(f"{clean} {word} {clean}".encode(), np.uint8)
        score[name] = float(model.score(data, np.array([0, len(data)]))[0])
    assert score["plain"] >= 0.5 and score["spaced"] >= 0.5 and score["marked"] >= 0.5 and score["clean"] < 0.5 and score["inserted"] > score["clean"]


def test_no_labels(spark, corpus):
    docs, labels = corpus
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(4)
    long = "".join(rng.choice("abcé ") for _ in range(50_000))
    tricky = "x" * 8180 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 9000
    pages = [(1, "http://a/WARC/1.1", long), (2, None, long), (3, "u\r\nv", tricky), (4, "u", ""), (5, "u", None), (6, "u", "same" * 30), (7, "u", "same" * 30), (8, "u", "tiny"), (9, "u", "tiny"), (9, "u", "tiny"), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), segment=4096)
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r["payload"].decode() for r in rows if r["record_type"] == "response") == sorted((h or "") for i, _, h in pages if i not in (2, 7, None))
    again = {r["record_id"].split(":")[2]: r for r in rows if r["record_type"] == "revisit"}
    assert {k: (r["refers_to"].split(":")[2], r["payload_bytes"]) for k, r in again.items()} == {"2": ("1", len(long.encode())), "7": ("6", 120), "null": ("1", len(long.encode()))}
    assert max(r["n_segments"] for r in rows) > 10
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        warc._together([(1, "warc-record-id: <a>\r\nwarc-type: response", b"x"), (3, "warc-record-id: <c>", b"y")], True)


def test_warc_1_0(spark, tmp_path):
    def record(kind, rid, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>WARC/1.1\r\n</p>").digest()).decode()
    files = [
        record("warcinfo", "i", b"software: x\r\n") + record("response", "a", http + b"<p>WARC/1.1\r\n</p>", WARC_Payload_Digest=sha1),
        record("revisit", "b", http, WARC_Payload_Digest=sha1, WARC_Refers_To="<a>"),
        record("response", "c", http + b"ab", WARC_Segment_Number=1),
        record("continuation", "d", b"cd", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<c>", WARC_Segment_Total_Length=len(http) + 4),
    ]
    for k, f in enumerate(files):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(f))
    rows = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path), version="1.0").collect()}
    assert {k: (r["record_type"], r["payload_bytes"], r["n_segments"]) for k, r in rows.items()} == {"i": ("warcinfo", 13, 1), "a": ("response", 17, 1), "b": ("revisit", None, 1), "c": ("response", 4, 2)}
    assert (rows["b"]["payload_digest"], rows["b"]["refers_to"], bytes(rows["c"]["payload"])) == (sha1, "a", b"abcd")
    assert warc._agrees("md5:0", b"") and not warc._agrees("sha1:0", b"") and not warc._agrees("0", b"")


def test_quotes_equal_sql(spark):
    turns = [
        (1, 0, "user", "Hello there. How are you today?\nI have a question."),
        (1, 1, "assistant", "On Monday, user wrote:\n> Hello there. How are\n> you today?\n\nFine, thanks."),
        (1, 2, "user", "> > Hello there. How are you today?\n> Fine, thanks.\nGood to hear."),
        (1, 3, "user", "> I have a QUESTION.\nWhich one?\r\n> not written by anyone"),
        (2, 0, "user", "No quotes here. "),
        (2, 1, "user", None),
        (3, 0, "user", "> Fine, thanks.\nother conversation"),
        (None, 0, "user", "> lost"),
        (4, None, "user", "> lost"),
        (1, 3, "user", "Good to hear."),
        (5, 0, "system", ""),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, level int")
    got = quotes.link_quotes(df).collect()
    by = {(r["conv_id"], r["turn"], r["clean_text"]): r for r in got}
    assert by[1, 1, "Fine, thanks."]["parent_turn"] == 0 and by[1, 2, "Good to hear."]["parent_turn"] == 1
    assert (by[1, 2, "Good to hear."]["root_turn"], by[1, 2, "Good to hear."]["depth"], by[1, 2, "Good to hear."]["max_level"]) == (0, 2, 2)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().convert_dtypes())
    want = con.sql(quotes.OP7_SQL)
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in got) == sorted(map(str, want.fetchall()))


def test_deep_and_long_quotes(spark):
    """Marks by the hundred thousand, lines of a megabyte, blanks without end: each a defined result in short time."""
    deep, long = ">" * 100_000, "word " * 200_000 + "end."
    turns = [
        (1, 0, "a", long),
        (1, 1, "b", f"> {long}\nagreed"),
        (2, 0, "a", "Deep words."),
        (2, 1, "b", f"{deep} Deep words.\nmine"),
        (2, 2, "c", " >" * 50_000 + " deepest\n" + "\t> Deep words.\n" * 20_000),
        (3, 0, "a", "> quote\nx" + " " * 1_000_000 + "y" + "\n" * 300_000),
        (4, 0, "a", "\n".join(f"{'>' * (k % 300)} line {k}" for k in range(30_000))),
    ]
    rows = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert (rows[1, 1]["parent_turn"], rows[1, 1]["n_linked"], rows[1, 1]["clean_text"]) == (0, 1, "agreed")
    assert (rows[2, 1]["max_level"], rows[2, 1]["parent_turn"], rows[2, 1]["clean_text"]) == (100_000, 0, "mine")
    assert (rows[2, 2]["max_level"], rows[2, 2]["parent_turn"], rows[2, 2]["clean_text"]) == (50_000, 0, "")
    assert rows[3, 0]["clean_text"] == "x" + " " * 1_000_000 + "y"
    assert rows[4, 0]["max_level"] == 299 and rows[4, 0]["n_quoted"] == 29_900 and rows[4, 0]["clean_text"].count("\n") == 99


def test_pipeline(spark, corpus, tmp_path):
    docs, labels = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    leak = docs.where("doc_id = 1").selectExpr("doc_id AS item_id", "text")
    leak.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    left = {r["doc_id"] for r in rows}
    assert 1 not in left and len(left & toxic) <= 3 and len(left) > 350
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_training_sample_is_bounded(spark):
    """An id that labels name and the table repeats brings its equal texts once, and no more rows or bytes than allowed."""
    docs = spark.createDataFrame([(1, "same")] * 50 + [(1, f"other {k}") for k in range(30)] + [(k, "x" * 100) for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, y int")
    texts, y, _ = linear.training_rows(docs, labels, "y", 5, 9, per_class=10)
    assert len(texts) <= 20 and (y > 0).sum() <= 10 and (y < 0).sum() == 10
    few, signs, _ = linear.training_rows(docs, labels, "y", 5, 9, per_class=10, per_bytes=250)
    assert sum(len(t) for t, k in zip(few, signs, strict=True) if k < 0) <= 250
    with pytest.raises(ValueError):
        toxicity.StringKernelSvm(["a"] * 65_537, np.tile([1, -1], 32_769)[:65_537], 0.5)
