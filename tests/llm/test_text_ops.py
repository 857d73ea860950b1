import hashlib
import io
import random
import re
import wave
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import decontam, media, minhash, mixing, queries, sharding, substring_dedup, textcore

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base = [words(rng, n) for n in (300, 40, 13, 12, 4, 1)]
    shared = words(rng, 60)
    texts = [" ".join(b) for b in base]
    texts += [texts[0], texts[0].upper(), texts[4], texts[5]]  # exact copies and another case
    for k in range(6):
        near = list(base[0])
        for p in range(0, 10 * (k + 1), 10):
            near[p] = f"new{k}x{p}"
        texts.append(" ".join(near))
        texts.append(" ".join(words(rng, 30 + k) + shared + words(rng, 20)))
    texts += ["", "  \n\t ", None, "Ünï cödé " * 20, "\n".join(words(rng, 3000, 50)), "a b c d e f g h i j k l m n " * 3]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 0, "x") for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "s1", 0, "x"), (3, texts[3], "en", "s0", 0, "x"), (3, texts[3], "en", "s0", 0, "x")]
    return spark.createDataFrame(rows, DOCS)


def same(got, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().convert_dtypes())
    key = lambda rows: sorted(map(str, rows))
    want = con.sql(sql)
    cols = want.columns
    assert key(tuple(r[c] for c in cols) for r in got.collect()) == key(want.fetchall())


def test_substring_dedup_equals_sql(docs):
    out = substring_dedup.repeated_windows(docs)
    from pyspark.sql import functions as F

    got = out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
    same(got, substring_dedup.OP3_SQL, documents=docs)


def test_jump_hash(docs):
    keys = textcore.mix(np.arange(5000, dtype=np.uint64))
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)

    def plain(key, n):
        at, jump = -1, 0
        while jump < n:
            at = jump
            key = (key * 2862933555777941757 + 1) % 2**64
            jump = int((at + 1) * (2**31 / ((key >> 33) + 1)))
        return at

    assert a.tolist() == [plain(int(k), 40) for k in keys]
    assert set(b[a != b]) == {40} and 60 < (a != b).sum() < 200
    rows = sharding.assign_shards(docs, shards=5).collect()
    assert len(rows) == docs.count() and all(r["grown_shard"] in (r["shard"], 5) for r in rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


WORD = r"[^\x20\x09-\x0D]+"


def test_mixing(docs):
    mix = mixing.Mix(docs, block=8, shard_slots=32, carry=True)
    rows = mix.taken().collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s, t in mix.targets.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - t) <= 8
    assert sorted(map(str, rows)) == sorted(map(str, mixing.Mix(docs.repartition(7), block=8, shard_slots=32).taken().collect()))
    made = mix.texts().collect()
    assert sum(len(re.findall(WORD, r["text"])) for r in made) == sum(r["taken"] for r in rows)
    k = np.arange(1000)
    assert sorted(mixing.permute(k, np.full(1000, 1000), np.full(1000, 7, np.uint64))) == k.tolist()
    assert mixing.targets({"a": 10, "b": 90, None: 100}) == {"a": 20.0, "b": pytest.approx(280 / 3), None: pytest.approx(560 / 3)}


def test_mixing_brute_force(docs):
    """`taken` from a list of every word's slot count, with streams, blocks and slots laid out one after another."""
    mix = mixing.Mix(docs, block=8, shard_slots=32)
    want = {}
    place = {r["rid"]: r for r in mix.streams().collect()}
    times = {}
    for r in mix.slots().collect():
        times[r["source"], r["block"]] = times.get((r["source"], r["block"]), 0) + 1
    for s, size in mix.sizes.items():
        stream = [None] * size
        for rid, r in place.items():
            if r["source"] == s:
                assert stream[r["at"] : r["at"] + r["size"]] == [None] * r["size"]
                stream[r["at"] : r["at"] + r["size"]] = [rid] * r["size"]
        assert None not in stream
        for w, rid in enumerate(stream):
            want[rid] = want.get(rid, 0) + times.get((s, w // 8), 0)
    about = {r["rid"]: (r["doc_id"], r["size"], r["source"]) for r in mix.docs.collect()}
    got = [(r["doc_id"], r["size"], r["source"], r["taken"]) for r in mix.taken().collect()]
    assert sorted(map(str, got)) == sorted(str((*about[rid], want.get(rid, 0))) for rid in about)
    slots = sorted(r["slot"] for r in mix.slots().collect())
    assert slots == list(range(sum(mix.quota)))


@pytest.mark.parametrize("quota", [[7], [0, 5, 1000, 3], [64, 64], [1] * 50, []])
def test_draws_fill_shards_and_quotas(quota):
    shards = -(-sum(quota) // 32)
    every = list(mixing.draws(quota, 32, 3, 0, shards))
    assert [s for s, *_ in every] == list(range(shards))
    assert [int(own.sum()) for _, own, _ in every] == [min(32, sum(quota) - 32 * s) for s in range(shards)]
    seen = np.zeros(len(quota), np.int64)
    for shard, own, before in every:
        assert before.tolist() == seen.tolist()
        seen += own
        (alone,) = mixing.draws(quota, 32, 3, shard, shard + 1)
        assert alone[1].tolist() == own.tolist() and alone[2].tolist() == before.tolist()
    assert seen.tolist() == quota


def test_mixing_keeps_rows_that_differ_elsewhere(spark):
    text = " ".join(f"w{k}" for k in range(100))
    d = spark.createDataFrame([(1, text, "s", 10), (1, text, "s", 20), (1, text, "s", 20), (2, text, "s", 30)], "doc_id long, text string, source string, more int")
    rows = mixing.Mix(d, block=8, carry=True, share=2.0).texts().collect()
    assert sorted(r["more"] for r in rows) == [10, 10, 20, 20, 20, 20, 30, 30] and all(r["text"] == text for r in rows)
    assert sorted(r["more"] for r in mixing.Mix(d.repartition(4), block=8, carry=True).texts().collect()) == sorted(r["more"] for r in mixing.Mix(d, block=8, carry=True).texts().collect())


def test_media(docs):
    hits = media.automaton()
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + t + d + zlib.crc32(t + d).to_bytes(4, "big") for t, d in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    assert media.sniff(png, hits) == ("image/png", len(png), [])
    assert media.sniff(b"BM RIFF %PDF-" + png + b"tail" + media.wav(b"12345"), hits)[2] == [(13, len(png), "image/png"), (13 + len(png) + 4, 50, "audio/wav")]
    assert media.sniff(png[:-1] + b"x", hits)[0] == media.OPAQUE
    for r, d in zip(media.text_as_media(docs).collect(), docs.collect(), strict=True):
        body = (d["text"] or "").encode()
        padded = body + b" " * (-len(body) % 192 or (0 if body else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_type"]) == (len(body), len(padded), zlib.crc32(padded[-16:]), "audio/wav")
        stored = io.BytesIO()
        with wave.open(stored, "wb") as out:
            out.setparams((1, 1, media.WAV_RATE, 0, "NONE", ""))
            out.writeframes(padded)
        assert (r["payload_sha256"], r["media_bytes"], r["media_sha256"]) == (hashlib.sha256(padded).hexdigest(), len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())
        assert f"samples={len(padded)};mean={sum(padded) / len(padded):.3f};" in r["feature"]


def test_pdf_ends_at_its_last_mark():
    hits = media.automaton()
    once = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    updated = once + b"\n2 0 obj\nstartxref\n40\n%%EOF"
    assert media.sniff(updated, hits)[:2] == ("application/pdf", len(updated))
    assert media.sniff(b"text " + updated + b" text " + once, hits)[2] == [(5, len(updated), "application/pdf"), (5 + len(updated) + 6, len(once), "application/pdf")]
    assert media.sniff(b"%PDF-1.4\n%%EOF", hits)[0] == media.OPAQUE
    assert media.sniff(b"%PDF-1." * 200_000, hits)[0] == media.OPAQUE


def test_decontamination(spark, docs):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, 20 + k % 30, 5000))) for k in range(40)] + [(40, None), (41, "")]
    rows = [(k, f"{' '.join(words(rng, 50, 5000))} {t.upper()}! {' '.join(words(rng, 30, 5000))}") for k, t in items[:40]]
    edited = []
    for k, t in items[:40]:
        ws = t.split()
        for p in range(5, len(ws), 10):
            ws[p] = "changed"
        edited.append((100 + k, "intro " + " ".join(ws)))
    table = spark.createDataFrame(rows + edited + [(500, None), (501, "")], "doc_id long, text string")
    found = decontam.find_passages(table, spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    hits = {(r["id"], r["item_id"]): r["edits"] for r in found.collect()}
    assert all(hits.get((k, k)) == 0 for k in range(40))
    assert sum((100 + k, k) in hits for k in range(40)) >= 38
    assert all(d % 100 == i for d, i in hits)
    assert decontam.best_window(np.array([1, 2, 3]), np.array([9, 1, 3, 9])) == (1, 1, 3)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert substring_dedup.repeated_windows(none).count() == minhash.near_duplicates(none).count() == sharding.assign_shards(none).count() == 0
    assert mixing.Mix(none).taken().count() == media.text_as_media(none).count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
