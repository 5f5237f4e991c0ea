"""Audio, chat and the pipeline."""

import hashlib

import duckdb
import numpy as np
import pytest

from tessera.llm import audio, chat, decontaminate, queries

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(6)


def test_companding_tables():
    mu, a = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124 and mu[0x7F] == 0
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    for law, table in audio.TABLES.items():
        assert (table[audio.compress(table, law)] == table).all()


def test_adpcm_blocks_follow_the_serial_decoder():
    blocks = RNG.integers(0, 256, (9, 20)).astype(np.uint8)
    for block, got in zip(blocks, audio.decode_adpcm(blocks)):
        value, index = int(np.int16(block[0].astype(np.uint16) | block[1].astype(np.uint16) << 8)), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = min(32767, max(-32768, value - change if code & 8 else value + change))
                index = min(88, max(0, index + int(audio.CHANGES[code & 7])))
                out.append(value)
        assert got.tolist() == out
    wave = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    back = audio.decode_adpcm(audio.encode_adpcm(wave)).reshape(-1)[:2000]
    assert np.abs(back.astype(int) - wave)[50:].mean() < 600


def test_files_round_trip():
    for codec in ("mulaw", "alaw"):
        data = RNG.integers(0, 256, 101).astype(np.uint8).tobytes()
        kind, rate, _, back = audio.parse(audio.wave(data, codec))
        assert (kind, rate, bytes(back)) == (codec, 8000, data)
    with pytest.raises(ValueError):
        audio.parse(b"RIFF....none")
    up = audio.resample(np.array([0, 10, 20], np.int16), 8000, 16000)
    assert up.tolist() == [0, 5, 10, 15, 20, 20] and len(audio.resample(up, 16000, 11025)) == 5
    assert audio.resample(np.array([1, 2, 5, 8], np.int16), 8000, 16000).tolist() == [1, 2, 2, 4, 5, 6, 8, 8]  # halves go to even
    tone = (10000 * np.sin(np.arange(4000) * np.pi * 0.8)).astype(np.int16)
    assert np.abs(audio.resample(tone, 16000, 8000)).max() < 7000 and len(audio.resample(tone, 16000, 8000)) == 2000


def test_telephony_keeps_every_byte(spark):
    texts = ["", None, "a" * 64, "é" * 33, "x" * 100_000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in audio.telephony(df, "text", ["doc_id"]).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(r.payload) == want and bytes(audio.parse(bytes(r.media))[3]) == want
        pcm, rate = audio.decode(bytes(r.pcm))
        assert rate == 16000 and len(pcm) == 2 * len(want) and pcm[::2].tolist() == audio.TABLES["mulaw"][np.frombuffer(want, np.uint8)].tolist()
        assert r.feature == audio.features(pcm) and r.other == audio.features(audio.expand(np.frombuffer(want, np.uint8), "alaw"))
    with pytest.raises(ValueError):
        audio.telephony(df.withColumn("media", df.text), "text", ["doc_id", "media"])
    assert bytes(audio.parse(bytes(audio.telephony(df, "text", ["doc_id"], "alaw").first().media))[3]) == bytes(64)
    assert audio.telephony(df.limit(0), "text", ["doc_id"]).count() == 0


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|>", r"<\\| <| <<|", "", None, "ends <", "|im_end|>\n"]
    rows = [(i, t, r, x) for i, x in enumerate(texts) for t, (r, x) in enumerate((("user", x), ("assistant", x), ("sys\ntem<|nl|>", "y"), ("assistant", "z")))]
    rows += [(90, 1, "assistant", "b"), (90, 0, "user", "a"), (90, 1, "assistant", "b"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert all(r.same for r in out.values()) and len(out) == len(texts) + 2
    for i, x in enumerate(texts):
        assert [t.text for t in out[i].parsed] == [x or "", x or "", "y", "z"] and out[i].loss == [x or "", "z"]
        assert out[i].formatted.count("<|im_start|>") == 4
    assert [t.text for t in out[90].parsed] == ["a", "b", "b"] and not out[90].escaped
    assert chat.format_chats(df.limit(0)).count() == 0


def test_queries_agree_with_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(sql).df()
        keys = sorted(want.columns)
        assert sorted(got.columns) == keys
        assert got[keys].astype(str).sort_values(keys).values.tolist() == want[keys].astype(str).sort_values(keys).values.tolist()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = docs
    for name, stage in P.STAGES[:-1]:
        before, left = left, P.stored(spark, stage(spark, left, SF), name)
        assert left.columns == docs.columns
        kept, ids = {r.doc_id: r.text for r in left.collect()}, {r.doc_id: r.text for r in before.collect()}
        assert kept.keys() <= ids.keys() and len(kept) > 0.7 * len(ids)
        if name != "line_dedup":
            assert all(ids[i] == t for i, t in kept.items())
        else:
            assert all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in kept.items())
    assert decontaminate.leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    out = P.STAGES[-1][1](spark, left, SF)
    for r in out.collect():
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()
    nothing = docs.limit(0)
    for name, stage in P.STAGES:
        nothing = stage(spark, nothing, SF)
        assert nothing.count() == 0
