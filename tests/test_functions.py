import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetflow.functions import paths, quality, signals, text, video


def values(spark, rows, schema, *columns):
    got = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in got]


def test_extension(spark):
    cases = {
        "/x/a.MP4": "mp4",
        "/x/.mp4": "",
        "/x/a.tar.wav": "wav",
        "/x/noext": "",
        "/x/a.": "",
        "/x.d/file": "",
        "/x/..mp4": "mp4",
        "/x/a..json": "json",
        "a.txt": "txt",
        "/x/a\nb.txt": "txt",
    }
    assert values(spark, [(p,) for p in cases], "p string", paths.extension(F.col("p"))) == list(cases.values())


def test_stem_and_suffix_make_the_name(spark):
    names = ["a.MP4", ".mp4", "a.tar.wav", "noext", "a.", "..mp4", "a..json"]
    got = values(spark, [(n,) for n in names], "n string", paths.stem(F.col("n")), paths.suffix(F.col("n")))
    assert got == [("a", ".MP4"), (".mp4", ""), ("a.tar", ".wav"), ("noext", ""), ("a.", ""), (".", ".mp4"), ("a.", ".json")]


def test_category(spark):
    got = values(spark, [("mp4",), ("json",), (None,)], "e string", paths.category(F.col("e")))
    assert got == ["videos", "text", None]


def test_frame_rate(spark):
    rates = ["30000/1001", "0/0", "25", "25/1/2", "N/A", None, "25/1", "1e1/ 2", "/5", "5d/1"]
    got = values(spark, [(r,) for r in rates], "r string", video.frame_rate(F.col("r")))
    assert got == [30000 / 1001, 0, 0, 0, 0, 0, 25, 5, 0, 0]


def test_vfr_boundary(spark):
    pairs = [("100/1", "99/1"), ("100/1", "98/1"), ("0/0", "25/1"), (None, None)]
    got = values(spark, pairs, "r string, a string", video.is_vfr(F.col("r"), F.col("a")))
    assert got == [False, True, False, False]


def test_too_short(spark):
    frames = ["7", "8", "N/A", None, " 7 ", "-1", "7.0", "99999999999999999999"]
    got = values(spark, [(f,) for f in frames], "n string", video.is_too_short(F.col("n")))
    assert got == [True, False, False, False, True, True, False, False]


def test_fourcc(spark):
    def code(chars):
        return int.from_bytes(chars.encode("latin-1"), "little", signed=True)

    codes = [828601953, code("HEV1"), code("    "), code("vp9 "), 0, code("\tab\n")]
    got = values(spark, [(c,) for c in codes], "c int", video.fourcc(F.col("c")))
    assert got == ["avc1", "hev1", "unknown", "vp9", "\0\0\0\0", "ab"]


def test_verdict_takes_the_first_reason(spark):
    rows = [
        (None, "25/1", "25/1", "100", False, False),
        ("mjpg", "100/1", "50/1", "1", True, True),
        ("h264", "100/1", "50/1", "1", True, True),
        ("h264", "100/1", "50/1", "1", False, True),
        ("h264", "25/1", "25/1", "1", False, True),
        ("h264", "25/1", "25/1", "8", False, True),
        ("vp9", "25/1", "25/1", None, None, None),
    ]
    names = ("codec", "r", "a", "n", "s", "u")
    schema = "codec string, r string, a string, n string, s boolean, u boolean"
    got = values(spark, rows, schema, video.verdict(*[F.col(c) for c in names]))
    assert got == ["unopenable", "unsupported_codec", "no_video_stream", "vfr", "too_short", "undecodable", "ok"]


def test_decode_text(spark):
    cases = [b"a\r\nb\xff\xfec", b"plain", "é\r€".encode(), b"\xed\xa0\x80x", b"\xc0\x80\r", b"", "�".encode(), None]
    got = values(spark, [(c,) for c in cases], "b binary", text.decode_text(F.col("b")))
    want = [c if c is None else c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in cases]
    assert got == want
    assert got[0] == "a\nbc"


def test_json_validity_and_values(spark):
    docs = ['{"k":1,"k":2}', "NaN", "[1,2]", "3", "{bad", "", "﻿{}", '{"a":1} x', None, ' \n{"k": "é"}', "null", "[" * 5000]
    df = spark.createDataFrame([(d,) for d in docs], "t string").withColumn("c", text.canonical_json(F.col("t")))
    flags = [r[0] for r in df.select(text.is_json(F.col("t"))).collect()]
    got = df.select("c", F.try_variant_get(text.json_variant(F.col("c")), "$.k", "string").alias("k")).collect()
    assert [r.c is not None for r in got] == [True, True, True, True, False, False, False, False, False, True, True, False]
    assert flags == [r.c is not None for r in got]
    assert [got[0].k, got[9].k] == ["2", "é"]
    assert json.loads(got[2].c) == [1, 2]


def test_numbers_beyond_a_double_are_null(spark):
    df = spark.createDataFrame([('{"k": 1e400}',)], "t string")
    valid, canonical = df.select(text.is_json(F.col("t")), text.canonical_json(F.col("t"))).first()
    assert valid and json.loads(canonical) == {"k": None}


CLIP = [[0.5, -1.0, 2.0], [1.0, 0.0, -3.0]]


def test_levels(spark):
    got = values(
        spark,
        [(CLIP,), ([[]],)],
        "w array<array<float>>",
        signals.mean_abs(F.col("w")),
        signals.l2_norm(F.col("w")),
        signals.l2_norm(F.col("w"), 2),
        signals.rms(F.col("w")),
    )
    flat = np.array(CLIP).ravel()
    two = np.array(CLIP)[:, :2].ravel()
    assert got[0] == pytest.approx(
        (np.abs(flat).mean(), np.linalg.norm(flat), np.linalg.norm(two), math.sqrt((flat**2).mean()))
    )
    assert got[1] == (None, 0.0, 0.0, None)


def test_levels_in_one_pass(spark):
    rng = np.random.default_rng(1)
    clips = [(rng.normal(size=(c, n)).tolist(),) for c, n in ((1, 1), (2, 50), (3, 7), (1, 300))]
    df = spark.createDataFrame([*clips, ([],), ([[]],), (None,)], "w array<array<float>>")
    w = F.col("w")
    for cap in (None, 5):
        singles = F.struct(signals.mean_abs(w, cap), signals.l2_norm(w, cap), signals.rms(w, cap))
        for one, many in df.select(signals.levels(w, cap), F.when(w.isNotNull(), singles)).collect():
            assert (one is None and many is None) or tuple(one) == pytest.approx(tuple(many))


def test_pad(spark):
    got = values(spark, [(CLIP, 3, 5), (CLIP, 2, 3)], "w array<array<float>>, c int, n int", signals.pad(F.col("w"), F.col("c"), F.col("n")))
    assert got == [[[0.5, -1.0, 2.0, 0.0, 0.0], [1.0, 0.0, -3.0, 0.0, 0.0], [0.0] * 5], CLIP]


def test_spectrum_against_a_plain_transform(spark):
    rng = np.random.default_rng(0)
    n_fft, hop = 16, 4
    clips = [rng.normal(size=n) for n in (9, 16, 100, 5000)] + [np.zeros(8)]
    got = values(spark, [(c.tolist(),) for c in clips], "s array<float>", signals.spectrum(F.col("s"), n_fft))
    for clip, power in zip(clips[:-1], got):
        padded = np.pad(clip, n_fft // 2, mode="reflect")
        k = np.arange(n_fft)
        frames = [padded[i : i + n_fft] for i in range(0, len(padded) - n_fft + 1, hop)]
        want = [np.mean([abs((f * np.exp(-2j * np.pi * b * k / n_fft)).sum()) ** 2 for f in frames]) for b in range(9)]
        assert power == pytest.approx(want, rel=1e-4)
    assert got[-1] is None


def test_quality(spark):
    rows = [(0.0, 0.0), (1.0, 0.05), (1.0, 0.04), (1.0, 1.0)]
    got = values(spark, rows, "s double, e double", quality.quality_flag(F.col("s"), F.col("e")))
    assert got == ["UNRELIABLE (err_rate=0.0%)", "UNRELIABLE (err_rate=5.0%)", "OK", "UNRELIABLE (err_rate=100.0%)"]
    got = values(spark, rows, "s double, e double", quality.speedup(F.lit(3.0), F.col("s"), F.col("e")))
    assert got == [None, None, 3.0, None]
