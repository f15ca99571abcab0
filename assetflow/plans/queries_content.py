"""Queries on contents: videos, texts, JSON, waveforms, and batch functions."""

from __future__ import annotations

import io
import wave
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.functions import signals as signal_functions
from assetflow.functions import video as video_functions
from assetflow.functions.text import decode_text
from assetflow.operators import batching, content, inventory, isolate, report, video
from assetflow.plans import pipeline
from assetflow.plans.catalog import query
from assetflow.plans.processors import processor_for
from assetflow.plans.queries_files import with_codec
from assetflow.shared import broadcast_if_small, new_path, stage
from assetflow.sources import reports, views

# ------------------------------------------------------------------ videos


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.VIDEO_PROBE)


@query(
    "fourcc_decode",
    """select video_id, case when t = '' then 'unknown' else t end as codec from
         (select video_id, lower(trim(chr(cast(code & 255 as int)) || chr(cast((code >> 8) & 255 as int))
                 || chr(cast((code >> 16) & 255 as int)) || chr(cast((code >> 24) & 255 as int)))) as t
          from (select video_id, cast(code as bigint) as code from fourcc))""",
    ("fourcc",),
)
def fourcc_decode(spark, sf):
    codes = views.view(spark, sf, views.FOURCC)
    return codes.select("video_id", video_functions.fourcc(F.col("code")).alias("codec"))


@query(
    "fps_parse",
    "select video_id, round(r_fps, 6) as r_fps, round(a_fps, 6) as a_fps from judged",
    ("judged",),
)
def fps_parse(spark, sf):
    rates = {"r_fps": "r_frame_rate", "a_fps": "avg_frame_rate"}
    return _probes(spark, sf).select(
        "video_id",
        *[F.round(video_functions.frame_rate(F.col(c)), 6).alias(a) for a, c in rates.items()],
    )


@query("vfr_flag", "select video_id, is_vfr from judged", ("judged",))
def vfr_flag(spark, sf):
    flag = video_functions.is_vfr(F.col("r_frame_rate"), F.col("avg_frame_rate"))
    return _probes(spark, sf).select("video_id", flag.alias("is_vfr"))


@query("min_frames", "select video_id, is_short from judged", ("judged",))
def min_frames(spark, sf):
    return _probes(spark, sf).select(
        "video_id", video_functions.is_too_short(F.col("nb_frames")).alias("is_short")
    )


@query(
    "codec_supported",
    "select video_id, codec from video_probe where codec in "
    "('h264', 'avc1', 'hevc', 'hev1', 'h265', 'vp09', 'vp9')",
    ("video_probe",),
)
def codec_supported(spark, sf):
    usable = video_functions.is_supported_codec(F.col("codec"))
    return _probes(spark, sf).filter(usable).select("video_id", "codec")


@query("video_verdict", "select video_id, verdict from judged", ("judged",))
def video_verdict(spark, sf):
    return video.judge(_probes(spark, sf)).select("video_id", "verdict")


@query("video_eligible", "select video_id, codec from judged where verdict = 'ok'", ("judged",))
def video_eligible(spark, sf):
    return video.eligible(_probes(spark, sf)).select("video_id", "codec")


@query(
    "video_excluded_counts",
    "select verdict, count(*) as num_files from judged where verdict <> 'ok' group by verdict",
    ("judged",),
)
def video_excluded_counts(spark, sf):
    return video.excluded_counts(_probes(spark, sf))


_GROUPS_SQL = "select codec, count(*) as num_files from video_probe where codec is not null group by codec"


@query("codec_groups", _GROUPS_SQL, ("video_probe",))
def codec_groups(spark, sf):
    return video.codec_groups(_probes(spark, sf))


@query(
    "codec_diagnostics",
    f"""select codec, num_files,
               case when codec in ('h264', 'avc1', 'hevc', 'hev1', 'h265', 'vp09', 'vp9') then 'OK' else 'SKIP' end as status,
               case when codec not in ('h264', 'avc1', 'hevc', 'hev1', 'h265', 'vp09', 'vp9') then 'UNSUPPORTED_CODEC' end as reason
        from ({_GROUPS_SQL})""",
    ("video_probe",),
)
def codec_diagnostics(spark, sf):
    return video.codec_diagnostics(_probes(spark, sf))


@query(
    "split_complement",
    "select video_id, case when verdict = 'ok' then 'good' else 'bad' end as side from judged",
    ("judged",),
)
def split_complement(spark, sf):
    good, bad = inventory.split(video.judge(_probes(spark, sf)), F.col("verdict") == "ok")
    sides = [rows.select("video_id", F.lit(s).alias("side")) for rows, s in ((good, "good"), (bad, "bad"))]
    return sides[0].unionByName(sides[1])


def _bad_sets(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Overlapping sets of rejected videos, one per rule."""
    probes = _probes(spark, sf)
    rules = (
        F.col("codec").isNull(),
        video_functions.is_vfr(F.col("r_frame_rate"), F.col("avg_frame_rate")),
        video_functions.is_too_short(F.col("nb_frames")),
    )
    return [probes.filter(rule).select("video_id") for rule in rules]


def _bad_union(spark: SparkSession, sf: str) -> DataFrame:
    first, *others = _bad_sets(spark, sf)
    for other in others:
        first = first.union(other)
    return first.distinct()


@query(
    "union_distinct",
    """select video_id from judged where codec is null union
       select video_id from judged where is_vfr union
       select video_id from judged where is_short""",
    ("judged",),
)
def union_distinct(spark, sf):
    return _bad_union(spark, sf)


@query(
    "join_anti_bad",
    """select video_id, codec from judged
       where not (codec is null or is_vfr or is_short)""",
    ("judged",),
)
def join_anti_bad(spark, sf):
    return _probes(spark, sf).join(_bad_union(spark, sf), "video_id", "left_anti").select("video_id", "codec")


@query(
    "join_semi",
    "select video_id, codec from video_probe where codec in "
    "('h264', 'avc1', 'hevc', 'hev1', 'h265', 'vp09', 'vp9')",
    ("video_probe",),
)
def join_semi(spark, sf):
    probes = _probes(spark, sf)
    usable = video.codec_diagnostics(probes).filter(F.col("status") == "OK").select("codec")
    return probes.join(broadcast_if_small(usable), "codec", "left_semi").select("video_id", "codec")


# ------------------------------------------------------------------ batch functions


def _video_batches(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Videos in batches by path, with what is known of them."""
    files = inventory.classify(views.view(spark, sf, views.ASSETS)).filter(F.col("ext") == "mp4")
    batches = batching.batch_assign(
        files.select("path", "asset_id"), [], ["path", "asset_id"], size
    )
    probes = _probes(spark, sf).select(F.col("video_id").alias("asset_id"), "codec")
    return batches.join(probes, "asset_id")


def _open_all(batch: pd.DataFrame) -> None:
    """Fails like a batch decoder does: one unopenable video spoils the batch."""
    bad = int(batch["codec"].isna().sum())
    if bad:
        raise ValueError(f"{bad} of {len(batch)} videos cannot be opened")


_SPOILED_SQL = """
    select (row_number() over (order by f.path, f.asset_id) - 1) // {size} as batch_id, f.path, f.asset_id, v.codec
    from files f join video_probe v on f.ext = 'mp4' and v.video_id = f.asset_id
"""


@query(
    "batch_apply_timed",
    f"""select batch_id, count(*) as n_files, count(*) = count(codec) as timed,
               case when count(*) > count(codec)
                    then (count(*) - count(codec)) || ' of ' || count(*) || ' videos cannot be opened' end as error
        from ({_SPOILED_SQL.format(size=8)}) group by batch_id""",
    ("files", "video_probe"),
)
def batch_apply_timed(spark, sf):
    timed = isolate.batch_apply_timed(_video_batches(spark, sf, 8), ["batch_id"], _open_all)
    return timed.select("batch_id", "n_files", F.col("elapsed_sec").isNotNull().alias("timed"), "error")


def _open_videos(batch: pd.DataFrame) -> None:
    """Opens the videos of a batch; files of other types need no opening."""
    if batch["file_type"].iloc[0] == "mp4":
        _open_all(batch)


@query(
    "time_engines",
    """select file_type, cast(sum(n) as bigint) as num_files, count(*) as baseline_batches,
              count(*) as accel_batches, cast(0 as bigint) as baseline_errors, count(*) filter (bad) as accel_errors,
              cast(sum(n) as bigint) as baseline_ok_files,
              cast(coalesce(sum(n) filter (not bad), 0) as bigint) as accel_ok_files
       from (select file_type, codec, batch_id, count(*) as n, file_type = 'mp4' and codec is null as bad
             from (select f.ext as file_type, v.codec,
                          (row_number() over (partition by f.ext, v.codec order by f.path, f.asset_id) - 1) // 8 as batch_id
                   from files f left join video_probe v on f.ext = 'mp4' and v.video_id = f.asset_id
                   where f.ext is not null)
             group by file_type, codec, batch_id) group by file_type""",
    ("files", "video_probe"),
)
def time_engines(spark, sf):
    found = with_codec(spark, sf).select(F.col("ext").alias("file_type"), "path", "asset_id", "codec")
    batches = batching.batch_assign(found, ["file_type", "codec"], ["path", "asset_id"], 8)
    timings = isolate.time_engines(batches, {"baseline": lambda batch: len(batch), "accel": _open_videos})
    return report.bench_by_type(timings).drop("baseline_sec", "accel_sec")


@query(
    "isolate_bad",
    f"""select asset_id, path, codec is not null as ok,
              case when codec is null then '1 of 1 videos cannot be opened' end as error,
              count(codec) over (partition by batch_id) > 0 as good_files_timed
       from ({_SPOILED_SQL.format(size=50)})""",
    ("files", "video_probe"),
)
def isolate_bad(spark, sf):
    batches = _video_batches(spark, sf, 50)
    found = isolate.isolate_bad(batches, ["batch_id"], ["asset_id", "path"], _open_all)
    return found.withColumn("good_files_timed", F.col("good_sec").isNotNull()).drop("good_sec")


@query(
    "append_failure_log",
    f"""select unnest(['first', 'second']) as run_id, batch_id, path, asset_id
        from (select *, count(*) filter (codec is null) over (partition by batch_id) as bad
              from ({_SPOILED_SQL.format(size=8)}))
        where bad > 0""",
    ("files", "video_probe"),
)
def append_failure_log(spark, sf):
    batches, log = _video_batches(spark, sf, 8), new_path(spark, "failures")
    outcome = isolate.batch_apply_timed(batches, ["batch_id"], _open_all)
    failed = outcome.filter(F.col("error").isNotNull()).select("batch_id")
    rows = stage(batches.join(failed, "batch_id", "left_semi").select("batch_id", "path", "asset_id"))
    for run in ("first", "second", "second"):  # a repeated run is logged once
        reports.append_failure_log(rows, log, run)
    return reports.read_failure_log(spark, log)


# ------------------------------------------------------------------ texts and JSON


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.TEXTS)


@query(
    "read_text_whole",
    """select doc_id, length(t) as chars, md5(t) as text_md5 from
         (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from documents)""",
)
def read_text_whole(spark, sf):
    content_bytes = F.col("text").cast("binary")
    broken = F.concat(F.unhex(F.lit("FF")), content_bytes, F.unhex(F.lit("C3")))  # no valid UTF-8
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, broken).otherwise(content_bytes).alias("content")
    )
    text = docs.select("doc_id", decode_text(F.col("content")).alias("t"))
    return text.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    "text_total_chars",
    "select ext, cast(sum(length(text)) as bigint) as total_chars from texts group by ext",
    ("texts",),
)
def text_total_chars(spark, sf):
    return content.text_totals(_texts(spark, sf), "ext").select("ext", "total_chars")


@query(
    "text_total_bytes",
    "select ext, cast(sum(strlen(text)) as bigint) as total_bytes from texts group by ext",
    ("texts",),
)
def text_total_bytes(spark, sf):
    return content.text_totals(_texts(spark, sf), "ext").select("ext", "total_bytes")


@query(
    "text_contains_count",
    "select ext, count(*) filter (contains(text, 'the')) as files_with_word from texts group by ext",
    ("texts",),
)
def text_contains_count(spark, sf):
    return content.text_totals(_texts(spark, sf), "ext").select("ext", "files_with_word")


@query(
    "text_batch_stats",
    """select ext, batch_id, count(*) as num_files, cast(sum(length(text)) as bigint) as total_chars,
              count(*) filter (contains(text, 'the')) as files_with_word
       from (select *, (row_number() over (partition by ext order by path, asset_id) - 1) // 200 as batch_id from texts)
       group by ext, batch_id""",
    ("texts",),
)
def text_batch_stats(spark, sf):
    return content.text_batch_stats(_texts(spark, sf))


@query(
    "read_json_doc",
    """select 'props' as kind, event_id as doc_key, props ->> '$.k' as value from events
       union all select 'turn', conv_id * 1000 + turn, role from conversations
       union all select 'text', doc_id, case when json_valid(text) then text ->> '$.k' end from documents""",
)
def read_json_doc(spark, sf):
    parsed = content.parse_json(views.json_docs(spark, sf))
    return parsed.select(
        "kind",
        "doc_key",
        F.coalesce(
            F.try_variant_get("doc", "$.k", "string"), F.try_variant_get("doc", "$.role", "string")
        ).alias("value"),
    )


@query(
    "json_valid_counts",
    """select kind, count(*) filter (valid) as valid_docs, count(*) filter (not valid) as invalid_docs from
         (select 'props' as kind, json_valid(props) as valid from events
          union all select 'turn', true from conversations
          union all select 'text', json_valid(text) from documents) group by kind""",
)
def json_valid_counts(spark, sf):
    return content.json_validity(views.json_docs(spark, sf), "kind")


@query(
    "json_field_stats",
    """select event_type, count(k) as docs, cast(sum(k) as bigint) as total, min(k) as least, max(k) as greatest from
         (select event_type, cast(props ->> '$.k' as bigint) as k from events) group by event_type""",
)
def json_field_stats(spark, sf):
    docs = views.table(spark, sf, "events").select("event_type", F.col("props").alias("text"))
    k = F.try_variant_get("doc", "$.k", "long")
    return (
        content.parse_json(docs)
        .groupBy("event_type")
        .agg(
            F.count(k).alias("docs"),
            F.sum(k).alias("total"),
            F.min(k).alias("least"),
            F.max(k).alias("greatest"),
        )
    )


# ------------------------------------------------------------------ waveforms

_ENERGY = "list_sum(list_transform(samples, lambda x: x::double * x::double))"


@query(
    "signal_mean_abs",
    """select clip_id, round(list_sum(list_transform(samples, lambda x: abs(x::double))) / len(samples), 6) as mean_abs
       from signals""",
    ("signals",),
)
def signal_mean_abs(spark, sf):
    wave = F.col("waveform")
    return views.signals(spark, sf).select(
        "clip_id", F.round(signal_functions.mean_abs(wave), 6).alias("mean_abs")
    )


@query(
    "signal_l2",
    f"""select clip_id, round(sqrt({_ENERGY}), 6) as l2,
          round(sqrt(list_sum(list_transform(list_slice(samples, 1, 32 * channels),
                                             lambda x: x::double * x::double))), 6) as l2_first_32
        from signals""",
    ("signals",),
)
def signal_l2(spark, sf):
    wave = F.col("waveform")
    return views.signals(spark, sf).select(
        "clip_id",
        F.round(signal_functions.l2_norm(wave), 6).alias("l2"),
        F.round(signal_functions.l2_norm(wave, 32), 6).alias("l2_first_32"),
    )


@query(
    "signal_rms",
    f"select clip_id, round(sqrt({_ENERGY} / len(samples)), 6) as rms from signals",
    ("signals",),
)
def signal_rms(spark, sf):
    return views.signals(spark, sf).select(
        "clip_id", F.round(signal_functions.rms(F.col("waveform")), 6).alias("rms")
    )


_SHAPE_SQL = """
    select batch_id, count(*) as num_clips, cast(max(channels) as integer) as max_channels,
           cast(max((len(samples) + channels - 1) // channels) as integer) as max_length
    from signals group by batch_id
"""


@query("signal_batch_shape", _SHAPE_SQL, ("signals",))
def signal_batch_shape(spark, sf):
    return content.signal_batch_shape(views.signals(spark, sf))


@query(
    "signal_pad",
    f"""select s.clip_id, b.max_channels as num_channels, b.max_length as length,
               round(list_sum(list_transform(s.samples, lambda x: x::double)), 6) as total
        from signals s join ({_SHAPE_SQL}) b on s.batch_id = b.batch_id""",
    ("signals",),
)
def signal_pad(spark, sf):
    padded = content.signal_pad(views.signals(spark, sf))
    total = F.aggregate(F.flatten("waveform"), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return padded.select(
        "clip_id",
        F.size("waveform").alias("num_channels"),
        F.array_min(F.transform("waveform", F.size)).alias("length"),
        F.round(total, 6).alias("total"),
    )


# Samples of the first channel, frames of 16 every 4 samples around them, ends mirrored.
@query(
    "signal_spectrum",
    """with ch as (select clip_id, list_filter(samples, lambda x, i: (i - 1) % channels = 0) as s from signals),
         clip as (select clip_id, s, len(s) as n from ch where len(s) > 8),
         frame as (select clip_id, s, n, unnest(range(0, n + 1, 4)) as start from clip),
         point as (select clip_id, start, j,
                     s[1 + case when start + j < 8 then 8 - start - j
                                when start + j - 8 >= n then 2 * (n - 1) - (start + j - 8)
                                else start + j - 8 end]::double as x
                   from (select *, unnest(range(16)) as j from frame)),
         wave as (select clip_id, start, bin, sum(x * cos(2 * pi() * bin * j / 16)) as re,
                         sum(x * sin(2 * pi() * bin * j / 16)) as im
                  from (select *, unnest(range(9)) as bin from point) group by clip_id, start, bin)
       select clip_id, cast(bin as integer) as bin, round(avg(re * re + im * im), 6) as power from wave group by clip_id, bin
       union all select clip_id, null, null from ch where len(s) <= 8""",
    ("signals",),
)
def signal_spectrum(spark, sf):
    # Clips are short here, so the window is too.
    power = signal_functions.spectrum(F.element_at("waveform", 1), 16)
    bins = views.signals(spark, sf).select("clip_id", F.posexplode_outer(power).alias("bin", "power"))
    return bins.withColumn("power", F.round("power", 6))


# ------------------------------------------------------------------ by type


@query(
    "processor_registry",
    f"""select 'mp4' as file_type, count(*) as items, round(count(*) filter (verdict = 'ok'), 4) as measure from judged
        union all select 'wav', count(*), round(sum(sqrt({_ENERGY})), 4) from signals
        union all select ext, count(*), sum(length(text)) from texts group by ext
        union all select 'xlsx', count(distinct source_id), count(*) from sheets""",
    ("judged", "signals", "texts", "sheets"),
)
def processor_registry(spark, sf):
    texts = _texts(spark, sf)
    sheets = views.sheet_layouts(spark, sf)
    rows = sheets[0].unionByName(sheets[1], allowMissingColumns=True)
    work = {
        "mp4": (_probes(spark, sf), F.count_if(F.col("verdict") == "ok")),
        "wav": (views.signals(spark, sf), F.sum("l2")),
        "txt": (texts.filter(F.col("ext") == "txt"), F.sum("chars")),
        "json": (texts.filter(F.col("ext") == "json"), F.sum("chars")),
        "xlsx": (rows, F.sum("num_rows")),
    }
    result = None
    for ext, (source, measure) in work.items():
        row = (
            processor_for(ext)(source)
            .agg(F.count("*").alias("items"), F.round(measure.cast("double"), 4).alias("measure"))
            .select(F.lit(ext).alias("file_type"), "items", "measure")
        )
        result = row if result is None else result.unionByName(row)
    return result


# ------------------------------------------------------------------ the whole run

# A file of each row: texts, turns (some cut short), clips, customers as one-row sheets, probes.
_RUN_SQL = """
    select 'txt' as file_type, '/in/' || lpad(cast(doc_id as varchar), 12, '0') || '.txt' as path, null as codec,
           'ok' as verdict, false as broken from documents
    union all select 'json', '/in/' || lpad(cast(conv_id * 1000 + turn as varchar), 15, '0') || '.json', null, 'ok',
           (conv_id * 1000 + turn) % 97 = 0 from conversations
    union all select 'wav', '/in/' || lpad(cast(vec_id as varchar), 12, '0') || '.wav', null, 'ok', vec_id % 89 = 0 from embeddings
    union all select 'xlsx', '/in/' || lpad(cast(c_custkey as varchar), 12, '0') || '.xlsx', null, 'ok', false from customer
    union all select 'mp4', '/in/' || lpad(cast(video_id as varchar), 12, '0') || '.mp4', codec, verdict, false from judged
"""


def _wav_bytes(batches):
    """A vector as a 16-bit clip; some are cut within the header."""
    for batch in batches:
        contents = []
        for number, vector in zip(batch["vec_id"], batch["embedding"]):
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as clip:
                clip.setnchannels(1)
                clip.setsampwidth(2)
                clip.setframerate(8000)
                samples = np.clip(np.asarray(vector, "f8"), -1, 1) * 32767
                clip.writeframes(samples.astype("<i2").tobytes())
            whole = buffer.getvalue()
            contents.append(whole[:20] if number % 89 == 0 else whole)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "content": contents})


def _run_files(spark: SparkSession, sf: str) -> DataFrame:
    def files(ext: str, number, content, width=12, codec=None, verdict=None):
        path = F.concat(F.lit("/in/"), F.lpad(number.cast("string"), width, "0"), F.lit(f".{ext}"))
        return [
            F.lit(ext).alias("file_type"),
            path.alias("path"),
            (F.lit(None) if codec is None else codec).cast("string").alias("codec"),
            (F.lit("ok") if verdict is None else verdict).alias("verdict"),
            content.cast("binary").alias("content"),
        ]

    texts = views.table(spark, sf, "documents").select(*files("txt", F.col("doc_id"), F.col("text")))
    key = F.col("conv_id") * 1000 + F.col("turn")
    doc = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    cut = F.when(key % 97 == 0, F.lit('{"conv_id":')).otherwise(doc)
    turns = views.table(spark, sf, "conversations").select(*files("json", key, cut, 15))
    clips = views.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(
        _wav_bytes, "vec_id long, content binary"
    )
    waves = clips.select(*files("wav", F.col("vec_id"), F.col("content")))
    line = F.concat(F.lit("key,name\n"), F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit("\n"))
    sheets = views.table(spark, sf, "customer").select(*files("xlsx", F.col("c_custkey"), line))
    probe = F.to_json(F.struct("codec", "nb_frames"))
    probes = video.judge(views.view(spark, sf, views.VIDEO_PROBE))
    videos = probes.select(*files("mp4", F.col("video_id"), probe, codec=F.col("codec"), verdict=F.col("verdict")))
    return reduce(DataFrame.unionByName, [texts, turns, waves, sheets, videos])


@query(
    "pipeline_report",
    f"""with run as ({_RUN_SQL}),
        batches as (
          select file_type, ok, codec, batch_id, count(*) as n, count(*) filter (broken) > 0 as bad from (
            select *, (row_number() over (partition by file_type, ok, codec order by path) - 1) // 200 as batch_id from (
              select file_type, path, broken, verdict = 'ok' as ok, case when verdict = 'ok' then codec end as codec from run))
          group by file_type, ok, codec, batch_id)
        select file_type, cast(sum(n) as bigint) as num_files, count(*) filter (bad) as baseline_errors,
               count(*) filter (bad and ok) as accel_errors,
               cast(coalesce(sum(n) filter (not ok), 0) as bigint) as accel_excluded,
               cast(coalesce(sum(n) filter (bad), 0) + coalesce(sum(n) filter (bad and ok), 0) as bigint) as logged
        from batches group by file_type""",
    ("judged",),
)
def pipeline_report(spark, sf):
    log = new_path(spark, "failures")
    measured = pipeline.measure_collection(_run_files(spark, sf), log)
    logged = reports.read_failure_log(spark, log).groupBy("file_type").agg(F.count("*").alias("logged"))
    return (
        measured.select("file_type", "num_files", "baseline_errors", "accel_errors", "accel_excluded")
        .join(logged, "file_type", "left")
        .fillna(0, subset=["logged"])
    )
