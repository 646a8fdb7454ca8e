"""Registry of the media queries: for each name the Spark callable and the same in DuckDB's SQL (None if SQL can't express it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..operators import anomalies, audio, frames, images, macroblocks, metadata, packets, sync, timeline
from ..sinks import report, tables
from ..streaming import live
from . import adapter
from .scratch import scratch_folder

# --- DuckDB views that mirror the adapter ---

_PACKETS = """
with b as (select event_id, case when user_id % 4 = 0 then 0 else user_id end as media_id, event_type, value, epoch_us(ts) - 1704067200000000 as us, cast(props->>'$.k' as int) as k from events),
kinds as (select *, case when event_type in ('click','view') then 0 when event_type in ('signup','purchase') then 1 else 2 end as kind from b),
numbers as (select *, case when kind = 0 then media_id % 2 when kind = 1 and event_type = 'purchase' and media_id % 3 = 0 then 3 when kind = 1 then 1 - media_id % 2 when k = 5 then 9 else 2 end as number,
    case when k < 3 then null when k = 7 then us // 72000 - 9000 else us // 72000 end as p, case when k = 2 then us // 72000 end as d from kinds),
packets as (select cast(media_id as bigint) as media_id, event_id as idx, k, cast(number as int) as stream_index, cast(case when number = 9 then -1 else kind end as int) as stream_type, cast(p as bigint) as pts, cast(d as bigint) as dts,
    cast(round(value * 100) as int) + 1 as size,
    cast((case when k % 12 = 0 then 1 else 0 end) + (case when k % 33 = 0 then 2 else 0 end) as int) as flags,
    coalesce(p, d) / 90000e0 as ts from numbers)"""
_FRAMES = _PACKETS + """,
video as (select media_id, cast(row_number() over (partition by media_id order by idx) - 1 as bigint) as fidx, idx as arrival, flags % 2 = 1 as is_key,
    cast(case when flags % 2 = 1 then 1 when k % 3 = 1 then 2 when k % 3 = 2 then 3 else 0 end as int) as frame_type, pts, ts, stream_index, case when k % 29 = 5 then 0 else 640 end as width, 480 as height from packets where stream_type = 0),
audio as (select media_id, cast(row_number() over (partition by media_id order by idx) - 1 as bigint) as fidx, idx as arrival, pts, ts, size as sample_count, 48000 as sample_rate, 2 as channels, size * 4 as byte_count, stream_index from packets where stream_type = 1),
gops as (select *, cast(1 + sum(case when is_key and fidx > 0 then 1 else 0 end) over (partition by media_id order by fidx rows unbounded preceding) as bigint) as gop_index from video),
gop_frames as (select *, row_number() over (partition by media_id, gop_index order by fidx) as gop_position from gops)"""
_EVENTS = _FRAMES + """,
miss as (select * from (select media_id, stream_index, idx, pts, ts, 'missing_timestamp' as type, row_number() over (partition by media_id, stream_index order by idx) as n from packets where ts is null) where n = 1),
steps as (select *, ts - lag(ts) over (partition by media_id, stream_index order by idx) as delta from packets where ts is not null),
jumps as (select media_id, stream_index, idx, pts, ts, case when delta < -0.001 then 'timestamp_back' else 'timestamp_jump' end as type, delta from steps where delta < -0.001 or delta > 2.0),
amiss as (select * from (select media_id, stream_index, arrival as idx, pts, ts, 'audio_missing_pts' as type, row_number() over (partition by media_id, stream_index order by arrival) as n from audio where pts is null) where n = 1),
alle as (select media_id, stream_index, idx, pts, ts, type, case when type = 'missing_timestamp' then 0 else 1 end as r from (select media_id, stream_index, idx, pts, ts, type from miss union all select media_id, stream_index, idx, pts, ts, type from jumps)
    union all select media_id, stream_index, idx, pts, ts, type, 2 as r from amiss union all select media_id, stream_index, arrival as idx, pts, ts, 'invalid_video_frame' as type, 3 as r from video where width <= 0 or height <= 0),
events_log as (select media_id, row_number() over (partition by media_id order by idx, r) - 1 as event_idx, case when type in ('timestamp_back', 'invalid_video_frame') then 'error' else 'warning' end as severity, type, stream_index, pts, ts, idx as packet_idx from alle)"""
_SECONDS = _PACKETS + """,
seconds as (select media_id, cast(floor(ts) as bigint) as second, cast(sum(cast(size as bigint) * 8) as bigint) as bps, count(*) as packets, count(*) filter (where stream_type = 0) as video_fps from packets where ts is not null group by 1, 2)"""
_SYNC = _PACKETS + """,
av as (select *, last_value(case when stream_type = 1 then ts end ignore nulls) over w as audio_ts, last_value(case when stream_type = 0 then ts end ignore nulls) over w as video_ts
    from packets where stream_type in (0, 1) and ts is not null window w as (partition by media_id order by idx rows unbounded preceding)),
samples as (select media_id, row_number() over (partition by media_id order by idx) - 1 as sync_idx, audio_ts, video_ts, (audio_ts - video_ts) * 1000 as diff_ms, stream_type = 1 as audio_anchor from av where audio_ts is not null and video_ts is not null)"""
_TIMELINE = _EVENTS + """,
entries as (select media_id, arrival as ord, 1 as r, 0 as n, 'video_key' as category, ts, '#' || fidx as label from video where is_key
    union all select media_id, arrival, 1, 0, 'audio_sample', ts, '#' || fidx from audio where (fidx + 1) % 20 = 0
    union all select media_id, packet_idx, 0, event_idx, 'event', ts, type from events_log),
line as (select media_id, row_number() over (partition by media_id order by ord, r, n) - 1 as timeline_idx, category, ts, label from entries where ts is not null)"""
_SOUND = """
with sound as (select cast(vec_id % 8 as bigint) as media_id, cast(vec_id as bigint) as idx, vec_id / 50e0 as ts, 48000 as sample_rate, 1 as channels,
    list_transform(embedding, lambda x: cast(least(greatest(floor(cast(x as double) * 32768), -32768), 32767) as int)) as samples from embeddings),
levels as (select media_id, idx, ts, least(sqrt(list_sum(list_transform(samples, lambda x: cast(x as double) * x)) / len(samples)) / 32768, 1.0) as level, sample_rate, channels, list_transform(samples, lambda x: x / 32768e0) as mono from sound),
waves as (select media_id, idx, ts, list_transform(range(0, least(128, len(mono))), lambda i: least(greatest(mono[(i * len(mono)) // least(128, len(mono)) + 1], -1e0), 1e0)) as waveform from levels)"""
_IMAGES = """
with images as (select cast(vec_id % 8 as bigint) as media_id, cast(vec_id as bigint) as idx, list_transform(embedding, lambda x: cast(floor((cast(x as double) + 1) * 127.5) as int)) as pixels from embeddings)"""


# --- shared inputs ---


def _p(spark, d):
    return adapter.packets(spark, d)


def _video(spark, d):
    return frames.numbered(adapter.video_arrivals(_p(spark, d)))


def _audio(spark, d):
    return frames.numbered(adapter.audio_arrivals(_p(spark, d)))


def _gops(spark, d):
    return frames.assign_gops(_video(spark, d))


def _events(spark, d):
    p = _p(spark, d)
    return anomalies.event_log(p, adapter.audio_arrivals(p), adapter.video_arrivals(p))


def _samples(spark, d):
    return sync.pair(_p(spark, d))


def _line(spark, d):
    return timeline.timeline(_video(spark, d), _audio(spark, d), _events(spark, d))


def _sound(spark, d):
    return adapter.audio_samples(spark, d)


def _viz(spark, d):
    return audio.visualization(_sound(spark, d))


def _round_array(c, n=9):
    return F.transform(c, lambda x: F.round(x, n))


QUERIES: dict = {}


def query(sql=None):
    """Registers a callable under its name."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# --- packets ---


@query(_PACKETS + " select media_id, idx, stream_index, stream_type, pts, size, flags, case when stream_type >= 0 then ts end as ts from packets")
def packet_normalize(spark, d):
    return packets.normalize(_p(spark, d).drop("ts", "stream_type"), adapter.streams(spark, d)).select("media_id", "idx", "stream_index", "stream_type", "pts", "size", "flags", "ts")


@query(_PACKETS + """ select media_id, count(*) as total_packets, cast(sum(size) as bigint) as total_bytes, count(*) filter (where stream_type = 0) as video_packets, count(*) filter (where stream_type = 1) as audio_packets,
    max(size) as max_packet_size, min(size) as min_packet_size, cast(sum(size) // count(*) as bigint) as avg_packet_size, count(*) filter (where flags % 2 = 1) as key_frame_count, max(ts) - min(ts) as duration_seconds from packets group by media_id""")
def packet_stats(spark, d):
    return packets.stats(_p(spark, d))


@query(_PACKETS + " select media_id, stream_index, count(*) as packets, cast(sum(size) as bigint) as bytes from packets group by 1, 2")
def packet_stats_per_stream(spark, d):
    return packets.stats_per_stream(_p(spark, d))


@query(_PACKETS + """ select media_id, string_agg(stream_index || '=' || n, ',' order by stream_index) as packets_per_stream, string_agg(stream_index || '=' || b, ',' order by stream_index) as bytes_per_stream
    from (select media_id, stream_index, count(*) as n, cast(sum(size) as bigint) as b from packets group by 1, 2) group by 1""")
def packet_stats_maps(spark, d):
    text = lambda c: F.concat_ws(",", F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))).alias(c)
    return packets.stats_maps(_p(spark, d)).select("media_id", text("packets_per_stream"), text("bytes_per_stream"))


@query(_PACKETS + " select media_id, count(*) as total, count(*) filter (where stream_type = 0) as video, count(*) filter (where stream_type = 1) as audio, count(*) filter (where stream_type not in (0, 1)) as other from packets group by 1")
def packet_summary(spark, d):
    return packets.summary(_p(spark, d))


@query(_PACKETS + """ select media_id, idx, flags, coalesce(nullif(concat_ws('|', case when flags & 1 <> 0 then 'KEY' end, case when flags & 2 <> 0 then 'CORRUPT' end, case when flags & 4 <> 0 then 'DISCARD' end,
    case when flags & 8 <> 0 then 'TRUSTED' end, case when flags & 16 <> 0 then 'DISPOSABLE' end), ''), '-') as flag_text from packets""")
def packet_flag_labels(spark, d):
    return _p(spark, d).select("media_id", "idx", "flags", fmt.flag_text(F.col("flags")).alias("flag_text"))


@query(_PACKETS + " select media_id, idx, stream_index, pts, size, flags from packets qualify row_number() over (partition by media_id order by idx desc) <= 100")
def packet_last_n(spark, d):
    return packets.last_n(_p(spark, d)).select("media_id", "idx", "stream_index", "pts", "size", "flags")


@query(_SECONDS + " select media_id, second, bps, packets, video_fps from seconds")
def bitrate_1s(spark, d):
    return packets.per_second(_p(spark, d))


@query(_SECONDS + """ select media_id, second, bps, cast(sum(bps) over (partition by media_id order by second rows 299 preceding) // count(*) over (partition by media_id order by second rows 299 preceding) as bigint) as avg_bps,
    max(bps) over (partition by media_id order by second rows unbounded preceding) as peak_bps from seconds""")
def bitrate_history(spark, d):
    return packets.rate_history(packets.per_second(_p(spark, d))).select("media_id", "second", "bps", "avg_bps", "peak_bps")


@query(_SECONDS + " select media_id, second, video_fps, round(avg(video_fps) over (partition by media_id order by second rows 299 preceding), 9) as avg_fps from seconds")
def fps_1s(spark, d):
    return packets.fps_history(packets.per_second(_p(spark, d)))


@query(_SECONDS + " select media_id, second, cast(sum(bps) over w as bigint) as cumulative_bps, cast(sum(packets) over w as bigint) as cumulative_packets from seconds window w as (partition by media_id order by second rows unbounded preceding)")
def bitrate_cumulative_compat(spark, d):
    return packets.cumulative_bitrate(packets.per_second(_p(spark, d)))


@query(_PACKETS + """, r as (select media_id, sum(flags % 2) over (partition by media_id order by idx rows unbounded preceding) as run from packets),
    n as (select media_id, run, count(*) as n, max(run) over (partition by media_id) as last from r group by 1, 2)
    select media_id, coalesce(max(n) filter (where run = last - 1), 0) as gop_size, coalesce(max(n) filter (where run < last), 0) as max_gop_size, max(n) filter (where run = last) as current_gop_size from n group by 1""")
def gop_mixed_compat(spark, d):
    return packets.mixed_gops(_p(spark, d))


@query(_PACKETS + """, t as (select media_id, cast(unnest([0.5, 2.5, 100.0, 10000.0]) as double) as target from (select distinct media_id from packets)),
    k as (select media_id, idx, ts from packets where flags % 2 = 1 and ts is not null)
    select t.media_id, t.target, max(k.ts) as seek_ts, arg_max(k.idx, (k.ts, k.idx)) as seek_idx from t left join k on k.media_id = t.media_id and k.ts <= t.target group by 1, 2""")
def seek_keyframe(spark, d):
    p = _p(spark, d)
    targets = p.select("media_id").distinct().select("media_id", F.explode(F.array(*map(F.lit, (0.5, 2.5, 100.0, 10000.0)))).alias("target"))
    return packets.seek(p, targets)


@query(_PACKETS + " select media_id, idx, ts from packets where ts - 1.0 <= 30.0")
def play_range(spark, d):
    return packets.play_range(_p(spark, d), 1.0, 30.0).select("media_id", "idx", "ts")


@query("""with s as (select n_nationkey % 4 as media_id, n_nationkey as stream_index, n_regionkey % 3 as stream_type, n_nationkey = 3 as attached_pic, (n_nationkey * 7919) % 1000 as bit_rate from nation)
    select cast(media_id as bigint) as media_id, cast(stream_index as bigint) as stream_index, cast(stream_type as bigint) as stream_type, cast(bit_rate as bigint) as bit_rate from s where not attached_pic and stream_type in (0, 1)
    qualify row_number() over (partition by media_id, stream_type order by bit_rate desc, stream_index) = 1""")
def stream_select_best(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    s = n.select((F.col("k") % 4).alias("media_id"), F.col("k").alias("stream_index"), (F.col("r") % 3).alias("stream_type"), (F.col("k") == 3).alias("attached_pic"), (F.col("k") * 7919 % 1000).alias("bit_rate"))
    return packets.select_best(s).select("media_id", "stream_index", "stream_type", "bit_rate")


# --- anomalies ---


@query(_EVENTS + " select media_id, stream_index, idx, type from miss")
def anomaly_missing_ts(spark, d):
    return anomalies.missing_timestamps(_p(spark, d)).select("media_id", "stream_index", "idx", "type")


@query(_EVENTS + " select media_id, stream_index, idx, pts, ts, type, delta from jumps")
def anomaly_back_jump(spark, d):
    return anomalies.back_and_jump(_p(spark, d))


@query(_EVENTS + " select media_id, event_idx, severity, type, stream_index, pts, ts, packet_idx from events_log")
def analysis_events(spark, d):
    return _events(spark, d)


@query(_EVENTS + " select media_id, count(*) as total, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity not in ('error', 'warning')) as infos from events_log group by 1")
def event_summary(spark, d):
    return anomalies.event_summary(_events(spark, d))


# --- frames ---


@query(_FRAMES + " select media_id, fidx, arrival, is_key, frame_type, pts, ts from video")
def video_frames(spark, d):
    return _video(spark, d).select("media_id", "fidx", "arrival", "is_key", "frame_type", "pts", "ts")


@query(_FRAMES + " select media_id, fidx, pts, ts from video where frame_type = 1")
def frame_filter_i(spark, d):
    return frames.matching(_video(spark, d), "i").select("media_id", "fidx", "pts", "ts")


@query(_FRAMES + " select media_id, fidx, pts, ts from video where is_key")
def frame_filter_key(spark, d):
    return frames.matching(_video(spark, d), "key").select("media_id", "fidx", "pts", "ts")


@query(_FRAMES + " select media_id, fidx, is_key, gop_index, gop_position from gop_frames")
def gop_assign(spark, d):
    return _gops(spark, d).select("media_id", "fidx", "is_key", "gop_index", "gop_position")


@query(_FRAMES + """ select media_id, gop_index, min(fidx) as start_frame, max(fidx) as end_frame, first(ts order by fidx) as start_ts, last(ts order by fidx) as end_ts, count(*) as total_frames, count(*) filter (where frame_type = 1) as i_count,
    count(*) filter (where frame_type = 2) as p_count, count(*) filter (where frame_type = 3) as b_count, count(*) filter (where is_key) as key_count from gop_frames group by 1, 2""")
def gop_summary(spark, d):
    return frames.gop_summary(_gops(spark, d))


@query(_FRAMES + """ select media_id, count(*) as total, count(*) filter (where frame_type = 1) as visible, count(*) filter (where is_key) as key_frames, max(gop_index) as gops, count(*) filter (where frame_type = 1) as i_frames, count(*) filter (where frame_type = 2) as p_frames,
    count(*) filter (where frame_type = 3) as b_frames, count(*) filter (where frame_type not in (1, 2, 3)) as other_frames from gop_frames group by 1""")
def frame_summary(spark, d):
    return frames.frame_summary(_gops(spark, d), "i")


@query(_FRAMES + " select media_id, fidx, pts from video where fidx % 10 = 9")
def frame_sample_every_10(spark, d):
    return frames.every_nth(_video(spark, d), 10, 9).select("media_id", "fidx", "pts")


@query(_FRAMES + " select media_id, fidx, last_value(case when d > 0 and d < 10 then d end ignore nulls) over (partition by media_id order by fidx rows unbounded preceding) as duration from (select *, ts - lag(ts) over (partition by media_id order by fidx) as d from video)")
def frame_nominal_duration(spark, d):
    return frames.nominal_duration(_video(spark, d)).select("media_id", "fidx", "duration")


@query("select o_orderkey, cast(ceil((case when o_custkey % 3 = 0 and o_custkey > 0 then o_custkey else floor((o_orderkey % 977) * 29.97e0 + 0.5) end) / 25e0) as bigint) as frames from orders")
def export_frame_count(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(0)
    return o.select("o_orderkey", frames.export_count(n, F.col("o_orderkey") % 977, F.lit(29.97), F.lit(25.0)).alias("frames"))


# --- sync and timeline ---


@query(_SYNC + " select media_id, sync_idx, audio_ts, video_ts, diff_ms, audio_anchor from samples")
def sync_samples(spark, d):
    return _samples(spark, d)


@query(_SYNC + " select media_id, count(*) as samples, round(avg(abs(diff_ms)), 6) as mean_abs_ms, round(max(abs(diff_ms)), 6) as max_abs_ms from samples group by 1")
def sync_summary(spark, d):
    return sync.summary(_samples(spark, d))


@query(_SYNC + """, f as (select media_id, list_reduce(list_prepend({'cum': 0e0, 'n': 0, 'd': 0e0}, list({'cum': 0e0, 'n': 0, 'd': diff_ms / 1000} order by sync_idx)),
    lambda a, v: case when abs(v.d) >= 10 then {'cum': 0e0, 'n': 0, 'd': 0e0} else {'cum': v.d + 0.7943282347e0 * a.cum, 'n': a.n + 1, 'd': 0e0} end) as s from samples group by 1)
    select media_id, case when s.n >= 20 then round(s.cum * (1 - 0.7943282347e0), 9) end as avg_diff, cast(s.n as bigint) as counted from f""")
def sync_running_average(spark, d):
    return sync.running_average(_samples(spark, d))


@query(_TIMELINE + " select media_id, timeline_idx, category, ts, label from line")
def timeline_entries(spark, d):
    return _line(spark, d)


@query(_TIMELINE + " select media_id, count(*) as total, count(*) filter (where category = 'video_key') as video_keys, count(*) filter (where category = 'audio_sample') as audio_samples, count(*) filter (where category = 'event') as events from line group by 1")
def timeline_summary(spark, d):
    return timeline.summary(_line(spark, d))


@query(_TIMELINE + " select media_id, timeline_idx, ts, case when category = 'video_key' then 3e0 when category = 'audio_sample' then 2e0 else 1e0 end as y from line qualify row_number() over (partition by media_id order by timeline_idx desc) <= 300")
def timeline_series(spark, d):
    return timeline.series(_line(spark, d))


@query(_SYNC + " select media_id, round(greatest(1.0, max(abs(diff_ms))) * 1.1e0, 9) as upper, -round(greatest(1.0, max(abs(diff_ms))) * 1.1e0, 9) as lower from samples group by 1")
def sync_axis_range(spark, d):
    return timeline.axis_range(_samples(spark, d), "diff_ms", True)


# --- audio ---


@query(_FRAMES + " select media_id, fidx, pts, ts, sample_count, sample_rate, channels, byte_count from audio")
def audio_frames(spark, d):
    return _audio(spark, d).select("media_id", "fidx", "pts", "ts", "sample_count", "sample_rate", "channels", "byte_count")


@query(_FRAMES + " select media_id, count(*) as frames, cast(sum(sample_count) as bigint) as samples, cast(sum(byte_count) as bigint) as bytes from audio group by 1")
def audio_summary(spark, d):
    return frames.audio_summary(_audio(spark, d))


@query(_SOUND + " select media_id, idx, round(level, 9) as level from levels")
def audio_rms(spark, d):
    return _sound(spark, d).select("media_id", "idx", F.round(audio.rms_level(F.col("samples")), 9).alias("level"))


@query(_SOUND + " select media_id, idx, list_transform(waveform, lambda x: round(x, 9)) as waveform from waves")
def audio_waveform(spark, d):
    return _sound(spark, d).select("media_id", "idx", _round_array(audio.waveform(audio.mono(F.col("samples"), F.col("channels")))).alias("waveform"))


_SPECTRUM = _SOUND + """, bins as (select media_id, idx, mono, len(mono) as n, b, least(len(mono) // 2 - 1, greatest(0, cast(floor(b / 32e0 * (len(mono) // 2 - 1)) as int))) as k from levels, range(0, 32) t(b)),
    parts as (select media_id, idx, b, n, list_sum(list_transform(range(0, n), lambda i: mono[i + 1] * cos(-2 * pi() * k * i / n))) as re, list_sum(list_transform(range(0, n), lambda i: mono[i + 1] * sin(-2 * pi() * k * i / n))) as im from bins),
    spectra as (select media_id, idx, b, sqrt(re * re + im * im) / n as value from parts)"""


@query(_SPECTRUM + " select media_id, idx, cast(b as int) as bin, round(value, 9) as value from spectra")
def audio_spectrum(spark, d):
    return _viz(spark, d).select("media_id", "idx", F.posexplode("spectrum").alias("bin", "v")).select("media_id", "idx", "bin", F.round("v", 9).alias("value"))


@query(_SPECTRUM + " select media_id, idx, 'spectrum' as section, cast(b as int) as point_index, round(value, 9) as value from spectra union all select media_id, idx, 'waveform', cast(i as int), round(waveform[i + 1], 9) from waves, range(0, 64) t(i)")
def audio_viz_unpivot(spark, d):
    return audio.unpivot(_viz(spark, d)).withColumn("value", F.round("value", 9))


@query(_SOUND + " select media_id, idx, ts, round(level, 9) as level, sample_rate, channels from levels qualify row_number() over (partition by media_id order by idx desc) = 1")
def audio_latest_snapshot(spark, d):
    return audio.latest(_viz(spark, d)).select("media_id", "idx", "ts", F.round("level", 9).alias("level"), "sample_rate", "channels")


@query(_SOUND + """, l as (select media_id, idx, level, greatest(coalesce(ts - lag(ts) over (partition by media_id order by idx), 0e0), 0e0) as dt from levels qualify row_number() over (partition by media_id order by idx desc) <= 90)
    select media_id, round(list_reduce(list_prepend({'y': 0e0, 'dt': 0e0}, list({'y': level, 'dt': dt} order by idx)), lambda a, v: {'y': a.y + (v.y - a.y) * (1 - exp(-v.dt / case when v.y > a.y then 0.05e0 else 0.20e0 end)), 'dt': 0e0}).y, 9) as meter from l group by 1""")
def audio_smooth(spark, d):
    return audio.smooth(_sound(spark, d).select("media_id", "idx", "ts", audio.rms_level(F.col("samples")).alias("level")))


# --- formats ---

_NAME = "replace(replace(p_name, ' ', '_'), '.', '') || case p_partkey % 8 when 0 then '_640x480.yuv' when 1 then '_w320_h240.nv12' when 2 then '.pcm' when 3 then '_rgb24.raw' when 4 then '.mp4' when 5 then '_1280X720_BGR24.bgr' when 6 then '.yuy2' else '.rgb' end"


def _names(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", F.expr(_NAME.replace("p_partkey % 8", "cast(p_partkey % 8 as int)")).alias("name"))


@query(f"""with f as (select p_partkey, {_NAME} as name from part) select p_partkey, name, case when lower(regexp_extract(name, '\\.([^./]+)$', 1)) in ('yuv','nv12','rgb','bgr','yuy2','raw') then 'raw_image' when lower(regexp_extract(name, '\\.([^./]+)$', 1)) = 'pcm' then 'raw_pcm' else 'demuxer' end as route from f""")
def file_routing(spark, d):
    return _names(spark, d).select("p_partkey", "name", fmt.media_route(F.col("name")).alias("route"))


_GEOMETRY = f"""with f as (select p_partkey, {_NAME} as name from part), g as (select *,
    coalesce(try_cast(nullif(regexp_extract(name, '(\\d{{2,5}})\\s*[xX]\\s*(\\d{{2,5}})', 1), '') as int), try_cast(nullif(regexp_extract(name, '[wW](\\d{{2,5}}).*[hH](\\d{{2,5}})', 1), '') as int), 1920) as width,
    coalesce(try_cast(nullif(regexp_extract(name, '(\\d{{2,5}})\\s*[xX]\\s*(\\d{{2,5}})', 2), '') as int), try_cast(nullif(regexp_extract(name, '[wW](\\d{{2,5}}).*[hH](\\d{{2,5}})', 2), '') as int), 1080) as height,
    case when contains(lower(name), 'nv12') then 'NV12' when contains(lower(name), 'yuy2') then 'YUY2' when contains(lower(name), 'rgb24') or contains(lower(name), '_rgb') or suffix(lower(name), '.rgb') then 'RGB24'
         when contains(lower(name), 'bgr24') or contains(lower(name), '_bgr') or suffix(lower(name), '.bgr') then 'BGR24' else 'YUV420P' end as pix_fmt from f)"""


@query(_GEOMETRY + " select p_partkey, width, height, pix_fmt from g")
def raw_geometry(spark, d):
    w, h = fmt.name_geometry(F.col("name"))
    return _names(spark, d).select("p_partkey", w.alias("width"), h.alias("height"), fmt.name_pixel_format(F.col("name")).alias("pix_fmt"))


@query(_GEOMETRY + """, s as (select *, case when pix_fmt in ('YUV420P', 'NV12') then cast(width as bigint) * height * 3 // 2 when pix_fmt = 'YUY2' then cast(width as bigint) * height * 2 else cast(width as bigint) * height * 3 end as frame_bytes, cast(p_partkey as bigint) * 1000003 as file_bytes from g)
    select p_partkey, cast(frame_bytes as bigint) as frame_bytes, case when file_bytes >= frame_bytes then cast(file_bytes // frame_bytes as bigint) end as frames from s""")
def raw_frame_plan(spark, d):
    w, h = fmt.name_geometry(F.col("name"))
    per = fmt.frame_bytes(w, h, fmt.name_pixel_format(F.col("name")))
    return _names(spark, d).select("p_partkey", per.alias("frame_bytes"), fmt.raw_frames(F.col("p_partkey").cast("long") * 1000003, per).alias("frames"))


@query("""with p as (select p_partkey, cast(p_partkey as bigint) * 100003 as size, 8000 + p_partkey % 40 * 1000 as rate, p_partkey % 9 - 1 as channels, [8, 16, 24, 32, 0][p_partkey % 5 + 1] as bits from part),
    q as (select *, cast(rate as bigint) * (case when channels > 0 then channels else 1 end) * (bits // 8) as per from p) select p_partkey, case when per > 0 then cast(size * 1000 // per as bigint) end as duration_ms from q""")
def pcm_duration(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey"), F.col("p_partkey").cast("long").alias("k"))
    bits = fmt.pcm_bits(F.element_at(F.array(*map(F.lit, ("pcm_u8", "pcm_s16le", "pcm_s24be", "pcm_f32le", "aac"))), (F.col("k") % 5 + 1).cast("int")))
    return p.select("p_partkey", fmt.pcm_duration_ms(F.col("k") * 100003, 8000 + F.col("k") % 40 * 1000, F.col("k") % 9 - 1, bits).alias("duration_ms"))


_MS = "cast(o_orderkey as bigint) * 7919 - 100000"


@query(f"""with o as (select o_orderkey, {_MS} as ms from orders) select o_orderkey, case when ms <= 0 then '' else (case when ms // 3600000 > 0 then (ms // 3600000) || ' h ' else '' end) || (case when ms // 60000 > 0 then (ms // 60000 % 60) || ' min ' else '' end) || (ms // 1000 % 60) || ' s' end as duration,
    cast(least(greatest(ms, 0), 2147483647) as int) as clamped from o""")
def fmt_duration(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(_MS).alias("ms"))
    return o.select("o_orderkey", fmt.duration_text(F.col("ms")).alias("duration"), fmt.clamp_ms(F.col("ms")).alias("clamped"))


@query("""with o as (select o_orderkey, cast(o_orderkey as bigint) * 37 - 500 as bps from orders) select o_orderkey, case when bps > 0 then (bps // 1000) || ' kb/s' else '' end as info,
    case when bps >= 1000000 then (bps // 1000000) || ' Mbps' when bps >= 1000 then (bps // 1000) || ' Kbps' else bps || ' bps' end as report from o""")
def fmt_bitrate(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey").cast("long") * 37 - 500).alias("bps"))
    return o.select("o_orderkey", fmt.bitrate_info(F.col("bps")).alias("info"), fmt.bitrate_report(F.col("bps")).alias("report"))


@query("with o as (select o_orderkey, cast(o_orderkey as bigint) * 13 % 400000 as s from orders) select o_orderkey, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) as clock from o")
def fmt_hms(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fmt.clock(F.col("o_orderkey").cast("long") * 13 % 400000).alias("clock"))


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then '' else printf('%.3f FPS', (o_orderkey % 7) * 1001 / 125e0) end as fps, case when o_orderkey % 7 = 0 then '' else (o_orderkey % 7) || ' pixels' end as pixels,
    printf('%.1f MiB', o_orderkey * 1048576e0 / 1048576e0) as size, printf('%.6f kHz', (o_orderkey % 96) * 500 / 1000e0) as khz from orders""")
def fmt_numbers(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey").cast("long")
    return o.select("o_orderkey", fmt.frame_rate(k % 7 * 1001 / 125.0).alias("fps"), fmt.pixels(k % 7).alias("pixels"), fmt.file_size_mib(k * 1048576).alias("size"), fmt.sampling_khz(k % 96 * 500).alias("khz"))


@query("""with t as (select p_partkey, case when p_partkey % 11 = 0 then 0 else (97 + p_partkey % 26) + 256 * (65 + p_partkey % 20) + 65536 * (48 + p_partkey % 10) + case when p_partkey % 4 = 0 then 0 else 16777216 * 52 end end as tag from part)
    select p_partkey, case when tag = 0 then '' else chr(cast(tag & 255 as int)) || chr(cast((tag >> 8) & 255 as int)) || chr(cast((tag >> 16) & 255 as int)) || case when tag >> 24 = 0 then ' ' else chr(cast(tag >> 24 as int)) end end as fourcc from t""")
def fourcc(spark, d):
    k = F.col("p_partkey").cast("long")
    tag = F.when(k % 11 == 0, 0).otherwise(97 + k % 26 + 256 * (65 + k % 20) + 65536 * (48 + k % 10) + F.when(k % 4 == 0, 0).otherwise(16777216 * 52))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", fmt.fourcc(tag).alias("fourcc"))


@query(_FRAMES + " select media_id, fidx, printf('frame_%08d', fidx + 1) || coalesce('_pts_' || pts, '') || coalesce('_tsms_' || cast(floor(ts * 1000 + 0.5) as bigint), '') || '.rgb' as name from video")
def export_file_name(spark, d):
    return _video(spark, d).select("media_id", "fidx", fmt.export_name(F.col("fidx") + 1, F.col("pts"), F.col("ts"), F.lit("rgb")).alias("name"))


@query("""with p as (select p_partkey, [1, 16, 18, 13, 99][p_partkey % 5 + 1] as trc, p_partkey % 2 = 0 as m, p_partkey % 3 = 0 as l from part) select p_partkey,
    case when trc = 16 and (m or l) then 'HDR10' when trc = 16 then 'PQ' when trc = 18 then 'HLG' else '' end as hdr, case trc when 1 then 'BT.709' when 16 then 'PQ' when 18 then 'HLG' when 13 then 'iec61966-2-1' end as transfer from p""")
def hdr_class(spark, d):
    k = F.col("p_partkey")
    name = fmt.lookup(F.element_at(F.array(*map(F.lit, (1, 16, 18, 13, 99))), (k % 5 + 1).cast("int")), fmt.TRANSFERS)
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", name.alias("transfer"))
    return p.select("p_partkey", fmt.hdr_class(F.coalesce("transfer", F.lit("")), k % 2 == 0, k % 3 == 0).alias("hdr"), "transfer")


@query("""select page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped from pages""")
def html_escaped(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fmt.html_escape(F.col("url")).alias("escaped"))


@query("""with p as (select p_partkey, p_partkey % 3 as r, p_partkey % 6 as o, p_partkey % 2 as w, p_partkey // 2 % 2 as h, p_partkey % 13 as d from part) select p_partkey, case r when 1 then 'Limited' when 2 then 'Full' else '' end as color_range,
    case when o = 1 then 'Progressive' when o between 2 and 5 then 'Interlaced' else '' end as scan_type, case when w = 0 and h = 0 then '4:4:4' when w = 1 and h = 0 then '4:2:2' when w = 1 and h = 1 then '4:2:0' else '' end as chroma, case when d > 0 then d || ' bits' else '' end as depth from p""")
def pixel_labels(spark, d):
    k = F.col("p_partkey").cast("long")
    name = lambda code, names: fmt.lookup(code.cast("int"), names, F.lit(""))
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", name(k % 3, fmt.COLOR_RANGES).alias("color_range"), name(k % 6, fmt.SCAN_TYPES).alias("scan_type"), fmt.chroma_subsampling(k % 2, F.floor(k / 2) % 2, F.lit(False)).alias("chroma"), fmt.bit_depth(k % 13).alias("depth"))


@query("""select p_partkey, printf('%.3f', (p_partkey % 1900 + 16) * (case when p_partkey % 4 = 0 then 1 else p_partkey % 4 end) * 8 / (8e0 * (case when p_partkey % 4 = 0 then 1 else 8 end))) as dar from part""")
def display_aspect(spark, d):
    k = F.col("p_partkey").cast("long")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", fmt.display_aspect(k % 1900 + 16, F.lit(1), k % 4, F.lit(8)).alias("dar"))


# --- images ---


@query(_IMAGES + """, c as (select media_id, idx as frame_idx, bin, count(*) as n from (select media_id, idx, unnest(pixels) as bin from images) group by 1, 2, 3)
    select media_id, frame_idx, 'grey' as channel, bin, round(n / cast(max(n) over (partition by media_id, frame_idx) as double), 9) as value from c""")
def histogram_channel(spark, d):
    return images.histogram(adapter.grey_images(spark, d))


@query("""with p as (select p_partkey, p_partkey % 256 as y, p_partkey * 7 % 256 - 128 as u, p_partkey * 13 % 256 - 128 as v from part)
    select p_partkey, cast(greatest(least(y + trunc(v * 1.402e0), 255), 0) as int) as r, cast(greatest(least(y - trunc(u * 0.344136e0 + v * 0.714136e0), 255), 0) as int) as g, cast(greatest(least(y + trunc(u * 1.772e0), 255), 0) as int) as b from p""")
def yuv_to_rgb(spark, d):
    k = F.col("p_partkey").cast("long")
    r, g, b = images.yuv_to_rgb(k % 256, k * 7 % 256, k * 13 % 256)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


def _boxes(spark, d):
    k = F.col("p_partkey").cast("long")
    return spark.read.parquet(f"{d}/part.parquet").select((k % 8).alias("media_id"), k.alias("frame_idx"), (k % 100).cast("int").alias("x"), (k % 90).cast("int").alias("y"), (30 + k % 271).cast("int").alias("width"), (30 + k % 171).cast("int").alias("height"))


@query("""with b as (select cast(p_partkey % 8 as bigint) as media_id, cast(p_partkey as bigint) as frame_idx, p_partkey % 100 as x, p_partkey % 90 as y, 30 + p_partkey % 271 as w, 30 + p_partkey % 171 as h from part)
    select media_id, frame_idx, cast(x + trunc(w * 0.3e0) as int) as left_eye_x, cast(y + trunc(h * 0.4e0) as int) as left_eye_y, cast(x + trunc(w * 0.5e0) as int) as nose_x, cast(y + trunc(h * 0.6e0) as int) as nose_y, cast(x + trunc(w * 0.65e0) as int) as right_mouth_x, cast(y + trunc(h * 0.8e0) as int) as right_mouth_y from b""")
def face_landmarks(spark, d):
    f = images.face_landmarks(_boxes(spark, d))
    pick = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("left_eye", "nose", "right_mouth") for c in ("x", "y")]
    return f.select("media_id", "frame_idx", *pick)


@query("""with t as (select cast(p_partkey % 8 as bigint) as media_id, cast(p_partkey as bigint) as frame_idx, p_partkey % 101 / 100e0 as confidence, p_partkey % 50 / 100e0 as x1, p_partkey % 40 / 100e0 as y1, (50 + p_partkey % 50) / 100e0 as x2, (50 + p_partkey % 40) / 100e0 as y2 from part)
    select media_id, frame_idx, confidence, cast(trunc(x1 * 1280) as int) as x, cast(trunc(y1 * 720) as int) as y, cast(trunc(x2 * 1280) as int) - cast(trunc(x1 * 1280) as int) as width, cast(trunc(y2 * 720) as int) - cast(trunc(y1 * 720) as int) as height from t where confidence > 0.5""")
def dnn_box_filter(spark, d):
    k = F.col("p_partkey").cast("long")
    t = spark.read.parquet(f"{d}/part.parquet").select((k % 8).alias("media_id"), k.alias("frame_idx"), (k % 101 / 100.0).alias("confidence"), (k % 50 / 100.0).alias("x1"), (k % 40 / 100.0).alias("y1"), ((50 + k % 50) / 100.0).alias("x2"), ((50 + k % 40) / 100.0).alias("y2"), F.lit(1280).alias("frame_width"), F.lit(720).alias("frame_height"))
    return images.detections_to_faces(t)


@query()
def canny_edges(spark, d):
    return images.edges(adapter.grey_images(spark, d))


@query()
def contours(spark, d):
    return images.contours(adapter.grey_images(spark, d))


@query()
def dft2d(spark, d):
    return images.spectra(adapter.grey_images(spark, d)).select("media_id", "idx", "spectrum_sum", F.round("energy", 6).alias("energy"))


# --- macroblocks, on a grid made of line items ---

_BLOCKS = """with g as (select cast(l_suppkey % 4 as bigint) as media_id, cast(l_orderkey % 50 as bigint) as frame_idx, cast(l_partkey % 9 as int) as mb_y, cast(l_suppkey % 11 as int) as mb_x, cast(l_linenumber * l_partkey % 52 as int) as q, cast(l_partkey * 37 % 65536 as int) as mb_type, cast(l_partkey % 5 as int) as ref0 from lineitem)"""


def _blocks(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    o, p, s, n = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return line.select((s % 4).alias("media_id"), (o % 50).alias("frame_idx"), (p % 9).cast("int").alias("mb_y"), (s % 11).cast("int").alias("mb_x"), (n * p % 52).cast("int").alias("q"), (p * 37 % 65536).cast("int").alias("mb_type"), (p % 5).cast("int").alias("ref0"))


@query(_BLOCKS + " select media_id, frame_idx, cast(sum(q) // count(*) as int) as avg_q, max(q) as max_q, coalesce(min(q) filter (where q <> 0), 100) as min_q from g group by 1, 2")
def mb_q_stats(spark, d):
    return macroblocks.q_stats(_blocks(spark, d))


@query(_BLOCKS + " select media_id, frame_idx, " + ", ".join(f"count(*) filter (where mb_type & {bit} <> 0) as {name}" for name, bit in {**macroblocks.TYPES, "list0": macroblocks.LIST0, "list1": macroblocks.LIST1}.items()) + " from g group by 1, 2")
def mb_type_counts(spark, d):
    return macroblocks.type_counts(_blocks(spark, d))


@query("""with p as (select p_partkey, 16 + p_partkey % 1905 as w, 16 + p_partkey % 1065 as h, p_partkey % 2 + 2 as l from part) select p_partkey, cast((w + 15) >> 4 as int) as mb_width, cast(w // 16 + 1 as int) as mb_stride, cast(((h + 15) >> 4) * (w // 16 + 1) as int) as mb_sum, cast(1 << cast(2 * (4 - l) as int) as int) as mvs_per_mb from p""")
def mb_geometry(spark, d):
    k = F.col("p_partkey").cast("int")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *macroblocks.geometry(16 + k % 1905, 16 + k % 1065, k % 2 + 2))


@query("""with v as (select p_partkey, unnest(range(0, 96)) as p from part) select cast(p_partkey % 8 as bigint) as media_id, cast(p_partkey as bigint) as frame_idx, cast(p // 12 // 2 as int) as mb_y, cast(p % 12 // 2 as int) as mb_x,
    cast(p // 12 % 2 * 2 + p % 12 % 2 as int) as part, cast(p * p_partkey % 127 as int) as mv from v""")
def mv_unpack(spark, d):
    k = F.col("p_partkey").cast("long")
    mv = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda p: (p * k % 127).cast("int"))
    f = spark.read.parquet(f"{d}/part.parquet").select((k % 8).alias("media_id"), k.alias("frame_idx"), F.lit(6).alias("mb_stride"), F.lit(2).alias("sample"), mv.alias("mv"))
    return macroblocks.unpack_vectors(f)


@query(_BLOCKS + " select media_id, frame_idx, mb_y, mb_x, q, q * 255 // 51 as q_grey, ref0 * 128 // 5 + 128 as ref_grey from g")
def mb_grey_levels(spark, d):
    b = _blocks(spark, d)
    return b.select("media_id", "frame_idx", "mb_y", "mb_x", "q", macroblocks.q_grey(F.col("q")).alias("q_grey"), macroblocks.ref_grey(F.col("ref0"), F.lit(5)).alias("ref_grey"))


@query(_BLOCKS + " , u as (select media_id, frame_idx, mb_y, mb_x, max(q) as q from g group by 1, 2, 3, 4) select media_id, frame_idx, mb_y, string_agg(cast(q as varchar), ',' order by mb_x) as line from u group by 1, 2, 3")
def mb_csv_lines(spark, d):
    return macroblocks.lines(_blocks(spark, d).groupBy("media_id", "frame_idx", "mb_y", "mb_x").agg(F.max("q").alias("q")))


# --- files and reports ---


@query("""with f as (select conv_id, turn, trim(text) as t from conversations) select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as pos, t as location, t as title from f where t <> '' and t not like '#%'""")
def playlist_lines(spark, d):
    from ..sources.files import playlist_tracks

    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.col("text").alias("value"))
    return playlist_tracks(c).withColumnRenamed("file", "conv_id")


@query("""with l as (select n_nationkey as line, '  ' || n_name || ' = "' || n_regionkey || '"' as value from nation union all select 100 + r_regionkey, '# ' || r_name || ' = x' from region union all select 200 + n_nationkey, upper(n_name) || '=new=' || n_nationkey from nation where n_nationkey < 5),
    p as (select line, trim(split_part(value, '=', 1)) as key, trim(substr(value, strpos(value, '=') + 1)) as value from l where trim(value) not like '#%') select key, arg_max(regexp_replace(value, '^"(.*)"$', '\\1'), line) as value from p group by 1""")
def config_parse(spark, d):
    from ..sources.files import parse_config

    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    a = n.select(F.col("n_nationkey").alias("line"), F.concat(F.lit("  "), "n_name", F.lit(' = "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("value"))
    b = r.select((F.col("r_regionkey") + 100).alias("line"), F.concat(F.lit("# "), "r_name", F.lit(" = x")).alias("value"))
    c = n.filter("n_nationkey < 5").select((F.col("n_nationkey") + 200).alias("line"), F.concat(F.upper("n_name"), F.lit("=new="), F.col("n_nationkey").cast("string")).alias("value"))
    return parse_config(a.union(b).union(c))


@query(_FRAMES + " select media_id, cast(fidx as bigint) as \"index\", case frame_type when 1 then 'I' when 2 then 'P' when 3 then 'B' else '?' end as frame_type, cast(is_key as int) as is_key_frame, case when ts is not null then printf('%.6f', ts) end as timestamp_seconds, pts, gop_index, gop_position from gop_frames")
def csv_video_frames(spark, d):
    return _csv(_gops(spark, d), tables.frames_csv)


def _csv(df, layout):
    """A CSV layout with its media in front; the number format of a missing time is NULL."""
    out = layout(df.withColumn("pts", F.struct("media_id", "pts")))
    seconds = F.when(F.col("timestamp_seconds") != "null", F.col("timestamp_seconds"))
    return out.select(F.col("pts.media_id").alias("media_id"), *[F.col("pts.pts").alias("pts") if c == "pts" else seconds.alias(c) if c == "timestamp_seconds" else F.col(c) for c in out.columns])


@query(_FRAMES + " select media_id, fidx as \"index\", case when ts is not null then printf('%.6f', ts) end as timestamp_seconds, pts, sample_count, sample_rate, channels, byte_count from audio")
def csv_audio_frames(spark, d):
    return _csv(_audio(spark, d), tables.audio_csv)


@query(_SYNC + " select sync_idx as \"index\", printf('%.6f', audio_ts) as audio_timestamp_seconds, printf('%.6f', video_ts) as video_timestamp_seconds, printf('%.3f', diff_ms) as diff_ms, case when audio_anchor then 'audio' else 'video' end as anchor from samples")
def csv_sync(spark, d):
    return tables.sync_csv(_samples(spark, d))


_STATS = _SECONDS + """,
stats as (select media_id, count(*) as total_packets, cast(sum(size) as bigint) as total_bytes, count(*) filter (where stream_type = 0) as video_packets, count(*) filter (where stream_type = 1) as audio_packets, max(size) as max_packet_size, min(size) as min_packet_size,
    cast(sum(size) // count(*) as bigint) as avg_packet_size, count(*) filter (where flags % 2 = 1) as key_frame_count, max(ts) - min(ts) as duration_seconds from packets group by 1),
rates as (select media_id, second, bps, video_fps, cast(sum(bps) over w // count(*) over w as bigint) as avg_bps, max(bps) over (partition by media_id order by second rows unbounded preceding) as peak_bps, round(avg(video_fps) over w, 9) as avg_fps
    from seconds window w as (partition by media_id order by second rows 299 preceding)),
final as (select media_id, cast(video_fps as double) as current_fps, avg_fps, bps as current_bitrate_bps, avg_bps as avg_bitrate_bps, peak_bps as peak_bitrate_bps from rates qualify row_number() over (partition by media_id order by second desc) = 1),
runs as (select media_id, sum(flags % 2) over (partition by media_id order by idx rows unbounded preceding) as run from packets),
sizes as (select media_id, run, count(*) as n, max(run) over (partition by media_id) as last from runs group by 1, 2),
groups as (select media_id, coalesce(max(n) filter (where run = last - 1), 0) as gop_size, coalesce(max(n) filter (where run < last), 0) as max_gop_size, max(n) filter (where run = last) as current_gop_size from sizes group by 1),
full_stats as (select * from stats left join final using (media_id) left join groups using (media_id))"""


def _stats(spark, d):
    return report.full_stats(_p(spark, d))


@query(_STATS + " select * from full_stats")
def report_stats(spark, d):
    return _stats(spark, d)


_RATE_SQL = "case when {0} >= 1000000 then ({0} // 1000000) || ' Mbps' when {0} >= 1000 then ({0} // 1000) || ' Kbps' else {0} || ' bps' end"
_CLOCK_SQL = "printf('%02d:%02d:%02d', cast(trunc(coalesce(duration_seconds, 0)) as bigint) // 3600, cast(trunc(coalesce(duration_seconds, 0)) as bigint) // 60 % 60, cast(trunc(coalesce(duration_seconds, 0)) as bigint) % 60)"


@query(_STATS + f" select media_id, total_packets || ' packets, ' || printf('%.2f', coalesce(avg_fps, 0)) || ' fps, ' || {_RATE_SQL.format('coalesce(avg_bitrate_bps, 0)')} || ', ' || {_CLOCK_SQL} as summary from full_stats")
def report_summary(spark, d):
    return report.summaries(_stats(spark, d))


@query(_STATS + f""" select media_id, concat_ws(chr(10), 'Stream report', '', 'Totals', '  Packets: ' || total_packets, '  Bytes: ' || (total_bytes // 1024) || ' KB', '  Video packets: ' || video_packets, '  Audio packets: ' || audio_packets, '',
    'Frame rate', '  Current: ' || printf('%.2f', coalesce(current_fps, 0)) || ' fps', '  Average: ' || printf('%.2f', coalesce(avg_fps, 0)) || ' fps', '', 'Bit rate', '  Current: ' || {_RATE_SQL.format('coalesce(current_bitrate_bps, 0)')},
    '  Average: ' || {_RATE_SQL.format('coalesce(avg_bitrate_bps, 0)')}, '  Peak: ' || {_RATE_SQL.format('coalesce(peak_bitrate_bps, 0)')}, '', 'Groups of pictures', '  Last: ' || gop_size, '  Largest: ' || max_gop_size, '  Key frames: ' || key_frame_count, '',
    'Packet size', '  Average: ' || avg_packet_size || ' bytes', '  Largest: ' || max_packet_size || ' bytes', '  Smallest: ' || min_packet_size || ' bytes', '', 'Time', '  Duration: ' || {_CLOCK_SQL}, '') as report from full_stats""")
def report_text(spark, d):
    return report.texts(_stats(spark, d))


_JSON = ", ".join(f"'{c}', " + (f"round({c}, 2)" if c in ("current_fps", "avg_fps", "duration_seconds") else c) for c in report.JSON_FIELDS)


@query(_STATS + f" select media_id, cast(json_object('video_file', cast(media_id as varchar), 'statistics', json_object({_JSON})) as varchar) as report from full_stats where duration_seconds is not null")
def report_json(spark, d):
    return report.to_json(_stats(spark, d).filter("duration_seconds is not null"))


@query(_PACKETS + """, per as (select media_id, cast(floor(ts) as bigint) as second, count(*) as n, cast(sum(size) as bigint) as bytes, count(*) filter (where stream_type = 0) as v, count(*) filter (where stream_type = 1) as a, cast(sum(flags % 2) as bigint) as keys, cast(sum(cast(size as bigint) * 8) as bigint) as bps from packets where ts is not null group by 1, 2),
    t as (select *, cast(sum(n) over s as bigint) as tn, cast(sum(bytes) over s as bigint) as tb, cast(sum(v) over s as bigint) as tv, cast(sum(a) over s as bigint) as ta, cast(sum(keys) over s as bigint) as tk, max(bps) over s as peak, cast(sum(bps) over w // count(*) over w as bigint) as mean, round(avg(v) over w, 9) as fps
        from per window s as (partition by media_id order by second rows unbounded preceding), w as (partition by media_id order by second rows 299 preceding))
    select media_id, second as "Time(s)", tn as "TotalPackets", tb as "TotalBytes", tv as "VideoPackets", ta as "AudioPackets", cast(v as double) as "CurrentFPS", fps as "AvgFPS", bps as "CurrentBitrate", mean as "AvgBitrate", peak as "PeakBitrate", cast(case when tk > 0 then tn // tk else 0 end as bigint) as "GOPSize", tk as "KeyFrames", cast(tb // tn as bigint) as "AvgPacketSize" from t""")
def csv_stats_series(spark, d):
    rows = report.stats_series(_p(spark, d))
    return rows.select("media_id", *[F.col(c).alias(name) for name, c in report.SERIES.items()])


@query(_PACKETS + " select media_id, idx as \"index\", stream_index, case when ts is not null then printf('%.6f', ts) end as timestamp_seconds, pts, dts, cast(null as bigint) as duration, size, flags, cast(null as bigint) as file_pos from packets")
def csv_packets(spark, d):
    return _csv(_p(spark, d), tables.packets_csv)


@query(_EVENTS + " select media_id, event_idx as \"index\", severity, type, stream_index, case when ts is not null then printf('%.6f', ts) end as timestamp_seconds, pts, type as summary, 'packet ' || packet_idx as detail from events_log")
def csv_events(spark, d):
    return _csv(_events(spark, d), tables.events_csv)


@query(_TIMELINE + " select media_id, timeline_idx as \"index\", category, printf('%.6f', ts) as timestamp_seconds, label, '' as detail from line")
def csv_timeline(spark, d):
    rows = _line(spark, d).withColumn("label", F.struct("media_id", "label"))
    return tables.timeline_csv(rows).select(F.col("label.media_id").alias("media_id"), "index", "category", "timestamp_seconds", F.col("label.label").alias("label"), "detail")


@query(_SPECTRUM + """ select 'spectrum' as section, media_id, s.idx as "index", printf('%.6f', ts) as timestamp_seconds, sample_rate, channels, cast(b as int) as point_index, round(value, 9) as value from spectra s join levels using (media_id, idx)
    union all select 'waveform', media_id, w.idx, printf('%.6f', w.ts), sample_rate, channels, cast(i as int), round(waveform[i + 1], 9) from waves w join levels using (media_id, idx), range(0, 64) t(i)""")
def csv_visualization(spark, d):
    rows = _viz(spark, d)
    both = tables.visualization_csv(rows.withColumn("sample_rate", F.struct("media_id", "sample_rate")))
    return both.select("section", F.col("sample_rate.media_id").alias("media_id"), "index", "timestamp_seconds", F.col("sample_rate.sample_rate").alias("sample_rate"), "channels", "point_index", F.round("value", 9).alias("value"))


@query(_FRAMES + " select media_id, arrival, stream_index, pts, ts from video where width <= 0 or height <= 0")
def frame_invalid(spark, d):
    return anomalies.invalid_frames(adapter.video_arrivals(_p(spark, d))).select("media_id", "arrival", "stream_index", "pts", "ts")


@query(_EVENTS + " select media_id, event_idx, type from events_log where severity = 'error'")
def events_at_least(spark, d):
    return anomalies.at_least(_events(spark, d), "error").select("media_id", "event_idx", "type")


@query(_PACKETS + " select media_id, idx, stream_index, stream_type from packets where stream_type in (0, 1)")
def stream_filter(spark, d):
    return packets.only_types(_p(spark, d), 0, 1).select("media_id", "idx", "stream_index", "stream_type")


@query(_PACKETS + """, s as (select media_id, min(idx) + 100 as on_at, min(idx) + 700 as off_at from packets where media_id % 2 = 0 group by 1) select p.media_id, count(*) as total_packets, cast(sum(size) as bigint) as total_bytes from packets p join s using (media_id) where idx >= on_at and idx < off_at group by 1""")
def analyzer_gate(spark, d):
    p = _p(spark, d)
    first = p.filter("media_id % 2 = 0").groupBy("media_id").agg(F.min("idx").alias("m"))
    turn = lambda step, on: first.select("media_id", F.lit("stream").alias("analyzer"), (F.col("m") + step).alias("at"), F.lit(on).alias("on"))
    on = packets.gated(p, turn(100, True).unionByName(turn(700, False)), "stream")
    return packets.stats(on).select("media_id", "total_packets", "total_bytes")


_FOLD = """, o as (select media_id, list({{'idx': idx, 'v': {value}, 'kept': [cast(null as bigint)]}} order by idx) as rows from {source} group by 1),
    f as (select media_id, list_reduce(list_prepend({{'idx': cast(-1 as bigint), 'v': cast(null as {kind}), 'kept': cast([] as bigint[])}}, list_transform(rows, lambda r: {{'idx': cast(r.idx as bigint), 'v': cast(r.v as {kind}), 'kept': cast([] as bigint[])}})),
        lambda a, r: case when a.v is null or {away} >= {least} then {{'idx': r.idx, 'v': r.v, 'kept': list_append(a.kept, r.idx)}} else a end) as s from o)
    select media_id, unnest(s.kept) as idx from f"""


@query(_PACKETS + ", pos as (select media_id, idx, cast(trunc(ts * 1000) as bigint) as ms from packets where stream_type = 0 and ts is not null)" + _FOLD.format(value="ms", source="pos", kind="bigint", away="abs(r.v - a.v)", least="60000"))
def position_throttle(spark, d):
    p = packets.only_types(_p(spark, d), 0).select("media_id", "idx", (F.col("ts") * 1000).cast("long").alias("ms"))
    return timeline.throttled(p, "ms", 60000).select("media_id", "idx")


@query(_SOUND + _FOLD.format(value="ts", source="levels", kind="double", away="r.v - a.v", least="0.033"))
def meter_throttle(spark, d):
    return timeline.throttled(_sound(spark, d).select("media_id", "idx", "ts"), "ts", 0.033, both_ways=False).select("media_id", "idx")


@query(_FRAMES + """, o as (select media_id, fidx, arrival, ts, lead(ts) over (partition by media_id order by fidx) as nxt from video where ts is not null),
    s as (select media_id, cast(-1 as bigint) as fidx, idx as arrival, ts from packets where stream_type = 1 and ts is not null),
    c as (select media_id, fidx, arrival, ts, nxt, null as clock from o union all select media_id, fidx, arrival, ts, null, ts from s),
    m as (select *, last_value(clock ignore nulls) over (partition by media_id order by arrival rows unbounded preceding) as master from c)
    select media_id, fidx, coalesce(ts < master - 0.01 and abs(ts - master) < 10.0, false) as early, coalesce(master > nxt, false) as late from m where fidx >= 0""")
def frame_drops(spark, d):
    p = _p(spark, d)
    return sync.drops(frames.numbered(adapter.video_arrivals(p)), p)


@query("""with o as (select o_orderkey, o_custkey * 1000 as c, [o_orderkey % 900 * 10, o_custkey % 3, o_custkey % 7 * 100000] as s from orders)
    select o_orderkey, cast(greatest(coalesce(case when o_orderkey % 5 > 0 then c end, 0), coalesce(list_max(s), 0)) as bigint) as duration_ms from o""")
def media_duration(spark, d):
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", metadata.duration_ms(F.when(k % 5 > 0, c * 1000), F.array(k % 900 * 10, c % 3, c % 7 * 100000)).cast("long").alias("duration_ms"))


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_brand else '' end as description,
    case when p_partkey % 4 = 0 then '' when p_partkey % 5 = 0 then 'isom' else 'isom (' || p_brand || ')' end as container_id,
    cast(case when p_partkey % 2 = 1 then p_partkey * 100 else cast(8000 + p_partkey as bigint) * (p_partkey % 8) * 16 end as bigint) as bit_rate,
    printf('%.1f - %.1f cd/m2', (p_partkey % 10) / 5e0, p_partkey * 1e0) as luminance, printf('R(%.4f,%.4f) G(%.4f,%.4f) B(%.4f,%.4f) WP(%.4f,%.4f)', p_partkey % 50 / 50e0, 0.25, 0.5, p_partkey % 25 / 25e0, 0.125, 0.0625, 0.3125, 0.375) as primaries from part""")
def container_texts(spark, d):
    k = F.col("p_partkey").cast("long")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("description"), F.col("p_name"), F.lit("comment"), F.lit("-"))).when(k % 3 == 1, F.create_map(F.lit("comment"), F.col("p_brand"), F.lit("title"), F.lit("-"))).otherwise(F.create_map(F.lit("title"), F.lit("-")))
    part = lambda n, of: k % n / F.lit(float(of))
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", fmt.metadata(tags, "description", "comment").alias("description"), fmt.container_id(F.when(k % 4 > 0, "isom"), F.when(k % 5 > 0, F.col("p_brand"))).alias("container_id"),
        fmt.audio_bit_rate(F.when(k % 2 == 1, k * 100).otherwise(0), 8000 + k, k % 8, F.lit(16)).cast("long").alias("bit_rate"), fmt.mastering_luminance(k % 10 / 5.0, k * F.lit(1.0)).alias("luminance"),
        fmt.mastering_primaries(part(50, 50), F.lit(0.25), F.lit(0.5), part(25, 25), F.lit(0.125), F.lit(0.0625), F.lit(0.3125), F.lit(0.375)).alias("primaries"),
    )


@query("""with i as (select n_nationkey as media_id, 'A' as section, 0 as pos, 'Name' as key, n_name as value from nation union all select n_nationkey, 'A', 1, 'Region', cast(n_regionkey as varchar) from nation union all select n_nationkey, 'B', 0, 'Empty', '' from nation
        union all select n_nationkey, 'B', 1, 'Key', cast(n_nationkey as varchar) from nation where n_nationkey % 2 = 0),
    l as (select media_id, section, string_agg('  ' || rpad(key, 32, ' ') || ': ' || value, chr(10) order by pos) as body from i where value <> '' group by 1, 2)
    select cast(media_id as bigint) as media_id, string_agg(section || chr(10) || body, chr(10) || chr(10) order by section) as report from l group by 1""")
def media_info_text(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("k", F.col("n_nationkey").cast("long"))
    line = lambda section, pos, key, value: n.select(F.col("k").alias("media_id"), F.lit(section).alias("section"), F.lit(pos).alias("pos"), F.lit(key).alias("key"), value.alias("value"))
    rows = line("A", 0, "Name", F.col("n_name")).unionByName(line("A", 1, "Region", F.col("n_regionkey").cast("string"))).unionByName(line("B", 0, "Empty", F.lit(""))).unionByName(line("B", 1, "Key", F.when(F.col("k") % 2 == 0, F.col("k").cast("string"))))
    return report.info_text(rows)


# --- more of images: three channels, scaling, raw formats ---

_RGB = _IMAGES + """, rgb as (select media_id, idx, p, pixels[p + 1] as r, 255 - pixels[p + 1] as g, pixels[p + 1] * 7 % 256 as b from images, range(0, 64) t(p))"""


def _rgb(spark, d):
    x = F.transform("pixels", lambda v: F.struct(v.alias("r"), (255 - v).alias("g"), (v * 7 % 256).alias("b")))
    return adapter.grey_images(spark, d).select("media_id", "idx", "width", "height", x.alias("rgb"))


@query(_RGB + """, c as (select media_id, idx as frame_idx, channel, bin, count(*) as n from (unpivot rgb on r, g, b into name channel value bin) group by 1, 2, 3, 4)
    select media_id, frame_idx, channel, cast(bin as int) as bin, round(n / cast(max(n) over (partition by media_id, frame_idx, channel) as double), 9) as value from c""")
def histogram_rgb(spark, d):
    return images.histogram_rgb(_rgb(spark, d))


@query(_RGB + """, m as (select *, greatest(r, g, b) as top, greatest(r, g, b) - least(r, g, b) as d from rgb),
    h as (select *, 30e0 * case when d = 0 then 0 when top = r then (g - b) / cast(d as double) - 6 * floor((g - b) / cast(d as double) / 6) when top = g then (b - r) / cast(d as double) + 2 else (r - g) / cast(d as double) + 4 end as hue, case when top = 0 then 0 else d / cast(top as double) * 255 end as sat from m),
    c as (select media_id, idx as frame_idx, cast(floor(hue / 11.25e0) as int) as h_bin, cast(floor(sat / 31.875e0) as int) as s_bin, count(*) as n from h where hue < 180 and sat < 255 group by 1, 2, 3, 4)
    select media_id, frame_idx, h_bin, s_bin, round(n / cast(max(n) over (partition by media_id, frame_idx) as double), 9) as value from c""")
def histogram_hs(spark, d):
    return images.histogram_hs(_rgb(spark, d))


@query(_RGB + " select media_id, idx, 'Y' as channel, cast(sum(round_even(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 0)) as bigint) as total from rgb group by 1, 2 union all select media_id, idx, 'R', cast(sum(r) as bigint) from rgb group by 1, 2")
def channel_split(spark, d):
    return images.channel_plane(_rgb(spark, d), "Y").unionByName(images.channel_plane(_rgb(spark, d), "R")).select("media_id", "idx", "channel", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(_IMAGES + """, s as (select media_id, idx, pixels, list_min(pixels) as low, list_max(pixels) as high from images) select media_id, idx, round(list_sum(list_transform(pixels, lambda x: case when high > low then (x - low) / cast(high - low as double) * 255 else 0 end)), 6) as total from s""")
def image_normalize(spark, d):
    out = images.normalized(adapter.grey_images(spark, d))
    return out.select("media_id", "idx", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(_IMAGES + """ select media_id, idx, list_transform(range(0, 16), lambda i: round((pixels[(i // 4) * 16 + (i % 4) * 2 + 1] + pixels[(i // 4) * 16 + (i % 4) * 2 + 2] + pixels[(i // 4) * 16 + (i % 4) * 2 + 9] + pixels[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4e0, 6)) as pixels from images""")
def image_resize(spark, d):
    return images.resized(adapter.grey_images(spark, d), 4, 4).select("media_id", "idx", F.transform("pixels", lambda x: F.round(x, 6)).alias("pixels"))


_RAW_BYTES = "(p_partkey * 7 + i * 31) % 256"


def _raw(spark, d, n: int, width: int, height: int, pix_fmt: str):
    k = F.col("p_partkey").cast("long")
    data = F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex((k * 7 + i * 31) % 256), 2, "0"))))
    return spark.read.parquet(f"{d}/part.parquet").select((k % 8).alias("media_id"), k.alias("idx"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(pix_fmt).alias("format"), data.alias("data"))


@query(f"""with y as (select p_partkey, unnest(range(0, 16)) as i from part), u as (select p_partkey, i, {_RAW_BYTES} as y, 16 + (i // 8) * 2 + i % 4 // 2 as spot from y),
    c as (select *, 1.164e0 * greatest(y - 16, 0) as l, (p_partkey * 7 + spot * 31) % 256 - 128 as cb, (p_partkey * 7 + (spot + 4) * 31) % 256 - 128 as cr from u)
    select cast(p_partkey % 8 as bigint) as media_id, cast(p_partkey as bigint) as idx, cast(sum(least(greatest(round_even(l + 2.018e0 * cb, 0), 0), 255)) as bigint) as b, cast(sum(least(greatest(round_even(l - 0.813e0 * cr - 0.391e0 * cb, 0), 0), 255)) as bigint) as g,
        cast(sum(least(greatest(round_even(l + 1.596e0 * cr, 0), 0), 255)) as bigint) as r from c group by 1, 2""")
def yuv420p_to_bgr(spark, d):
    return images.bgr_sums(_raw(spark, d, 24, 4, 4, "YUV420P"))


@query(f"""with y as (select p_partkey, unnest(range(0, 4)) as q from part), c as (select p_partkey, q, (p_partkey * 7 + q * 3 * 31) % 256 as r, (p_partkey * 7 + (q * 3 + 1) * 31) % 256 as g, (p_partkey * 7 + (q * 3 + 2) * 31) % 256 as b from y)
    select cast(p_partkey % 8 as bigint) as media_id, cast(p_partkey as bigint) as idx, list(cast(round_even(r * 0.299e0 + g * 0.587e0 + b * 0.114e0, 0) as int) order by q) as pixels from c group by 1, 2""")
def raw_decode_grey(spark, d):
    return images.decode_raw(_raw(spark, d, 12, 2, 2, "RGB24")).select("media_id", "idx", "pixels")


@query(_SOUND + """, s as (select media_id, idx, list_transform(range(0, 64), lambda i: mono[i + 1] * (1 - pow((i - 31.5e0) / 31.5e0, 2))) as x from levels),
    b as (select media_id, idx, k, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(2 * pi() * k * i / 64e0))) as re, list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(2 * pi() * k * i / 64e0))) as im from s, range(0, 32) t(k))
    select media_id, idx, list(cast(least(trunc(sqrt(sqrt(re * re + im * im) / 8e0) * 40 + 1e-7), 255) as int) order by k) as levels from b group by 1, 2""")
def rdft_column(spark, d):
    return audio.rdft_columns(_sound(spark, d), 40.0)


@query(_SOUND + """, s as (select media_id, idx, samples, range(0, 55) as starts from sound),
    c as (select media_id, idx, unnest(starts) as i, samples from s), v as (select media_id, idx, i, samples[i + 1] - samples[i + 10] as score, samples[i + 5] as b, samples[i + 6] as c from c)
    select media_id, idx, cast(coalesce(arg_max(i, (score, i)) filter (where (b < 0) <> (c < 0)), 54) as int) as start from v group by 1, 2""")
def waveform_trigger(spark, d):
    return _sound(spark, d).select("media_id", "idx", audio.trigger(F.col("samples")).alias("start"))


@query("""select p_partkey, cast((p_partkey * 11 + (p_partkey % 6 * 4) * 5) % 16 as int) as ref, cast(((p_partkey % 9) * (11 * 4 + case when p_partkey % 2 = 0 then 0 else 1 end) + p_partkey % 11) * 4 + 2 + 3 * (11 * 4 + case when p_partkey % 2 = 0 then 0 else 1 end) as int) as vector from part""")
def mb_reference(spark, d):
    k = F.col("p_partkey").cast("int")
    refs = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: ((k * 11 + i * 5) % 16).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", macroblocks.reference_of(refs, k % 6).alias("ref"), macroblocks.vector_index(k % 9, k % 11, F.lit(2), F.lit(3), F.lit(11), F.lit(4), k % 2 == 0).cast("int").alias("vector"))


@query("""with b as (select p_partkey % 8 as media_id, p_partkey // 3 as frame_idx from part), f as (select media_id, frame_idx, count(*) as n from b group by 1, 2), r as (select *, row_number() over (partition by media_id order by frame_idx desc) as k from f)
    select cast(media_id as bigint) as media_id, cast(sum(n) as bigint) as total_faces, round(avg(n) filter (where k <= 100), 9) as recent_mean from r group by 1""")
def face_stats(spark, d):
    return images.face_stats(_boxes(spark, d).withColumn("frame_idx", F.floor(F.col("frame_idx") / 3)))


@query(_FRAMES + " select media_id, fidx, pts from video where fidx % 25 = 0")
def frame_export_every_25(spark, d):
    return frames.every_nth(_video(spark, d), 25).select("media_id", "fidx", "pts")


@query(_IMAGES + " select media_id, idx from images where idx % 7 = 0")
def raw_analysis_every_7(spark, d):
    return frames.every_nth(adapter.grey_images(spark, d), 7, number="idx").select("media_id", "idx")


@query(_PACKETS + """, v as (select media_id, stream_index, idx, row_number() over (partition by media_id, stream_index order by idx) as n from packets where stream_type = 0)
    select media_id, stream_index, idx, case when n = 1 then '6742' || '00000001' else '00000001' end || lpad(printf('%X', idx % 256), 2, '0') as data from v""")
def packet_annex_b(spark, d):
    v = packets.only_types(_p(spark, d), 0)
    v = v.withColumn("data", F.unhex(F.concat(F.lit("00000001"), F.lpad(F.hex(F.col("idx") % 256), 2, "0"))))
    heads = v.select("media_id", "stream_index").distinct().withColumn("header", F.unhex(F.lit("6742")))
    return packets.annex_b(v, headers=heads).select("media_id", "stream_index", "idx", F.hex("data").alias("data"))


@query(_PACKETS + """, a as (select media_id, stream_index from (select distinct media_id, stream_index, stream_type from packets where stream_type in (0, 1)) qualify row_number() over (partition by media_id order by stream_type, stream_index) = 1) select * from a""")
def playback_clock(spark, d):
    return metadata.playback_clock(_p(spark, d).select("media_id", "stream_index", "stream_type").distinct())


# --- the analyses as streaming queries over the same log, run to its end ---


def _live(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return adapter.packets_of(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d) if _is_file(spark, f"{d}/events.parquet") else spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet"))


def _is_file(spark, path: str) -> bool:
    """Whether the table is one file: then its folder is what a stream reads."""
    from urllib.parse import unquote, urlparse

    found = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).limit(1).collect()
    return bool(found) and unquote(urlparse(found[0]["f"]).path).rstrip("/").endswith(unquote(urlparse(path).path).rstrip("/"))


def _to_table(spark, df, mode="append", keys=()):
    from uuid import uuid4

    return live.run_to_table(df, f"{scratch_folder(spark)}/live-{uuid4().hex}", mode, keys)


@query(_EVENTS + " select media_id, stream_index, idx, pts, ts, type from miss union all select media_id, stream_index, idx, pts, ts, type from jumps")
def stream_anomaly(spark, d):
    return _to_table(spark, live.anomalies(_live(spark, d)))


@query(_SECONDS + " select media_id, second, bps, packets, video_fps from seconds where false or second >= 0")
def stream_bitrate(spark, d):
    rows = _live(spark, d)
    return _to_table(spark, live.rates(rows.filter("ts >= 0"), late="100 days"), "update", ("media_id", "second"))


@query(_SYNC + " select media_id, sync_idx, audio_ts, video_ts, diff_ms, audio_anchor from samples")
def stream_sync(spark, d):
    return _to_table(spark, live.sync(_live(spark, d)))


@query(_PACKETS + " select media_id, count(*) as total_packets, cast(sum(size) as bigint) as total_bytes, count(*) filter (where stream_type = 0) as video_packets, count(*) filter (where stream_type = 1) as audio_packets from packets group by 1")
def stream_running_stats(spark, d):
    return _to_table(spark, live.running_stats(_live(spark, d)), "update", ("media_id",))


@query(_FRAMES + """ select media_id, gop_index, min(fidx) as start_frame, max(fidx) as end_frame, count(*) as total_frames, count(*) filter (where is_key) as key_count, gop_index = max(gop_index) over (partition by media_id) as open from gop_frames group by 1, 2""")
def stream_open_gop(spark, d):
    return _to_table(spark, live.gops(adapter.video_arrivals(_live(spark, d))), "update", ("media_id", "gop_index"))
