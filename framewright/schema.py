"""Schemas of the media tables as Spark DDL. Missing timestamps are NULL; idx is the arrival order within a media."""

STREAMS = "media_id BIGINT, stream_index INT, stream_type INT, tb_num INT, tb_den INT, codec STRING, attached_pic BOOLEAN, bit_rate BIGINT, duration_ticks BIGINT"
PACKETS = "media_id BIGINT, idx BIGINT, stream_index INT, stream_type INT, pts BIGINT, dts BIGINT, duration BIGINT, size INT, flags INT, pos BIGINT, ts DOUBLE"
VIDEO_FRAMES = "media_id BIGINT, idx BIGINT, frame_type INT, is_key BOOLEAN, pts BIGINT, ts DOUBLE"
AUDIO_FRAMES = "media_id BIGINT, idx BIGINT, pts BIGINT, ts DOUBLE, sample_count INT, sample_rate INT, channels INT, byte_count INT, samples ARRAY<SMALLINT>"
AUDIO_VISUALIZATION = "media_id BIGINT, idx BIGINT, ts DOUBLE, level DOUBLE, sample_rate INT, channels INT, waveform ARRAY<DOUBLE>, spectrum ARRAY<DOUBLE>"
ANALYSIS_EVENTS = "media_id BIGINT, idx BIGINT, severity STRING, type STRING, stream_index INT, pts BIGINT, ts DOUBLE, summary STRING, detail STRING"
SYNC_SAMPLES = "media_id BIGINT, idx BIGINT, audio_ts DOUBLE, video_ts DOUBLE, diff_ms DOUBLE, audio_anchor BOOLEAN"
TIMELINE = "media_id BIGINT, idx BIGINT, category STRING, ts DOUBLE, label STRING, detail STRING"
FRAME_PIXELS = "media_id BIGINT, idx BIGINT, width INT, height INT, format STRING, data BINARY"
PLAYLIST = "pos INT, location STRING, title STRING, album STRING, creator STRING, trackNum STRING, annotation STRING, duration STRING"
MACROBLOCKS = "media_id BIGINT, frame_idx BIGINT, mb_y INT, mb_x INT, q INT, mb_type INT, ref0 INT, ref1 INT"

# Public codes of media types, picture types and packet flags.
VIDEO, AUDIO, DATA, SUBTITLE = 0, 1, 2, 3
I_FRAME, P_FRAME, B_FRAME = 1, 2, 3
FLAG_KEY, FLAG_CORRUPT, FLAG_DISCARD, FLAG_TRUSTED, FLAG_DISPOSABLE = 1, 2, 4, 8, 16
