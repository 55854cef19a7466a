"""Files, frames and streams: what is written is read back, what is streamed is drained to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators import vision
from spanline.plans import pipeline
from spanline.plans.entry_queries import LAYOUT, stored
from spanline.plans.scalar_queries import t
from spanline.plans.segment_queries import CFG, FLAGS, MACHINE
from spanline.plans.seq_queries import MARKER
from spanline.sources import files
from spanline.sources.shared import shared_path
from spanline.streaming import streams as st

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "a1_a2_cache_round_trip",
    """SELECT conv_id AS project, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CAST(turn AS VARCHAR) AS segment_id, role AS speaker, md5(text) AS original, turn * 2.0 + 1.5 AS time_end FROM conversations""",
)
def a1(spark, d):
    path = shared_path(spark, "cache")
    files.write_cache(stored(spark, d), path, meta={"video": "v"})
    back = files.read_cache(spark, f"{path}/*")
    project = F.regexp_extract("project", r"project=(-?\d+)/", 1).cast("long")
    return back.select(project.alias("project"), F.col("pos").cast("long").alias("pos"), "segment_id", "speaker", F.md5("text_original").alias("original"), "time_end")


@query(
    "a6_subtitle_files",
    """SELECT conv_id AS project, 11 + count(*) + CAST(max(CASE WHEN turn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM conversations GROUP BY conv_id""",
)
def a6(spark, d):
    path = shared_path(spark, "subtitles")
    files.write_subtitles(pipeline.subtitles_from_cache(stored(spark, d), LAYOUT), path, "project")
    back = spark.read.text(path)
    return back.groupBy(F.col("project").cast("long").alias("project")).agg(F.count("*").alias("lines"))


def grey(spark, d) -> DataFrame:
    """Embeddings as grey frames, of 8 by 8 pixels or else of one row, a video per label.

    Pixels are worked out in single precision, as in SQL; Spark would widen a float times an integer.
    """
    single = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("float")
    level = lambda x: F.floor(single(x) * single(400) + single(128))
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), level(x))).cast("long")), 2, "0"))
    e = t(spark, d, "embeddings").where("embedding IS NOT NULL")
    square = F.size("embedding") == 64
    return e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").cast("int").alias("frame_index"), F.when(square, 8).otherwise(F.size("embedding")).alias("w"), F.when(square, 8).otherwise(1).alias("h"), F.unhex(F.array_join(pixel, "")).alias("gray"))


@query(
    "a7_fan_out_rois",
    """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(CAST(x AS FLOAT) * 400 + 128))) AS INTEGER)) AS p FROM embeddings)
SELECT CAST(label AS VARCHAR) AS video_id, CAST(vec_id AS INTEGER) + 1 AS frame_number, roi, w, h, CASE roi WHEN 'name' THEN printf('%02X%02X', p[11], p[12]) ELSE printf('%02X%02X', p[1], p[2]) END AS head
FROM e, (VALUES ('name', 3, 2), ('text', 8, 8)) v(roi, w, h)""",
)
def a7(spark, d):
    out = vision.fan_out_rois(grey(spark, d), {"name": (2, 1, 5, 3), "text": (-4, 0, 99, 8), "none": (8, 8, 9, 9)})
    return out.select("video_id", "frame_number", "roi", "w", "h", F.left(F.hex("gray"), F.lit(4)).alias("head"))


FEATURES = {"window": 5, "offset": 10.0, "min_area": 2, "max_area": 64, "min_width": 1, "min_height": 1}


@query("h4_frame_features")
def h4(spark, d):
    return vision.frame_features(grey(spark, d), FEATURES)


@query("h4_presence")
def h4_presence(spark, d):
    """What the frames' text masks say of presence (b29's decision)."""
    f = vision.frame_features(grey(spark, d), FEATURES)
    cfg = {"min_components": 2, "max_components": 8, "max_x_min": 0.5, "max_y_span": 0.95, "min_aspect": 0.8, "max_largest": 0.7, "off": 0.05, "on": 0.2}
    said = sc.presence_decision("presence", "components", "x_min", "x_span", "y_span", "largest", cfg)
    return f.select("video_id", "frame_index", said.alias("p")).select("video_id", "frame_index", "p.*")


#: A falling edge and a bright spot, as templates.
EDGE = [[200, 120, 40], [200, 120, 40], [200, 120, 40]]
SPOT = [[0, 0, 0, 0], [0, 250, 250, 0], [0, 250, 250, 0], [0, 0, 0, 0]]


@query(
    "h3_image_match",
    """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(CAST(x AS FLOAT) * 400 + 128))) AS BIGINT)) AS p FROM embeddings),
m AS (SELECT label, vec_id, d, y, x, p[8 * y + least(7, greatest(0, x - d)) + 1] AS v FROM e, (VALUES (0), (-2), (2)) AS s(d), range(8) AS r(y), range(8) AS c(x)),
t AS (SELECT 0 AS n, 3 AS size, y, x, CASE x WHEN 0 THEN 200 WHEN 1 THEN 120 ELSE 40 END AS t FROM range(3) AS r(y), range(3) AS c(x)
  UNION ALL SELECT 1, 4, y, x, CASE WHEN y IN (1, 2) AND x IN (1, 2) THEN 250 ELSE 0 END FROM range(4) AS r(y), range(4) AS c(x)),
win AS (SELECT label, vec_id, d, t.n, t.size, oy, ox, count(*) AS k, sum(v) AS sv, sum(v * v) AS svv, sum(t) AS st, sum(t * t) AS stt, sum(v * t) AS svt
  FROM (SELECT DISTINCT n, size FROM t) q, range(6) AS a(oy), range(6) AS b(ox), m, t WHERE t.n = q.n AND oy + t.size <= 8 AND ox + t.size <= 8 AND m.y = oy + t.y AND m.x = ox + t.x GROUP BY ALL)
SELECT CAST(label AS VARCHAR) AS video_id, CAST(vec_id AS INTEGER) AS frame_index,
  round(greatest(0, least(1, max(CASE WHEN k * svv = sv * sv THEN 0 ELSE (k * svt - sv * st) / sqrt(CAST(k * svv - sv * sv AS DOUBLE) * (k * stt - st * st)) END))), 6) AS score FROM win GROUP BY label, vec_id""",
)
def h3_images(spark, d):
    """The embeddings as frames of 8 by 8 pixels, against two templates slid over them and moved sideways."""
    out = vision.match_images(grey(spark, d), [EDGE, SPOT], 2, 2, "horizontal")
    return out.select("video_id", "frame_index", F.round("score", 6).alias("score"))


def stream_table(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files: its folder, or the one file of that name."""
    reader = spark.readStream.schema(t(spark, d, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("g1_stream_join_prune", "SELECT event_id, value AS marker_score FROM events WHERE value >= 35")
def g1(spark, d):
    """Text and marker frames as two streams over the events."""

    def stream():
        return stream_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))

    joined = st.stream_join_prune(stream().select("event_id", "at"), stream().select("event_id", "at", "value"), ["event_id"], "at", "value", 35.0, "400 days")
    return st.run_to_table(joined, shared_path(spark, "stream")).select("event_id", "marker_score")


@query(
    "g4_stream_pairs",
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' WHEN 'error' THEN 'error' END AS ev FROM events),
p AS (SELECT *, lag(ev) OVER w AS pe, lag(event_id) OVER w AS pi FROM e WHERE ev IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id AS id, CASE WHEN pe = 'request' THEN pi END AS request_id FROM p WHERE ev <> 'request'""",
)
def g4(spark, d):
    """The events as one stream; files must hold rising event ids, as they do."""
    e = stream_table(spark, d, "events")
    ev = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "response").when(F.col("event_type") == "error", "error").otherwise("other")
    pairs = st.stream_pairs(e.select("user_id", F.col("event_id").alias("id"), ev.alias("event"), F.lit(False).alias("eof")), ["user_id"])
    return st.run_to_table(pairs, shared_path(spark, "stream"))


#: Seconds without an event after which a user's input has ended, and by which events may be late.
QUIET, LATE = 100_000, 3600
#: f: the events of each user from one silence to the next, under a key of their own, with places from 0; wm: the last watermark.
SESSIONS = f"""src AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
fresh AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY event_id) > {QUIET} * 1000 THEN 1 ELSE 0 END AS fresh FROM src),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS ses, max(ms) OVER (PARTITION BY user_id) AS until FROM fresh),
f AS (
  SELECT CAST(user_id * 1000000 + ses AS BIGINT) AS user_id, event_id, value, epoch_us(ts) / 1000000.0 AS at, until,
         row_number() OVER (PARTITION BY user_id, ses ORDER BY event_id) - 1 AS i, ses = max(ses) OVER (PARTITION BY user_id) AS final FROM ses),
wm AS (SELECT max(ms) - {LATE} * 1000 AS wm FROM src)"""


@query(
    "g2_stream",
    f"""WITH RECURSIVE {SESSIONS}, m AS (SELECT user_id, i, {FLAGS} FROM f),
open AS (SELECT DISTINCT user_id FROM f, wm WHERE final AND until + {QUIET} * 1000 > wm),
{MACHINE.format(ended=" AND user_id NOT IN (SELECT user_id FROM open)", idx="i")},
said AS (SELECT user_id, r, unnest(string_split(samples, ',')) AS n FROM s WHERE samples <> ''),
ids AS (SELECT said.user_id, r, string_agg(event_id, ',' ORDER BY event_id) AS heard FROM said JOIN f ON f.user_id = said.user_id AND f.i = CAST(n AS BIGINT) GROUP BY said.user_id, r)
SELECT s.user_id // 1000000 AS user_id, x.event_id AS frame_start, y.event_id AS frame_end, coalesce(heard, '') AS samples
FROM s JOIN f x ON x.user_id = s.user_id AND x.i = a JOIN f y ON y.user_id = s.user_id AND y.i = b LEFT JOIN ids ON ids.user_id = s.user_id AND ids.r = s.r
WHERE y.at - x.at >= 1""",
)
def g2_stream(spark, d):
    """The events as a stream, through the dialogue machine; silent users end, and their state goes, by event-time timers."""
    e = stream_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    value, n = F.col("value"), F.col("event_id")
    flags = sc.flags(value, (n % 10) / 10, value, n % 4 / 2, CFG)
    rows = e.select("user_id", n.alias("idx"), F.col("at").cast("double").alias("ts"), "at", flags.alias("f"), F.lit(False).alias("eof")).select("user_id", "idx", "ts", "at", "f.*", "eof")
    out = st.run_to_table(st.stream_segments(rows, ["user_id"], CFG, "dialogue", "at", QUIET, f"{LATE} seconds"), shared_path(spark, "stream"))
    return out.select("user_id", "frame_start", "frame_end", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query(
    "g3_stream",
    f"""WITH RECURSIVE {SESSIONS}, sm AS (SELECT *, value >= 35 AS raw FROM f),
{MARKER}
SELECT user_id // 1000000 AS user_id, s AS frame_start, t AS frame_end, sample FROM rep""",
)
def g3_stream(spark, d):
    """The events as a stream, cut where the marker disappears; places count from each user's last silence."""
    e = stream_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = e.select("user_id", F.col("event_id").alias("idx"), "at", (F.col("value") >= 35).alias("on"), F.lit(False).alias("eof"))
    return st.run_to_table(st.stream_segments(rows, ["user_id"], {"min_on": 2, "min_off": 2}, "marker", "at", QUIET, f"{LATE} seconds"), shared_path(spark, "stream"))


@query(
    "g5_stream",
    """WITH c AS (SELECT *, conv_id * 3600 + turn AS s FROM conversations), r AS (SELECT conv_id, max(s) AS until, md5(string_agg(text, '' ORDER BY turn) FILTER (turn % 5 <> 4)) AS content,
  CASE WHEN count(*) FILTER (turn = 3) > 0 THEN 'stop' END AS finish, count(*) FILTER (turn % 5 = 4) AS malformed FROM c GROUP BY conv_id)
SELECT conv_id, content, finish, malformed FROM r WHERE until + 600 <= (SELECT max(s) FROM c) - 60""",
)
def g5_stream(spark, d):
    """Conversations as a stream of lines, an hour from one to the next: those that the watermark has passed come out."""
    c = stream_table(spark, d, "conversations")
    js = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"), F.when(F.col("turn") == 3, "stop").alias("finish_reason"))).alias("choices")))
    line = F.when(F.col("turn") % 5 == 4, "data: {oops").otherwise(F.concat(F.lit("data: "), js))
    rows = c.select("conv_id", F.col("turn").alias("seq"), line.alias("line"), F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") + 1).alias("at"))
    done = st.run_to_table(st.stream_chunks(rows, "conv_id", "at", "10 minutes", "1 minute"), shared_path(spark, "stream"))
    return done.select("conv_id", F.md5("content").alias("content"), "finish", "malformed")
