"""Token sequences, vocabularies, signals over embeddings and conversations, and streaming twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillforge.functions import align as A
from quillforge.functions import ctc
from quillforge.functions import signal as G
from quillforge.functions import text as T
from quillforge.operators import corpus as C
from quillforge.streaming import live

from ._registry import query, spread, table

_IDS = {"signup": 0, "error": 1, "click": 2, "view": 3, "purchase": 4}


def _paths(spark, sf):
    """Event types of a user in order, as frame ids; signup is the blank."""
    ids = F.create_map(*[F.lit(x) for kv in _IDS.items() for x in kv])
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id", F.element_at(ids, F.col("event_type")).alias("id")).alias("s"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["id"]).alias("path"))


_PATH_SQL = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS id FROM events)"""


@query(f"""WITH {_PATH_SQL}, p AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY i) AS prev FROM f)
SELECT user_id, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY i) FILTER (id <> 0 AND (prev IS NULL OR prev <> id)), '') AS ids FROM p GROUP BY user_id""")
def ctc_collapse(spark, sf):
    return _paths(spark, sf).select("user_id", F.array_join(ctc.collapse(F.col("path")).cast("array<string>"), " ").alias("ids"))


@query(f"""WITH {_PATH_SQL}, p AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY i) AS prev FROM f)
SELECT user_id, trim(replace(coalesce(string_agg(CASE id WHEN 1 THEN '▁er' WHEN 2 THEN 'cl' WHEN 3 THEN '▁vi' ELSE '' END, '' ORDER BY i) FILTER (id <> 0 AND (prev IS NULL OR prev <> id)), ''), '▁', ' ')) AS text FROM p GROUP BY user_id""")
def ctc_text(spark, sf):
    pieces = F.create_map(F.lit(1), F.lit("▁er"), F.lit(2), F.lit("cl"), F.lit(3), F.lit("▁vi"))
    return _paths(spark, sf).select("user_id", T.detokenize(ctc.to_pieces(ctc.collapse(F.col("path")), pieces)).alias("text"))


@query("""SELECT * FROM (VALUES (1, 'o 0.0 lula 0.12 bom 0.28'), (2, 'o 10.0 bom 10.08'), (3, ''), (4, 'la 0.0 bom 0.04')) t(id, words)""")
def ctc_words(spark, sf):
    pieces = F.create_map(F.lit(1), F.lit("▁o"), F.lit(2), F.lit("▁lu"), F.lit(3), F.lit("la"), F.lit(4), F.lit("▁bom"))
    rows = [(1, [1, 1, 0, 2, 2, 3, 0, 4], 0.0), (2, [1, 0, 4], 10.0), (3, [0, 0], 0.0), (4, [3, 4], 0.0)]
    df = spark.createDataFrame(rows, "id int, path array<int>, t0 double")
    words = ctc.timed_words(F.col("path"), pieces, 0.04, F.col("t0"))
    return df.select("id", F.array_join(F.transform(words, lambda w: F.concat(w["w"], F.lit(" "), F.round(w["t"], 6).cast("string"))), " ").alias("words"))


@query("""SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS first, len(embedding) - list_position(list_reverse(embedding), list_max(embedding)) AS last,
CASE WHEN embedding[1] - 1.5 >= list_max(embedding[2:]) THEN 0 ELSE list_position(embedding[2:], list_max(embedding[2:])) END AS penalized FROM embeddings""")
def ctc_argmax(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", ctc.argmax(e).alias("first"), ctc.argmax(e, "last").alias("last"), ctc.argmax(ctc.penalize_blank(e, 1.5)).alias("penalized"))


@query("""WITH b AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS bin FROM embeddings)
SELECT label, bin, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8, 6) AS std FROM b GROUP BY ALL""")
def mel_bin_stats(spark, sf):
    b = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("bin", "v"))
    return b.groupBy("label", "bin").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("v").cast("double")) + 1e-8, 6).alias("std"))


@query("""WITH b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS bin FROM embeddings), s AS (SELECT bin, avg(v) AS m, stddev_pop(v) + 1e-8 AS d FROM b GROUP BY bin)
SELECT vec_id, round(sum((v - m) / d * 2 + 1), 3) AS total FROM b JOIN s USING (bin) GROUP BY vec_id""")
def affine_align(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select(F.posexplode("embedding").alias("bin", "v")).groupBy("bin").agg(F.avg(F.col("v").cast("double")).alias("m"), (F.stddev_pop(F.col("v").cast("double")) + 1e-8).alias("d"))
    stats = b.agg(F.array_sort(F.collect_list(F.struct("bin", "m", "d"))).alias("s"))  # one row of as many entries as bins
    s = e.join(F.broadcast(stats))
    ones = lambda v: F.transform("s", lambda x: F.lit(v))
    aligned = G.align_bins(F.col("embedding").cast("array<double>"), F.transform("s", lambda x: x["m"]), F.transform("s", lambda x: x["d"]), ones(1.0), ones(2.0))
    return s.select("vec_id", F.round(F.aggregate(aligned, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 20000)::INT) AS v FROM embeddings),
f AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: (x / 32767.0) * (x / 32767.0))) / len(v)) AS rms, list_sum(list_transform(list_zip(v[:-2], v[2:]), lambda p: ((p[1] >= 0) <> (p[2] >= 0))::INT)) / len(v) AS zcr FROM s)
SELECT vec_id, round(rms, 6) AS rms, round(zcr, 6) AS zcr, list_max(v) <> list_min(v) AND least(rms * 15, 1) >= 0.5 AS speech FROM f""")
def rms_zcr_vad(spark, sf):
    v = F.transform("embedding", lambda x: F.round(x.cast("float") * F.lit(20000).cast("float")).cast("int"))
    s = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return s.select("vec_id", F.round(G.rms(F.col("v")), 6).alias("rms"), F.round(G.zero_crossing_rate(F.col("v")), 6).alias("zcr"), G.is_speech(F.col("v")).alias("speech"))


@query("""WITH h AS (SELECT id::DOUBLE * 61 AS hz FROM range(130) t(id)), c AS (SELECT list(id * 125.0 ORDER BY id) AS centers FROM range(64) t(id))
SELECT hz, round(1127 * ln(1 + hz / 700), 6) AS htk, round(CASE WHEN hz < 1000 THEN hz * 3 / 200 ELSE 15 + ln(hz / 1000) * 27 / ln(6.4) END, 6) AS slaney,
list_position(list_transform(centers, lambda x: abs(x - hz)), list_min(list_transform(centers, lambda x: abs(x - hz)))) - 1 AS bin FROM h, c""")
def mel_scales(spark, sf):
    h = spark.range(130).select((F.col("id") * 61.0).alias("hz"))
    centers = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 125.0)
    return h.select("hz", F.round(G.mel_htk(F.col("hz")), 6).alias("htk"), F.round(G.mel_slaney(F.col("hz")), 6).alias("slaney"), G.nearest_bin(centers, F.col("hz")).alias("bin"))


@query("""SELECT i, round(0.5 - 0.5 * cos(2 * pi() * i / 399), 9) AS hann, round(pow(0.5 - 0.5 * cos(2 * pi() * i / 399), 0.85), 9) AS povey, (i * 1600 + 80) // 160 AS frames FROM range(400) t(i)""")
def frame_windows(spark, sf):
    w = spark.range(1).select(F.posexplode(F.arrays_zip(G.hann(400).alias("h"), G.povey(400).alias("p"))).alias("i", "w"))
    return w.select("i", F.round("w.h", 9).alias("hann"), F.round("w.p", 9).alias("povey"), G.frame_count(F.col("i") * 1600).alias("frames"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM s)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, list_concat(v[1:1], v[:-2])), lambda p: abs(p[1] - 0.97 * p[2]))), 5) AS energy FROM d""")
def frame_conditioning(spark, sf):
    """Offset removal and pre-emphasis."""
    v = G.preemphasis(G.without_offset(F.col("embedding").cast("array<double>")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("energy"))


@query("""WITH x AS (SELECT i, trunc(sin(i * (2 * pi() * 440 / 16000)) * 16383.5) / 32768.0 AS x FROM range(48000) t(i)),
a AS (SELECT n, k, (n * 160 - 120 + k + 96000) % 96000 AS i FROM range(300) f(n), range(400) w(k)),
j AS (SELECT n, k, x.x - avg(x.x) OVER (PARTITION BY n) AS x FROM a JOIN x ON x.i = CASE WHEN a.i < 48000 THEN a.i ELSE 95999 - a.i END),
e AS (SELECT n, k, (x - 0.97 * coalesce(lag(x) OVER (PARTITION BY n ORDER BY k), x)) * pow(0.5 - 0.5 * cos(2 * pi() * k / 399), 0.85) AS x FROM j),
d AS (SELECT n, b, pow(sum(x * cos(2 * pi() * k * b / 512)), 2) + pow(sum(x * sin(2 * pi() * k * b / 512)), 2) AS p FROM e, range(256) t(b) GROUP BY n, b),
h AS (SELECT 1127 * ln(1 + 20 / 700.0) AS lo, 1127 * ln(1 + 7600 / 700.0) AS hi), g AS (SELECT m, lo + (hi - lo) * m / 81 AS e0, (hi - lo) / 81 AS s FROM h, range(80) t(m)),
w AS (SELECT m, b, greatest(0, least((z - e0) / s, (e0 + 2 * s - z) / s)) AS w FROM (SELECT m, b, e0, s, 1127 * ln(1 + b * 31.25 / 700) AS z FROM g, range(256) t(b))),
l AS (SELECT n, m, ln(greatest(sum(p * w), 1.1920929e-07)) AS level FROM d JOIN w USING (b) GROUP BY n, m)
SELECT n::INT AS frame, arg_max(m, level)::INT AS bin, round(max(level), 3) AS level FROM l GROUP BY n""")
def fbank_features(spark, sf):
    """Log-mel frames of a tone of three seconds: frame, loudest bin, level."""
    from quillforge.sources.readers import tone

    f = tone(spark, 3.0).select(F.posexplode(G.fbank("samples")).alias("frame", "bins"))
    return f.select("frame", ctc.argmax(F.col("bins").cast("array<double>")).alias("bin"), F.round(F.array_max("bins").cast("double"), 3).alias("level"))


@query("""WITH x AS (SELECT trunc(sin(i * (2 * pi() * 440 / 16000)) * 16383.5)::BIGINT AS x FROM range(8000) t(i)),
s AS (SELECT x, floor(x / 8.0)::BIGINT AS a, floor(x / 4.0)::BIGINT AS u FROM x),
m AS (SELECT x, a < 0 AS an, CASE WHEN a < 0 THEN -a - 1 ELSE a END AS a, u < 0 AS un, least(abs(u), 8158) + 33 AS u FROM s),
k AS (SELECT *, greatest(floor(log2(greatest(a, 1))) - 4, 1)::INT AS sa, (floor(log2(u)) - 5)::INT AS su FROM m),
o AS (SELECT x, (CASE WHEN an THEN -8 ELSE 8 END) * (a - a % (1 << sa) + (1 << (sa - 1))) AS a, (CASE WHEN un THEN -4 ELSE 4 END) * (u - u % (1 << (su + 1)) + (1 << su) - 33) AS u FROM k)
SELECT max(abs(x - a))::INT AS g711a, max(abs(x - u))::INT AS g711u, 0 AS identity, 0 AS length_change FROM o""")
def codec_round_trips(spark, sf):
    """Largest error of each codec on a tone, and of the telephone channel's length."""
    from quillforge.sources.readers import tone

    t = tone(spark, 0.5)
    worst = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    s = F.col("samples")
    return t.select(*[worst(s, G.apply_codec(s, c)).alias(c) for c in sorted(G.CODECS)], (F.size(G.telephone(s)) - F.size(s)).alias("length_change"))


@query("SELECT * FROM (VALUES ('long', 0, 324960), ('long', 324960, 656000), ('short', 0, 336000)) t(kind, a, b)")
def energy_segmentation(spark, sf):
    """Segments of tone, a second of silence, and tone again.

    Of 21 s there is one.  Of 41 s there are two: the silence is from sample 320,000 on, its first frame of 480 samples
    is number 667, and the cut is where the eleventh starts, 677 x 480.
    """
    from quillforge.sources.readers import tone

    silence = F.array_repeat(F.lit(0).cast("smallint"), 16_000)
    both = [tone(spark, s).select(F.lit(kind).alias("kind"), F.concat("samples", silence, "samples").alias("s")) for kind, s in (("short", 10.0), ("long", 20.0))]
    return both[0].unionByName(both[1]).select("kind", F.explode(G.segments("s")).alias("x")).select("kind", "x.a", "x.b")


@query("""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(text, ' ') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
k AS (SELECT *, list_position(list_transform(list_zip(x[:least(len(x), len(y))], y[:least(len(x), len(y))]), lambda z: z[1] = z[2]), false) AS d FROM p)
SELECT conv_id, turn, CASE WHEN d > 0 THEN d - 1 ELSE least(len(x), len(y)) END::BIGINT AS shared FROM k""")
def lcp_prefix(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(A.common_prefix(F.col("w"), F.col("y"))).cast("long").alias("shared"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS start, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, start::BIGINT AS start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), total)::BIGINT AS stop FROM c""")
def transcript_blocks_lead(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = c.withColumns({"start": (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).cast("long"), "total": F.sum("n").over(Window.partitionBy("conv_id")).cast("long")})
    return c.select("conv_id", "turn", "start", F.lead("start").over(w).alias("next"), "total").select("conv_id", "turn", "start", F.coalesce("next", "total").alias("stop"))


_VOCAB = r"""w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) - 1 AS pos FROM documents),
v AS (SELECT w AS token, row_number() OVER (ORDER BY min({'d': doc_id, 'p': pos}), w) + 1 AS id FROM w GROUP BY w)"""


def _vocabulary(spark, sf):
    words = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    return C.first_seen_vocabulary(words, ["doc_id", "pos"], "token")


@query(f"WITH {_VOCAB} SELECT token, id FROM v")
def vocab_first_seen(spark, sf):
    return _vocabulary(spark, sf)


@query(f"WITH {_VOCAB} SELECT sha256(string_agg(id || chr(9) || token || chr(10), '' ORDER BY id)) AS fingerprint, count(*) AS size, count_if(NOT regexp_matches(token, '^#[0-9]+$')) AS real_len FROM v")
def vocab_fingerprint(spark, sf):
    return C.vocabulary_fingerprint(_vocabulary(spark, sf))


@query("""WITH s AS (SELECT vec_id, unnest([{'id': 0, 'start': 0.5, 'd': 2.0}, {'id': 1, 'start': 1.25, 'd': 0.5}]) AS s, 1.0 + (vec_id % 10) / 10.0 AS dur FROM embeddings)
SELECT vec_id, s.id AS id, round(CASE WHEN s.start + s.d > dur THEN dur - s.start ELSE s.d END, 4) AS duration FROM s""")
def clamp_supervisions(spark, sf):
    sups = F.array(F.struct(F.lit(0).alias("id"), F.lit(0.5).alias("start"), F.lit(2.0).alias("duration")), F.struct(F.lit(1).alias("id"), F.lit(1.25).alias("start"), F.lit(0.5).alias("duration")))
    e = table(spark, sf, "embeddings").select("vec_id", (1.0 + (F.col("vec_id") % 10) / 10.0).alias("dur"))
    return e.select("vec_id", F.explode(C.clamp(sups, F.col("dur"))).alias("s")).select("vec_id", "s.id", F.round("s.duration", 4).alias("duration"))


# ---------------------------------------------------------------- streams


@query("SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    out = live.tumbling_counts(live.event_stream(spark, sf), "1 hour")
    return live.run_to_table(out, "complete").select("event_type", F.unix_seconds("start").alias("hour"), "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(spark, sf):
    return live.run_to_table(live.sessions(live.event_stream(spark, sf), "6 hours"), "complete").select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS first FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, sf):
    return live.run_to_table(live.event_stream(spark, sf).select("user_id", "event_type").dropDuplicates(), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("first"))


@query("""SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY 1""")
def stream_interval_join(spark, sf):
    return live.run_to_table(live.interval_join(live.event_stream(spark, sf), "click", "purchase", 3600), "append").groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("""WITH s AS (SELECT user_id, ts, event_id, (event_type = 'purchase')::INT AS used FROM events),
c AS (SELECT user_id, sum(1 - used) OVER w AS produced, sum(used) OVER w AS consumed, greatest(sum(1 - 2 * used) OVER w, 0)::BIGINT AS backlog, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, k - greatest(n - 4096, 0) AS i, least(n, 4096) AS m FROM c WHERE k > n - 4096)
SELECT user_id, max(produced)::BIGINT AS produced, max(consumed)::BIGINT AS consumed, arg_max(backlog, k) AS backlog, quantile_disc(backlog, 0.5) AS p50, quantile_disc(backlog, 0.95) AS p95, quantile_disc(backlog, 0.99) AS p99,
max(m) >= 4 AND avg(backlog) FILTER (i > m // 2) > avg(backlog) FILTER (i <= m // 2) AND arg_max(backlog, k) > 0 AS growing FROM h GROUP BY user_id""")
def stream_backlog(spark, sf):
    """Final state of the stateful backlog: counters, percentiles of the latest readings and their trend."""
    return live.run_backlog(spark, sf)


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS stream_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations), s AS (SELECT stream_id, n, least(3 * (greatest(4, ceil(n / 3)::INT) - 1), n) AS committed FROM t)
SELECT stream_id, committed::INT AS committed, (n - committed)::INT AS tail FROM s""")
def local_agreement(spark, sf):
    """Words committed by LocalAgreement-2 over each turn's growing prefixes, batch form: all of the hypothesis before the last."""
    return live.committed_words(table(spark, sf, "conversations"))


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS stream_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations), s AS (SELECT stream_id, least(3 * (greatest(4, ceil(n / 3)::INT) - 1), n) AS committed FROM t)
SELECT stream_id, committed::INT AS committed, (committed // 18)::INT AS lines FROM s""")
def live_captions(spark, sf):
    """Committed words and full caption lines of each turn: three words are committed a step, so a line ends at eighteen.

    Lines that end by silence have no words after them in this input; a turn's last line stays open.
    """
    out = live.captions_batch(live.prefixes(table(spark, sf, "conversations")))
    return out.groupBy("stream_id").agg(F.sum(F.size("committed")).cast("int").alias("committed"), F.count_if(F.size(F.split("line", " ")) >= live.LINE_WORDS).cast("int").alias("lines"))


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 500 MILLISECOND, ts, TIMESTAMP '1970-01-01')) + 500000 AS due, count(*) AS n FROM events GROUP BY ALL")
def stream_hops(spark, sf):
    """Events by user and half a second."""
    return live.run_to_table(live.hops(live.event_stream(spark, sf)), "complete").select("user_id", F.unix_micros("due").alias("due"), "n")
