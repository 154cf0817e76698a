"""Reports, samples, word lists and sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillforge.functions import ctc
from quillforge.functions import signal as G
from quillforge.functions import stats as S
from quillforge.functions import text as T
from quillforge.operators import corpus as C

from ._registry import query, spread, table
from .metric_queries import _PAIRS, _agreement


@query(r"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT w AS word, row_number() OVER (ORDER BY w) + 1 AS id FROM w""")
def word_list_ids(spark, sf):
    """Distinct words in byte order with ids after two reserved ones."""
    words = spread(table(spark, sf, "documents").select("text")).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return C.row_numbers(words, ["word"]).select("word", (F.col("number") + 2).cast("int").alias("id"))


@query("""WITH b AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0]) AS beta), e AS (SELECT vec_id, beta, (embedding[1] - beta < list_max(embedding[2:]))::INT AS hit FROM embeddings, b)
SELECT beta, sum(hit)::BIGINT AS emitted, count(*) AS frames FROM e GROUP BY beta""")
def blank_penalty_sweep(spark, sf):
    """Frames that emit a token, by blank penalty; every row meets a list of five."""
    e = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"), F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0, 4.0)])).alias("beta"))
    top = F.element_at(F.transform(F.array("beta"), lambda b: F.transform("e", lambda x, i: F.when(i == 0, x - b).otherwise(x))), 1)
    return e.withColumn("p", top).groupBy("beta").agg(F.count_if(ctc.argmax(F.col("p")) != 0).alias("emitted"), F.count("*").alias("frames"))


_BETAS = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0)


@query(f"""WITH b AS (SELECT unnest({list(_BETAS)})::DOUBLE AS beta), f AS (SELECT vec_id, vec_id // 10 AS u, embedding::DOUBLE[] AS e FROM embeddings),
t AS (SELECT vec_id, u, e[1] AS blank, list_max(e[2:]) AS top, list_position(e[2:], list_max(e[2:])) AS id FROM f),
p AS (SELECT u, beta, vec_id, CASE WHEN blank - beta >= top THEN 0 ELSE id END AS id FROM t, b UNION ALL SELECT u, -1, vec_id, id FROM t),
c AS (SELECT u, beta, string_agg(chr(48 + id::INT), '' ORDER BY vec_id) FILTER (id <> 0 AND id IS DISTINCT FROM prev) AS s FROM (SELECT *, lag(id) OVER (PARTITION BY u, beta ORDER BY vec_id) AS prev FROM p) GROUP BY u, beta),
w AS (SELECT h.beta, sum(levenshtein(r.s, coalesce(h.s, '')))::BIGINT AS errors, sum(length(r.s))::BIGINT AS words FROM c r JOIN c h ON r.u = h.u AND r.beta = -1 AND h.beta >= 0 GROUP BY h.beta)
SELECT beta, errors, words, beta = (SELECT arg_min(beta, errors * 1000000 + beta) FROM w) AS best FROM w""")
def blank_penalty_wer(spark, sf):
    """Error rate of the greedy path by blank penalty, and the first penalty with the least.

    Ten frames are an utterance, whose reference is its path without the blank.
    """
    e = F.col("embedding").cast("array<double>")
    frames = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).alias("u"), e.alias("e"))
    ids = frames.select("vec_id", "u", (ctc.argmax(F.slice("e", 2, 1 << 30)) + 1).alias("ref"), *[ctc.argmax(ctc.penalize_blank(F.col("e"), b)).alias(f"h{i}") for i, b in enumerate(_BETAS)])
    path = lambda c: ctc.collapse(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col(c).alias("x")))), lambda f: f["x"]))
    paths = ids.groupBy("u").agg(path("ref").alias("ref"), *[path(f"h{i}").alias(f"h{i}") for i in range(len(_BETAS))])
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    each = paths.select(text("ref").alias("ref"), F.explode(F.array(*[F.struct(F.lit(b).alias("beta"), text(f"h{i}").alias("hyp")) for i, b in enumerate(_BETAS)])).alias("x"))
    rates = S.corpus_wer(each.select("ref", "x.beta", "x.hyp"), "ref", "hyp", "beta").select("beta", "errors", "words")
    best = rates.agg(F.min(F.struct("errors", "beta"))["beta"].alias("least"))  # a row per penalty
    return rates.join(F.broadcast(best)).select("beta", "errors", "words", (F.col("beta") == F.col("least")).alias("best"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def cost_summary(spark, sf):
    """Mean, standard deviation and nearest-rank p99 of a cost, over all its readings."""
    e = table(spark, sf, "events")
    top = S.at_ranks(e, "event_type", "value", {"p99": lambda n: F.greatest(F.ceil(F.lit(0.99) * n), F.lit(1)) - 1}).select("event_type", "p99")
    some = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))
    return some.join(top, "event_type")


@query("SELECT user_id, median(value) AS median FROM events WHERE event_id % 9 <= 6 GROUP BY user_id")
def clean_window_median(spark, sf):
    """Median of the readings that were taken under a light load (here: a remainder stands for the load)."""
    return S.clean_median(table(spark, sf, "events").withColumn("load", F.col("event_id") % 9), "load", 6, "value", "user_id")


@query(r"""SELECT CASE WHEN starts_with(source, 'src1') THEN 'ones' ELSE 'others' END AS corpus, count(*) AS n, round(sum(n_chars) / 3600.0, 6) AS hours FROM documents
WHERE NOT regexp_full_match(coalesce(text, ''), '[^\p{L}\p{N}_]*') GROUP BY 1""")
def hours_by_corpus(spark, sf):
    """Rows with a reference that is not empty once normalised, by a prefix of their id, with their hours (a character stands
    for a second)."""
    docs = table(spark, sf, "documents").filter(T.normalize_train_target(F.col("text")) != "")
    corpus = T.prefix_class(F.col("source"), {"src1": "ones"}, "others")
    return docs.groupBy(corpus.alias("corpus")).agg(F.count("*").alias("n"), F.round(C.hours(F.col("n_chars")), 6).alias("hours"))


@query("""SELECT event_type, count(DISTINCT user_id) AS files, count(*) AS segments, round(sum(value), 3) AS audio_s, round(sum(value) / count(*), 1) AS rtfx FROM events GROUP BY event_type""")
def throughput_summary(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type")
    return g.agg(F.count_distinct("user_id").alias("files"), F.count("*").alias("segments"), F.round(F.sum("value"), 3).alias("audio_s"), F.round(F.sum("value") / F.count("*"), 1).alias("rtfx"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 500 ORDER BY doc_id LIMIT 25")
def first_kept(spark, sf):
    """The first rows that pass a filter, in a stable order: the limit is the feature."""
    return table(spark, sf, "documents").filter("lang = 'fr' and n_chars > 500").select("doc_id").orderBy("doc_id").limit(25)


@query("""SELECT source, array_to_string(list_sort(list(doc_id))[1:8], ' ') AS examples FROM documents GROUP BY source""")
def example_capture(spark, sf):
    """Up to eight examples per class, the first in a stable order."""
    ranked = table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("k")).filter("k <= 8")
    return ranked.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), " ").alias("examples"))


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def ordered_concatenation(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["role"]), " ").alias("joined"))


@query("""SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' AS snapshot, strftime(make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM conversations""")
def snapshot_json(spark, sf):
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("snapshot"), at.alias("at"))


@query(f"""WITH {_PAIRS}, e AS (SELECT conv_id * 1000 + turn AS doc_id, cer FROM c), k AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM e),
b AS (SELECT r AS replicate, ('0x' || substr(md5('7:' || r || ':' || s), 1, 8))::BIGINT % (SELECT count(*) FROM e) AS i FROM range(1, 61) t(r), range((SELECT count(*) FROM e)) u(s)),
v AS (SELECT replicate, list_sort(list(cer)) AS v FROM b JOIN k USING (i) GROUP BY replicate), o AS (SELECT v[floor((len(v) - 1) * 0.8)::INT + 1] AS tau FROM v)
SELECT round(quantile_cont(tau, 0.025), 6) AS ci_low, round(quantile_cont(tau, 0.975), 6) AS ci_high FROM o""")
def bootstrap_threshold(spark, sf):
    rows = _agreement(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "cer")
    ci = S.bootstrap_percentile(rows, "doc_id", "cer", 0.8, 60, 7)
    return ci.select(F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("""SELECT doc_id, least(floor(n_chars * 10 / 8000.0), 9)::INT AS bucket FROM documents""")
def duration_bucketing(spark, sf):
    return C.duration_buckets(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 10, 8000.0).select("doc_id", "bucket")


@query("""WITH u AS (SELECT 'a' AS side, doc_id, ('0x' || substr(md5('mux:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id, ('0x' || substr(md5('mux:' || doc_id), 1, 8))::BIGINT / 4294967296.0 FROM documents WHERE lang <> 'en')
SELECT side, doc_id, round(-ln(1 - u) / CASE side WHEN 'a' THEN 0.7 ELSE 0.3 END, 6) AS position FROM u""")
def corpus_mux(spark, sf):
    docs = table(spark, sf, "documents")
    part = lambda side, rule: docs.filter(rule).select(F.lit(side).alias("side"), "doc_id")
    return C.mux([(part("a", "lang = 'en'"), 0.7), (part("b", "lang <> 'en'"), 0.3)], "doc_id").select("side", "doc_id", F.round("position", 6).alias("position"))


@query("""WITH w AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: abs(x)::DOUBLE)) AS w, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT vec_id, i, sum(w) OVER (PARTITION BY vec_id ORDER BY i) AS c, sum(w) OVER (PARTITION BY vec_id) AS t FROM w)
SELECT vec_id, min(i)::INT AS middle FROM s WHERE 2 * c >= t GROUP BY vec_id""")
def middle_layer(spark, sf):
    w = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", w.alias("w")).select("vec_id", G.middle_index(F.col("w")).alias("middle"))


@query("""SELECT label, round(100.0 * avg((value > 0)::INT), 6) AS positive, CASE WHEN min(value) > 0 THEN 'better' WHEN max(value) < 0 THEN 'worse' ELSE 'undecided' END AS verdict FROM (SELECT label, unnest(embedding) AS value FROM embeddings) GROUP BY label""")
def interval_verdicts(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("value"))
    return v.groupBy("label").agg(F.round(100.0 * F.avg((F.col("value") > 0).cast("double")), 6).alias("positive"), S.verdict(F.min("value"), F.max("value")).alias("verdict"))


@query("""WITH x AS (SELECT i // 512 AS n, i % 512 AS k, trunc(sin(i * (2 * pi() * 440 / 16000)) * 16383.5) / 32767.0 * (0.5 - 0.5 * cos(2 * pi() * (i % 512) / 511)) AS x FROM range(31 * 512) t(i)),
d AS (SELECT n, b, pow(sum(x * cos(2 * pi() * k * b / 512)), 2) + pow(sum(x * sin(2 * pi() * k * b / 512)), 2) AS p FROM x, range(257) t(b) GROUP BY n, b),
e AS (SELECT m, CASE WHEN z < 15 THEN z * 200 / 3 ELSE 1000 * exp((z - 15) * ln(6.4) / 27) END AS hz FROM (SELECT m, (15 + ln(8.0) * 27 / ln(6.4)) * m / 129 AS z FROM range(130) t(m))),
g AS (SELECT a.m, a.hz AS lo, b.hz AS mid, c.hz AS hi FROM e a JOIN e b ON b.m = a.m + 1 JOIN e c ON c.m = a.m + 2),
w AS (SELECT m, b, greatest(0, least((b * 31.25 - lo) / (mid - lo), (hi - b * 31.25) / (hi - mid))) * 2 / (hi - lo) AS w FROM g, range(257) t(b)),
l AS (SELECT n, m, ln(sum(p * w) + pow(2, -24)) AS level FROM d JOIN w USING (b) GROUP BY n, m)
SELECT m::INT AS bin, round(avg(level), 3) AS level FROM l GROUP BY m""")
def log_mel_features(spark, sf):
    """Frames of a tone in 128 Slaney bins, transposed: bin, mean level."""
    from quillforge.sources.readers import tone

    t = tone(spark, 1.0).select(G.log_mel("samples").alias("frames")).select(G.transposed(F.col("frames")).alias("bins"))
    return t.select(F.posexplode("bins").alias("bin", "frames")).select("bin", F.round(F.aggregate("frames", F.lit(0.0), lambda a, x: a + x) / F.size("frames"), 3).alias("level"))
