"""Joins, leakage, agreement, error rates, bootstrap, percentiles, harness and stream-metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillforge.functions import align as A
from quillforge.functions import quality as Q
from quillforge.functions import signal as G
from quillforge.functions import stats as S
from quillforge.functions import text as T
from quillforge.operators import corpus as C
from quillforge.streaming.live import HISTORY

from ._registry import query, spread, table

# ---------------------------------------------------------------- joins, sets, leakage


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)")
def manifest_join(spark, sf):
    return C.join_supervisions(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("""SELECT d.doc_id, coalesce(a.quality, b.quality) AS quality FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id - 1""")
def manifest_label_fallback(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") - 1).alias("other"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), "quality")
    return C.label_with_fallback(docs, labels, "doc_id", "other", "quality", strict=False).select("doc_id", "quality")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def keep_semi(spark, sf):
    return C.keep_only(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark, sf):
    return C.missing(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT doc_id, CASE WHEN r IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id, 1 AS l FROM documents WHERE lang = 'en') FULL JOIN (SELECT DISTINCT doc_id, 1 AS r FROM labels) USING (doc_id) WHERE l IS NULL OR r IS NULL""")
def unpaired_full_outer(spark, sf):
    return C.unpaired(table(spark, sf, "documents").filter("lang = 'en'"), table(spark, sf, "labels"), "doc_id")


@query("""WITH k AS (SELECT lang, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, md5(text) AS h FROM documents), d AS (SELECT DISTINCT * FROM k)
SELECT a.lang, a.split AS split_a, b.split AS split_b, count(*) AS keys FROM d a JOIN d b ON a.lang = b.lang AND a.h = b.h AND a.split < b.split GROUP BY ALL""")
def split_overlap_keys(spark, sf):
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "dev").otherwise("test")
    return C.split_overlap(table(spark, sf, "documents").select("lang", split.alias("split"), F.md5(F.col("text").cast("binary")).alias("h")), "split", "lang", "h")


@query("""SELECT source AS corpus, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM documents WHERE NOT regexp_matches(text, '[0-9]') GROUP BY ALL""")
def unverifiable_keys(spark, sf):
    """Rows whose key (here: a text's first number) is missing, by corpus and split."""
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "dev").otherwise("test")
    key = F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit(""))
    return C.unverifiable(table(spark, sf, "documents").select(F.col("source").alias("corpus"), split.alias("split"), key.alias("key")), "split", "corpus", "key")


@query("""WITH r AS (SELECT lang, CASE WHEN regexp_full_match(coalesce(text, ''), '[^\\p{L}\\p{N}_]*') THEN 'empty' WHEN coalesce(quality, 0) - coalesce(toxic, 0) < 0 THEN 'filtered' WHEN quality IS NULL THEN 'missing' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS total, count_if(reason = 'kept') AS kept, count_if(reason = 'missing') AS missing, count_if(reason = 'empty') AS empty, count_if(reason = 'filtered') AS filtered FROM r GROUP BY lang""")
def corpus_reason_counts(spark, sf):
    """Documents stand for segments, labels for votes, and a document without a label for one without its recording."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    votes = Q.net_votes(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return C.corpus_counts(rows, T.normalize_train_target(F.col("text")), votes, 0, F.col("quality").isNotNull(), "lang")


@query(r"""WITH b AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(text, '[/\-_.\s]+'), lambda x: length(x) >= 8)) AS tok FROM benchmark),
d AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[/\-_.\s]+'), lambda x: length(x) >= 8)) AS tok FROM documents)
SELECT item_id, count(*) AS tokens FROM b JOIN d USING (tok) GROUP BY item_id""")
def benchmark_leak_tokens(spark, sf):
    one = table(spark, sf, "benchmark").select("item_id", F.explode(T.path_tokens(F.col("text"))).alias("tok")).distinct()
    two = spread(table(spark, sf, "documents").select("text")).select(F.explode(T.path_tokens(F.col("text"))).alias("tok")).distinct()
    return one.join(two, "tok").groupBy("item_id").agg(F.count("*").alias("tokens"))


@query(r"""WITH t AS (SELECT DISTINCT url, unnest(list_filter(regexp_split_to_array(url, '[/\-_.\s]+'), lambda x: length(x) >= 4)) AS tok FROM pages), i AS (SELECT DISTINCT split_part(source, '-', 1) AS tok FROM documents UNION SELECT 'example')
SELECT tok, count(*) AS paths FROM t JOIN i USING (tok) GROUP BY tok""")
def token_leaks(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.explode(T.path_tokens(F.col("url"), 4)).alias("tok")).distinct()
    ids = table(spark, sf, "documents").select(F.substring_index("source", "-", 1).alias("tok")).union(spark.sql("select 'example'")).distinct()
    return pages.join(ids, "tok").groupBy("tok").agg(F.count("*").alias("paths"))


@query("SELECT md5(text) AS h FROM documents UNION SELECT md5(text) FROM benchmark")
def union_distinct_texts(spark, sf):
    h = F.md5(F.col("text").cast("binary")).alias("h")
    return table(spark, sf, "documents").select(h).union(table(spark, sf, "benchmark").select(h)).distinct()


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def shared_keys_intersect(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'signup'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id"))


@query("""SELECT i FROM (SELECT DISTINCT round_even(id * 1763 / 39.0, 0)::BIGINT AS i FROM range(40) t(id))""")
def even_shards(spark, sf):
    return C.even_indices(spark, 1764, 40)


@query("""SELECT doc_id, round(u, 6) AS u, u < 0.35 AS hit, CASE WHEN u < 0.5 THEN 'g711a' WHEN u < 0.8 THEN 'g711u' ELSE 'identity' END AS codec
FROM (SELECT doc_id, ('0x' || substr(md5('aug:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)""")
def weighted_choice(spark, sf):
    u = C.uniform("aug", F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.round(u, 6).alias("u"), (u < 0.35).alias("hit"), C.weighted_choice(u, [("g711a", 5), ("g711u", 3), ("identity", 2)]).alias("codec"))


# ---------------------------------------------------------------- agreement and error rates

_PAIRS = r"""p AS (SELECT u.conv_id, u.turn, regexp_replace(lower(u.text), '[^a-z ]', '', 'g') AS a, regexp_replace(lower(v.text), '[^a-z ]', '', 'g') AS b
  FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant'),
c AS (SELECT conv_id, turn, CASE WHEN a = '' AND b = '' THEN 0.0 WHEN a = '' OR b = '' THEN 1.0 ELSE levenshtein(a, b) / length(a)::DOUBLE END AS cer FROM p)"""


def _agreement(spark, sf):
    """Pairs of whole normalised turns."""
    clean = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", clean.alias("t"))
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("t").alias("a"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("b"))
    return users.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", A.pairwise_cer(F.col("a"), F.col("b")).alias("cer"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round(cer, 6) AS cer FROM c")
def agreement_cer(spark, sf):
    return _agreement(spark, sf).select("conv_id", "turn", F.round("cer", 6).alias("cer"))


@query(f"WITH {_PAIRS}, o AS (SELECT list_sort(list(cer)) AS v FROM c) SELECT round(v[floor((len(v) - 1) * 0.8)::INT + 1], 6) AS tau FROM o")
def calibrate_tau(spark, sf):
    return S.calibrated_threshold(_agreement(spark, sf), "cer", 0.8).select(F.round("tau", 6).alias("tau"))


@query(f"WITH {_PAIRS}, o AS (SELECT list_sort(list(cer)) AS v FROM c), t AS (SELECT v[floor((len(v) - 1) * 0.8)::INT + 1] AS tau FROM o) SELECT conv_id, turn, round(cer, 6) AS cer FROM c, t WHERE cer <= tau")
def agreement_filter(spark, sf):
    pairs = _agreement(spark, sf)
    tau = S.calibrated_threshold(pairs, "cer", 0.8)  # one row
    return pairs.join(F.broadcast(tau), F.col("cer") <= F.col("tau")).select("conv_id", "turn", F.round("cer", 6).alias("cer"))


# A hypothesis drops every eleventh word and puts a blank, which no text has as a word, for every seventh.  Each blank costs
# an edit and so does each word that is missing, whatever the alignment: the distance is the number of changed places.
_ERRORS = r"""w AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents),
e AS (SELECT doc_id, lang, n, len(list_filter(range(1, n + 1), lambda i: (doc_id + i) % 11 = 0 OR (doc_id + i) % 7 = 0))::BIGINT AS err FROM w)"""


def _pairs(spark, sf):
    """References are whole texts; hypotheses drop or replace some of their words."""
    words = T.tokens(F.col("text"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", words.alias("r"))
    turn = lambda x, i, k: (F.col("doc_id") + i + 1) % k == 0
    hyp = F.array_compact(F.transform("r", lambda x, i: F.when(turn(x, i, 11), F.lit(None)).when(turn(x, i, 7), F.lit(" ")).otherwise(x)))
    return docs.withColumn("h", hyp)


def _errors(spark, sf):
    return _pairs(spark, sf).select("doc_id", "lang", F.size("r").cast("long").alias("n"), A.word_distance(F.col("r"), F.col("h")).cast("long").alias("err"))


@query(f"WITH {_ERRORS} SELECT lang, sum(err)::BIGINT AS errors, sum(n)::BIGINT AS words, round(sum(err) * 100.0 / greatest(sum(n), 1), 6) AS wer FROM e GROUP BY lang")
def wer_by_lang(spark, sf):
    return _errors(spark, sf).groupBy("lang").agg(F.sum("err").alias("errors"), F.sum("n").alias("words"), F.round(S.micro_rate(F.col("err"), F.col("n")), 6).alias("wer"))


@query(f"""WITH {_ERRORS}, s AS (SELECT doc_id, n, err FROM e) SELECT doc_id, round(sum(err) OVER x * 100.0 / greatest(sum(n) OVER x, 1), 6) AS wer FROM s WINDOW x AS (PARTITION BY doc_id // 50 ORDER BY doc_id)""")
def running_wer(spark, sf):
    """Cumulative rate within blocks of fifty utterances."""
    w = Window.partitionBy(F.floor(F.col("doc_id") / 50)).orderBy("doc_id")
    return _errors(spark, sf).select("doc_id", F.round(F.sum("err").over(w) * 100.0 / F.greatest(F.sum("n").over(w), F.lit(1)), 6).alias("wer"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS r FROM documents), h AS (SELECT r, list_filter(r, lambda x, i: (doc_id + i) % 6 <> 0) AS h FROM w)
SELECT sum(length(array_to_string(r, '')) - length(array_to_string(h, '')))::BIGINT AS errors, sum(length(array_to_string(r, '')))::BIGINT AS chars FROM h""")
def cer_micro(spark, sf):
    """The hypothesis is a subsequence, so the distance is what it lacks."""
    r = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", r.alias("r"))
    docs = docs.withColumn("h", F.filter("r", lambda x, i: (F.col("doc_id") + i + 1) % 6 != 0))
    return docs.agg(F.sum(A.char_distance(F.col("r"), F.col("h"))).cast("long").alias("errors"), F.sum(F.length(F.array_join("r", ""))).cast("long").alias("chars"))


@query(f"WITH {_ERRORS} SELECT lang, sum(err)::BIGINT AS errors, sum(n)::BIGINT AS words FROM e GROUP BY lang")
def error_decomposition(spark, sf):
    """Substitutions, deletions and insertions add up to the distance; hits, substitutions and deletions to the reference."""
    o = _pairs(spark, sf).select("lang", A.operations("r", "h").alias("o"))
    return o.groupBy("lang").agg(F.sum(F.expr("o.substitutions + o.deletions + o.insertions")).cast("long").alias("errors"), F.sum(F.expr("o.hits + o.substitutions + o.deletions")).cast("long").alias("words"))


@query()
def error_classes(spark, sf):
    """kind, n: what a correction by lexicon could and could not mend.

    Replaced words pair by pair: rare_ref (the reference word is not in the lexicon), else non_word_hyp or real_word_hyp by
    the hypothesis word.  false_flag: words that are right and not in the lexicon.  SQL has no such alignment; tested
    against a brute-force count.
    """
    pairs = _pairs(spark, sf).select(F.transform("r", lambda x: F.lower(x)).alias("r"), F.transform("h", lambda x: F.lower(x)).alias("h"))
    known = table(spark, sf, "benchmark").select(F.explode(T.tokens(T.normalize_train_target(F.col("text")))).alias("word")).distinct().withColumn("known", F.lit(True))
    wrong = C.fixed(pairs.select(F.explode(A.aligned_blocks("r", "h")).alias("p")).select("p.*").filter("ref is not null").groupBy("op", "ref", "hyp").agg(F.count("*").alias("n")))
    is_known = lambda rows, word, out: rows.join(known.withColumnsRenamed({"word": word, "known": out}), word, "left")
    replaced = is_known(is_known(wrong.filter("op = 'replace'"), "ref", "ref_known"), "hyp", "hyp_known")
    kind = F.when(F.col("ref_known").isNull(), "rare_ref").when(F.col("hyp_known").isNull(), "non_word_hyp").otherwise("real_word_hyp")
    # words that are right are those of the references without the wrong ones
    words = pairs.select(F.explode("r").alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    right = words.unionByName(wrong.select("ref", (-F.col("n")).alias("n"))).groupBy("ref").agg(F.sum("n").alias("n"))
    flagged = is_known(right, "ref", "ref_known").filter("ref_known is null").agg(F.lit("false_flag").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return replaced.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).unionByName(flagged)


@query(f"WITH {_ERRORS} SELECT lang, sum(err)::BIGINT AS errors, sum(n)::BIGINT AS words, round(sum(err) * 1.0 / sum(n), 6) AS wer, count(*) AS utterances FROM e WHERE n > 0 GROUP BY lang")
def corpus_wer(spark, sf):
    """Errors over reference words; an utterance without a reference is refused, so those are filtered before."""
    pairs = _pairs(spark, sf).filter(F.size("r") > 0)
    return S.corpus_wer(pairs, "r", "h", "lang").withColumn("wer", F.round("wer", 6))


_BOOT = """b AS (SELECT replicate, i FROM (SELECT r AS replicate, s, ('0x' || substr(md5('{seed}:' || r || ':' || s), 1, 8))::BIGINT % (SELECT count(*) FROM e) AS i FROM range(1, {n} + 1) t(r), range((SELECT count(*) FROM e)) u(s))),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM e)"""


@query(f"""WITH {_ERRORS}, {_BOOT.format(seed=1234, n=100)}, s AS (SELECT replicate, sum(err) * 100.0 / greatest(sum(n), 1) AS wer FROM b JOIN k USING (i) GROUP BY replicate), o AS (SELECT list_sort(list(wer)) AS v FROM s)
SELECT round(v[(0.025 * (len(v) - 1))::DOUBLE::INT + 1], 6) AS ci_low, round(v[floor(0.975 * (len(v) - 1))::INT + 1], 6) AS ci_high, len(v) AS replicates FROM o""")
def bootstrap_wer_ci(spark, sf):
    sums = S.bootstrap_sums(_errors(spark, sf), "doc_id", ["err", "n"], 100, 1234)
    ci = S.bootstrap_interval(sums, F.col("err") * 100.0 / F.greatest(F.col("n"), F.lit(1)))
    return ci.select(F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), F.col("replicates").cast("long").alias("replicates"))


@query(f"""WITH {_ERRORS}, {_BOOT.format(seed=42, n=100)}, s AS (SELECT replicate, sum(err) AS a, sum(CASE WHEN doc_id % 4 = 0 THEN err // 2 ELSE err END) AS c, sum(n) AS n FROM b JOIN k USING (i) GROUP BY replicate),
g AS (SELECT (a - c) * 100.0 / greatest(n, 1) AS g, CASE WHEN a > 0 THEN (a - c) * 100.0 / a ELSE 0.0 END AS r FROM s), o AS (SELECT list_sort(list(g)) AS gs, list_sort(list(r)) AS rs, avg((r > 0)::INT) AS p_better, avg((r >= 3)::INT) AS p_margin FROM g)
SELECT round(gs[3], 6) AS gain_low, round(gs[98], 6) AS gain_high, round(rs[3], 6) AS relative_low, round(rs[98], 6) AS relative_high, p_better, p_margin FROM o""")
def paired_bootstrap(spark, sf):
    rows = _errors(spark, sf).withColumn("cand", F.when(F.col("doc_id") % 4 == 0, F.floor(F.col("err") / 2)).otherwise(F.col("err")))
    out = S.paired_bootstrap(rows, "doc_id", "err", "cand", "n", replicates=100)
    return out.select(*[F.round(c, 6).alias(c) for c in ("gain_low", "gain_high", "relative_low", "relative_high")], "p_better", "p_margin")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS least, max(value) AS most,
round(avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS low, round(avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS high FROM events GROUP BY event_type""")
def distribution_report(spark, sf):
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    sem = std / F.sqrt(F.count("*"))
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(std, 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.round(F.avg("value") - 1.96 * sem, 6).alias("low"), F.round(F.avg("value") + 1.96 * sem, 6).alias("high"),
    )


@query("""WITH o AS (SELECT event_type, list_sort(list(value)) AS v, len(list(value)) AS n, quantile_cont(value::DOUBLE, 0.9) AS linear FROM events GROUP BY event_type)
SELECT event_type, v[greatest(ceil(0.9 * n), 1)::INT] AS nearest, v[floor((n - 1) * 0.9)::INT + 1] AS low, round(linear, 6) AS linear, v[floor(0.9 * (n - 1))::INT + 1] AS below, v[floor(0.9 * n)::INT + 1] AS trunc, v[least(floor(0.9 * n)::INT, n - 1) + 1] AS clamped FROM o""")
def percentile_conventions(spark, sf):
    """Six conventions on the same values, by rank."""
    p = F.lit(0.9)
    whole = lambda x: x.cast("long")
    ranks = {
        "nearest": lambda n: F.greatest(F.ceil(p * n), F.lit(1)) - 1, "low": lambda n: F.floor((n - 1) * p), "below": lambda n: whole(p * (n - 1)), "trunc": lambda n: whole(p * n),
        "clamped": lambda n: F.least(whole(p * n), n - 1), "floor_": lambda n: F.floor((n - 1) * p), "ceil_": lambda n: F.ceil((n - 1) * p),
    }
    o = S.at_ranks(table(spark, sf, "events"), "event_type", "value", ranks)
    share = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    linear = F.when(F.col("floor_") == F.col("ceil_"), F.col("floor_")).otherwise((1 - share) * F.col("floor_") + share * F.col("ceil_"))
    return o.select("event_type", "nearest", "low", F.round(linear, 6).alias("linear"), "below", "trunc", "clamped")


# ---------------------------------------------------------------- harness


def _by_user(*order):
    return Window.partitionBy("user_id").orderBy(*(order or ("ts", "event_id")))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, round(2.98 * count(*) / nullif(sum(value), 0), 6) AS rtfx FROM r WHERE rn > 2 GROUP BY user_id""")
def rtfx_warmup_drop(spark, sf):
    r = table(spark, sf, "events").select("user_id", "value", F.row_number().over(_by_user()).alias("rn")).filter("rn > 2")
    return r.groupBy("user_id").agg(F.round(2.98 * F.count("*") / F.nullif(F.sum("value"), F.lit(0)), 6).alias("rtfx"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), h AS (SELECT user_id, sum(value) FILTER (rn <= n // 2) AS a, sum(value) FILTER (rn > n // 2) AS b, count_if(rn <= n // 2) AS na, count_if(rn > n // 2) AS nb FROM r GROUP BY user_id)
SELECT user_id, round((nb / nullif(b, 0)) / nullif(na / nullif(a, 0), 0), 6) AS ratio FROM h""")
def thermal_ratio_halves(spark, sf):
    n = F.count("*").over(Window.partitionBy("user_id"))
    r = table(spark, sf, "events").select("user_id", "value", (F.row_number().over(_by_user()) <= F.floor(n / 2)).alias("first"))
    rate = lambda c: F.try_divide(F.count_if(c), F.sum(F.when(c, F.col("value"))))
    return r.groupBy("user_id").agg(F.round(F.try_divide(rate(~F.col("first")), rate(F.col("first"))), 6).alias("ratio"))


@query("""WITH s AS (SELECT value, floor((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 3600000000)::BIGINT AS w FROM events), g AS (SELECT w, avg(value) AS wall, count(*) AS n FROM s GROUP BY w), f AS (SELECT first(wall ORDER BY w) AS w0 FROM g)
SELECT w, n, round(1 / nullif(wall, 0), 6) AS rtfx, round(100 * (1 - w0 / nullif(wall, 0)), 4) AS drop_pct FROM g, f""")
def soak_windows(spark, sf):
    """Tumbling windows from the first event on (an hour stands for 30 s at this event rate), with the drop against the first."""
    e = table(spark, sf, "events").select("value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    start = e.agg(F.min("us").alias("t0"))
    g = e.join(F.broadcast(start)).groupBy(F.floor((F.col("us") - F.col("t0")) / 3_600_000_000).cast("long").alias("w")).agg(F.avg("value").alias("wall"), F.count("*").alias("n"))
    first = g.agg(F.min_by("wall", "w").alias("w0"))
    return g.join(F.broadcast(first)).select("w", "n", F.round(F.try_divide(F.lit(1.0), F.col("wall")), 6).alias("rtfx"), F.round(100 * (1 - F.try_divide(F.col("w0"), F.col("wall"))), 4).alias("drop_pct"))


_BACKLOG_SQL = """b AS (SELECT user_id, event_id, ts, greatest(sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS backlog FROM events)"""


def _backlog(spark, sf):
    step = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    w = _by_user().rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.greatest(F.sum(step).over(w), F.lit(0)).cast("long").alias("backlog"))


@query(f"WITH {_BACKLOG_SQL} SELECT user_id, event_id, backlog FROM b")
def backlog_running(spark, sf):
    return _backlog(spark, sf).select("user_id", "event_id", "backlog")


@query(f"""WITH {_BACKLOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM b)
SELECT user_id, max(n) >= 4 AND avg(backlog) FILTER (rn > n // 2) > avg(backlog) FILTER (rn <= n // 2) AND arg_max(backlog, rn) > 0 AS growing FROM r GROUP BY user_id""")
def backlog_growing(spark, sf):
    n = F.count("*").over(Window.partitionBy("user_id"))
    r = _backlog(spark, sf).withColumns({"rn": F.row_number().over(_by_user()), "n": n})
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    half = lambda c: F.avg(F.when(c, F.col("backlog")))
    return r.groupBy("user_id").agg((F.max("n") >= 4).__and__(half(~first) > half(first)).__and__(F.max_by("backlog", "rn") > 0).alias("growing"))


@query(f"""WITH {_BACKLOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM b)
SELECT user_id, quantile_disc(backlog, 0.5) AS p50, quantile_disc(backlog, 0.95) AS p95, quantile_disc(backlog, 0.99) AS p99 FROM r WHERE rn <= 4096 GROUP BY user_id""")
def bounded_history_percentiles(spark, sf):
    """Nearest-rank percentiles of the latest HISTORY readings: a bounded list per user."""
    latest = _backlog(spark, sf).withColumn("rn", F.row_number().over(_by_user(F.desc("ts"), F.desc("event_id")))).filter(F.col("rn") <= HISTORY)
    return latest.groupBy("user_id").agg(*[S.nearest_rank(F.col("backlog"), p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, count_if(event_type = 'click') AS a, count_if(event_type = 'view') AS b FROM events GROUP BY 1)
SELECT epoch(h)::BIGINT AS hour, round((sum(a) OVER w - sum(b) OVER w) * 1000.0 / 16, 6) AS drift FROM h WINDOW w AS (ORDER BY h)""")
def drift_series(spark, sf):
    """Drift of two counters by hour; the hourly table is small, the events are aggregated before the running sum."""
    h = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    w = Window.orderBy("h")
    return h.select(F.unix_seconds("h").alias("hour"), F.round(G.drift_ms(F.sum("a").over(w), F.sum("b").over(w), 16), 6).alias("drift"))


@query("""WITH t AS (SELECT date_trunc('minute', ts) AS m, bool_or(event_type = 'click') AS mic, bool_or(event_type = 'view') AS lb FROM events GROUP BY 1)
SELECT epoch(m)::BIGINT AS minute, CASE WHEN mic AND lb THEN 'Both' WHEN mic THEN 'Agent' WHEN lb THEN 'Customer' ELSE 'Neither' END AS speaker FROM t""")
def speaker_route(spark, sf):
    t = table(spark, sf, "events").groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("m")).agg(F.bool_or(F.col("event_type") == "click").alias("mic"), F.bool_or(F.col("event_type") == "view").alias("lb"))
    return t.select(F.unix_seconds("m").alias("minute"), G.speaker(F.col("mic"), F.col("lb")).alias("speaker"))


@query("""WITH p AS (SELECT l_orderkey % 100 AS k, avg(abs(l_extendedprice - l_quantity * 1000)) AS mae, max(abs(l_extendedprice - l_quantity * 1000)) AS worst, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1) SELECT k, round(mae::DOUBLE, 4) AS mae, round(worst::DOUBLE, 4) AS worst, round(r, 6) AS r FROM p""")
def golden_comparison(spark, sf):
    """Mean and largest absolute difference and correlation of two series."""
    gap = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000)
    g = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.avg(gap).cast("double").alias("mae"), F.max(gap).cast("double").alias("worst"), F.corr("l_extendedprice", "l_quantity").alias("r"))
    return g.select("k", F.round("mae", 4).alias("mae"), F.round("worst", 4).alias("worst"), F.round("r", 6).alias("r"))
