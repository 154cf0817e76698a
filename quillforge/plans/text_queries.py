"""Normalisers, quality filters, keys and audits over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.functions import quality as Q
from quillforge.functions import text as T
from quillforge.operators import corpus as C

from ._registry import query, spread, table

#: Normalised text in SQL; RE2's \w is ASCII, so the class is spelt out.
TRAIN_SQL = r"trim(regexp_replace(nfc_normalize(lower(coalesce(text, ''))), '[^\p{L}\p{N}_]+', ' ', 'g'))"
COLLOQUIAL_SQL = "CASE w WHEN 'pra' THEN 'para' WHEN 'pro' THEN 'para o' WHEN 'pros' THEN 'para os' WHEN 'pras' THEN 'para as' WHEN 'vc' THEN 'voce' WHEN 'ta' THEN 'esta' ELSE w END"

_FLAGS_SQL = f"""
n AS (SELECT doc_id, lang, source, {TRAIN_SQL} AS t FROM documents),
words AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM n WHERE t <> ''),
chars AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM n WHERE t <> ''),
char_runs AS (SELECT doc_id, c, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM chars WHERE c <> ' ') GROUP BY doc_id, c, g),
word_runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM words) GROUP BY doc_id, w, g),
f1 AS (SELECT doc_id, max(k) >= 6 AS char_run FROM char_runs GROUP BY doc_id),
f2 AS (SELECT doc_id, max(k) >= 4 AS token_run FROM word_runs GROUP BY doc_id),
f3 AS (SELECT doc_id, max(length(w)) > 30 AS long_word, count(*) >= 8 AND count(DISTINCT w) / count(*) < 0.30 AS low_unique, count(*) AS n_words FROM words GROUP BY doc_id),
flags AS (
  SELECT n.doc_id, lang, source, t, coalesce(char_run, false) AS char_run, coalesce(token_run, false) AS token_run, coalesce(long_word, false) AS long_word,
         coalesce(low_unique, false) AS low_unique, coalesce(n_words, 0) AS n_words
  FROM n LEFT JOIN f1 USING (doc_id) LEFT JOIN f2 USING (doc_id) LEFT JOIN f3 USING (doc_id))
"""


def _normalized(spark, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text"))
    docs = docs.select("doc_id", "lang", "source", "n_chars", T.normalize_train_target(F.col("text")).alias("t"))
    return docs.withColumn("words", T.tokens(F.col("t")))


@query(f"""WITH {_FLAGS_SQL}
SELECT lang, CASE WHEN t = '' THEN 'empty' WHEN char_run OR token_run OR long_word OR low_unique THEN 'hallucination'
                  WHEN length(t) / n_words > 12 THEN 'bad_ratio' ELSE 'kept' END AS reason, count(*) AS n
FROM flags GROUP BY ALL""")
def quality_reasons_by_lang(spark, sf):
    """Flagship: what survives each filter, first failing reason wins."""
    t, words = F.col("t"), F.col("words")
    reason = Q.first_reason(("empty", t == ""), ("hallucination", Q.hallucinated(t, words)), ("bad_ratio", F.length(t) / F.size(words) > 12))
    return _normalized(spark, sf).select("lang", reason.alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_FLAGS_SQL} SELECT doc_id, char_run, token_run, long_word, low_unique FROM flags")
def hallucination_signals(spark, sf):
    t, w = F.col("t"), F.col("words")
    return _normalized(spark, sf).select("doc_id", Q.char_run(t).alias("char_run"), Q.token_run(w).alias("token_run"), Q.long_word(w).alias("long_word"), Q.low_unique_share(w).alias("low_unique"))


@query(f"""WITH {_FLAGS_SQL},
loops AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w, lead(w, 1) OVER x AS w1, lead(w, 2) OVER x AS w2, lead(w, 3) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY i)) WHERE w = w2 AND w1 = w3),
rep AS (SELECT doc_id, max(k) >= 3 AS r FROM word_runs GROUP BY doc_id),
u AS (SELECT doc_id, count(*) >= 6 AND count(DISTINCT w) / count(*) < 0.45 AS low FROM words GROUP BY doc_id)
SELECT source, count(*) AS n, count_if(coalesce(r, false)) AS repeats, count_if(l.doc_id IS NOT NULL) AS loops, count_if(coalesce(low, false)) AS low_unique,
       sum(CASE WHEN coalesce(r, false) OR l.doc_id IS NOT NULL OR coalesce(low, false) THEN length(t) ELSE 0 END)::BIGINT AS affected
FROM flags f LEFT JOIN rep USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN loops l ON l.doc_id = f.doc_id GROUP BY source""")
def noise_audit_by_source(spark, sf):
    w = F.col("words")
    flags = _normalized(spark, sf).select("source", "t", Q.token_run(w, 3).alias("r"), Q.ngram_loop(w, 2).alias("l"), Q.low_unique_share(w, 6, 0.45).alias("u"))
    bad = F.col("r") | F.col("l") | F.col("u")
    return flags.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("r").alias("repeats"), F.count_if("l").alias("loops"), F.count_if("u").alias("low_unique"),
        F.sum(F.when(bad, F.length("t")).otherwise(0)).cast("long").alias("affected"),
    )


@query(f"SELECT doc_id, {TRAIN_SQL} AS norm FROM documents")
def normalize_train_target(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_train_target(F.col("text")).alias("norm"))


@query(rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '^\s+|\s+$', '', 'g')) AS t FROM conversations),
m AS (SELECT conv_id, turn, replace(regexp_replace(replace(regexp_replace(t, 'us\$\s*(\d[\d.,]*)', '\1 dolares', 'g'), 'us$', 'dolares'), 'r\$\s*(\d[\d.,]*)', '\1 reais', 'g'), 'r$', 'reais') AS t FROM c),
p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(strip_accents(regexp_replace(t, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), '\s+'), lambda x: x <> '') AS ws FROM m)
SELECT conv_id, turn, array_to_string(list_transform(ws, lambda w: {COLLOQUIAL_SQL}), ' ') AS norm FROM p""")
def normalize_compare(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_for_compare(F.col("text")).alias("norm"))


@query("""SELECT * FROM (VALUES (1, 'custa 100 reais hoje'), (2, 'para voce e ja'), (3, 'reais'), (4, '5 1 dolares a'), (5, ''), (6, 'para o ce')) t(id, norm)""")
def currency_colloquial(spark, sf):
    rows = [(1, "Custa R$ 100 hoje"), (2, "Pra você, é já!"), (3, "r$"), (4, "US$ 5,1 à"), (5, None), (6, "pro cê")]
    return spark.createDataFrame(rows, "id int, t string").select("id", T.normalize_for_compare(F.col("t")).alias("norm"))


@query(r"""WITH n AS (SELECT conv_id, turn, regexp_replace(replace(lower(text), '⚠️', ''), '_+', ' ', 'g') AS t, lower(text) AS u FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '[^0-9a-zàáâãéêíóôõúüç ]', ' ', 'g'), '\s+', ' ', 'g')) AS call,
       trim(regexp_replace(regexp_replace(u, '[^0-9a-zàáâãéêíóôõúüç ]', ' ', 'g'), '\s+', ' ', 'g')) AS bench FROM n""")
def normalize_call_and_benchmark(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_call(F.col("text")).alias("call"), T.normalize_benchmark(F.col("text")).alias("bench"))


@query("""WITH c AS (SELECT doc_id, n_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT doc_id, CASE WHEN w > 0 THEN round(n_chars / w, 6) ELSE 0.0 END AS rate, (CASE WHEN w > 0 THEN n_chars / w ELSE 0.0 END) BETWEEN 0.5 AND 40 AS ok FROM c""".replace("\\\\", "\\"))
def chars_per_unit_bound(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(T.tokens(F.col("text"))).alias("w"))
    rate = F.when(F.col("w") > 0, F.col("n_chars") / F.col("w")).otherwise(0.0)
    return docs.select("doc_id", F.round(rate, 6).alias("rate"), rate.between(Q.MIN_CPS, Q.MAX_CPS).alias("ok"))


@query("SELECT d.doc_id, coalesce(quality, 0) - coalesce(toxic, 0) AS net FROM documents d LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) - coalesce(toxic, 0) >= 1")
def net_vote_filter(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", Q.net_votes(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("net")).filter("net >= 1")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def coverage_by_source(spark, sf):
    return C.coverage(table(spark, sf, "documents"), F.col("source"))


@query("WITH c AS (SELECT count(*) AS n FROM documents GROUP BY source) SELECT round(max(n) * 100.0 / sum(n), 6) AS share, max(n) * 100.0 / sum(n) > 30 AS dominant FROM c")
def dominance_share(spark, sf):
    return C.dominance(coverage_by_source(spark, sf)).select(F.round("share", 6).alias("share"), "dominant")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def top_sources(spark, sf):
    """A top-k report: the limit is the feature."""
    return C.top(coverage_by_source(spark, sf), 15)


@query(r"""WITH t AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(url, '[/\-_.\s]+'), lambda x: length(x) >= 8)) AS toks FROM pages)
SELECT page_id, array_to_string(list_sort(toks), ' ') AS tokens FROM t""")
def path_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(T.path_tokens(F.col("url"))), " ").alias("tokens"))


@query(r"""SELECT page_id, regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') AS stem, regexp_replace(regexp_replace(split_part(url, '/', -1), '\.[^.]*$', ''), '-\d+$', '') AS video,
       list_filter(string_split(regexp_replace(url, '^https?:/', ''), '/'), lambda x: x <> '')[1] AS show FROM pages""")
def path_keys(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.stem(url).alias("stem"), T.video_id(url).alias("video"), T.show_key(F.regexp_replace(url, "^https?:/", "")).alias("show"))


@query("""SELECT * FROM (VALUES (1, 'showA', 'ana'), (2, 'showA', 'f'), (3, '<unknown>', NULL), (4, 'show_x', 'v')) t(id, show_key, speaker)""")
def show_and_speaker_keys(spark, sf):
    rows = [(1, "showA/ep01/seg0.flac", "underscore", "a/b_1_ana.wav"), (2, "/showA/ep01", "folder", "x/f/u.wav"), (3, "", "none", "q"), (4, "a/show_x/b", "numbered", "d/v-12.wav")]
    return spark.createDataFrame(rows, "id int, p string, d string, f string").select("id", T.show_key(F.col("p")).alias("show_key"), T.speaker_key(F.col("d"), F.col("f")).alias("speaker"))


@query("""SELECT * FROM (VALUES (1, 3), (2, 76), (3, NULL), (4, 3723)) t(id, secs)""")
def clock_lines(spark, sf):
    rows = [(1, "0:00:03"), (2, " 01:16 "), (3, "at 1:16"), (4, "1:02:03")]
    return spark.createDataFrame(rows, "id int, l string").select("id", T.clock_seconds(F.col("l")).alias("secs"))


@query("SELECT 'utt_' || lpad((row_number() OVER (ORDER BY source, doc_id) - 1)::VARCHAR, 8, '0') AS id, doc_id FROM documents")
def sequential_ids(spark, sf):
    return C.numbered(table(spark, sf, "documents").select("source", "doc_id"), "utt_", ["source", "doc_id"]).select("id", "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE contains(lower(text), lower((SELECT substr(trim(text), 1, 30) FROM documents WHERE doc_id = 15)))")
def first_row_with_text(spark, sf):
    """The first row whose text contains the first 30 characters of a reference."""
    docs = table(spark, sf, "documents")
    needle = docs.filter("doc_id = 15").select(F.lower(F.substring(F.trim("text"), 1, 30)).alias("needle"))
    return docs.join(F.broadcast(needle), F.contains(F.lower("text"), F.col("needle"))).agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'muted' WHEN n_chars % 50 = 0 THEN 'silent' END AS sink, CASE WHEN doc_id % 7 = 0 THEN 'muted' WHEN n_chars % 50 < 20 THEN 'low_volume' END AS mic FROM documents""")
def device_warnings(spark, sf):
    muted, volume = F.col("doc_id") % 7 == 0, F.col("n_chars") % 50
    return table(spark, sf, "documents").select("doc_id", Q.sink_warning(muted, volume).alias("sink"), Q.source_warning(muted, volume).alias("mic"))
