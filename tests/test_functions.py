"""Hand-computed values of single functions and error contracts."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.functions import align as A
from quillforge.functions import ctc
from quillforge.functions import quality as Q
from quillforge.functions import signal as G
from quillforge.functions import stats as S
from quillforge.functions import text as T
from quillforge.operators import corpus as C
from quillforge.sources import readers as R
from quillforge.sources import sinks as K
from quillforge.streaming import live


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_hallucinations(spark):
    bad = ["vento vento vento vento sul", "x y x y x y x y x y x", "que chuvaaaaaaa forte", "zzzzzz", "um " + "palavrao" * 4]
    good = ["vento vento vento sul", "simmm e agoraaa", "terra ferro corrida", " ".join(f"termo{i}" for i in range(40)), ""]
    assert column(spark, bad + good, Q.hallucinated(F.col("x"), T.tokens(F.col("x")))) == [True] * 5 + [False] * 5


def test_normalisers_are_different_contracts(spark):
    text = ["Maçã, LIMÃO! são três?", "", "  ", "US$ 20 por mês", "e\u0301 ﬁ o\u0302u", "\u1112\u1161\u11ab"]
    train = column(spark, text, T.normalize_train_target(F.col("x")))
    compare = column(spark, text, T.normalize_for_compare(F.col("x")))
    assert train[0] == "maçã limão são três" and compare[0] == "maca limao sao tres" and train[1:3] == compare[1:3] == ["", ""]
    assert train[3] == "us 20 por mês" and compare[3] == "20 dolares por mes"
    assert train[4] == "é ﬁ ôu" and compare[4] == "e fi o u" and train[5] == "\ud55c"
    assert column(spark, ["Olá! Quem fala: o João?", "fim ____ da fita ⚠️"], T.normalize_call(F.col("x"))) == ["olá quem fala o joão", "fim da fita"]
    assert column(spark, ["\t a "], T.strip_all(F.col("x"))) == ["a"]
    assert column(spark, ["kɐ zɐ", None], T.phoneme_symbols(F.col("x"))) == [["k", "ɐ", "z", "ɐ"], None]
    assert column(spark, [75.9, 3600.0, 0.0], T.clock(F.col("x")), "double") == ["01:15", "60:00", "00:00"]


def test_distances(spark):
    df = spark.createDataFrame([(["mar", "alto"], ["mar", "altos"]), (["a", "ponte", "caiu", "ontem"], ["a", "torre", "caiu", "ontem"]), ([], ["a"])], "r array<string>, h array<string>")
    got = df.select(A.word_distance(F.col("r"), F.col("h")).alias("w"), A.char_distance(F.col("r"), F.col("h")).alias("c"), A.operations("r", "h").alias("o"), A.aligned_blocks("r", "h").alias("b")).collect()
    assert [(r["w"], r["c"]) for r in got[:1]] == [(1, 1)] and [r["w"] for r in got] == [1, 1, 1]
    assert [tuple(r["o"]) for r in got] == [(1, 1, 0, 0), (3, 1, 0, 0), (0, 0, 0, 1)]
    assert [tuple(x) for x in got[1]["b"]] == [("replace", "ponte", "torre")]
    pairs = [("sim senhor", "sim senhor"), ("", ""), ("", "um ruído"), ("e", ""), ("um", "quatro")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r["c"] for r in df.orderBy("i").select(A.pairwise_cer(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.0, 1.0, 1.0, 2.5]


def test_error_rates_refuse_blank_references_and_other_test_sets(spark):
    kind = "u int, ref array<string>, hyp array<string>"
    a = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["c"], None)], kind)
    assert tuple(S.corpus_wer(a, "ref", "hyp").first()) == (2, 3, 2 / 3, 2)
    for blank in ([], None):
        with pytest.raises(S.BlankReference):
            S.corpus_wer(a.unionByName(spark.createDataFrame([(3, blank, ["x"])], kind)), "ref", "hyp")
    b = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["c"], ["d"])], kind)
    assert sorted(map(tuple, S.paired_errors(a.fillna({}).withColumn("hyp", F.coalesce("hyp", F.array().cast("array<string>"))), b, "u").collect())) == [(1, 1, 0, 2), (2, 1, 1, 1)]
    with pytest.raises(ValueError, match="references differ"):
        S.paired_errors(a, b.withColumn("ref", F.when(F.col("u") == 2, F.array(F.lit("z"))).otherwise(F.col("ref"))), "u")
    with pytest.raises(ValueError):
        S.paired_errors(a, b.filter("u = 1"), "u")


def test_thresholds(spark):
    def tau(values, keep):
        return S.calibrated_threshold(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", keep).first()["tau"]

    assert tau([0, 0.1, 0.2, 0.3, 0.9], 0.8) == 0.3 and tau([0, 0.1, 0.2, 0.3, 0.9], 1.0) == 0.9 and tau([0.1] * 4 + [0.9], 0.8) == 0.1
    for values, keep in (([], 0.8), ([0.1], 1.5)):
        with pytest.raises(ValueError):
            tau(values or [], keep)


def test_paired_bootstrap_values(spark):
    rows = spark.createDataFrame([(1, 2, 1, 5), (2, 2, 1, 5)], "u int, base int, cand int, n int")
    r = S.paired_bootstrap(rows, "u", "base", "cand", "n", replicates=50).first()
    assert (r["gain_low"], r["gain_high"], r["relative_low"], r["p_better"], r["p_margin"]) == (20.0, 20.0, 50.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        S.bootstrap_sums(rows.limit(0), "u", ["base"], 10, 1)


def test_percentiles_on_small_samples(spark):
    for n in (1, 2, 3, 20):
        v = list(range(1, n + 1))
        df = spark.createDataFrame([(x,) for x in v], "v int")
        for p in (0.5, 0.9, 0.95, 0.99):
            a = F.array_sort(F.collect_list("v"))
            r = df.agg(S.nearest_rank(F.col("v"), p).alias("a"), S.lower(a, p).alias("b"), S.trunc_below(a, p).alias("c"), S.trunc(a, p).alias("d"), S.trunc_clamped(a, p).alias("e"), S.linear(F.col("v"), p).alias("f")).first()
            assert r["a"] == v[max(math.ceil(p * n), 1) - 1] and r["b"] == v[math.floor((n - 1) * p)] and r["c"] == v[int(p * (n - 1))]
            assert r["d"] == v[int(p * n)] and r["e"] == v[min(n - 1, int(p * n))] and abs(r["f"] - np.percentile(v, p * 100)) < 1e-9
    ranks = spark.range(100).select(((F.col("id") + 1) * 1000).alias("v")).agg(*[S.nearest_rank(F.col("v"), p).alias(str(i)) for i, p in enumerate((0.5, 0.95, 0.99))]).first()
    assert tuple(ranks) == (50_000, 95_000, 99_000)


def test_sequences(spark):
    assert column(spark, [[0, 5, 5, 0, 5, 3, 3], [], [0, 0], [1, 0, 1]], ctc.collapse(F.col("x")), "array<int>") == [[5, 5, 3], [], [], [1, 1]]
    ties = [[1.0, 3.0, 3.0], [], [2.0]]
    assert column(spark, ties, ctc.argmax(F.col("x")), "array<double>") == [1, 0, 0] and column(spark, ties, ctc.argmax(F.col("x"), "last"), "array<double>") == [2, 0, 0]
    odd = [[float("nan"), 1.0, 2.0], [3.0, float("nan"), 1.0], [3.0, 1.0, float("nan"), 2.0, 0.0]]
    assert column(spark, odd, ctc.argmax(F.col("x")), "array<double>") == [0, 1, 2] and column(spark, odd, ctc.argmax(F.col("x"), "last"), "array<double>") == [2, 2, 3]
    frames = [[[0.1, 0.9], [0.1, 0.9], [0.9, 0.1], [0.2, 0.8]]]
    assert column(spark, frames, ctc.greedy_ids(F.col("x"), F.lit(3)), "array<array<double>>") == [[1]]
    vocabulary = spark.createDataFrame([(0, "a"), (1, "#0"), (2, "b")], "id int, token string")
    one = C.vocabulary_fingerprint(vocabulary).first()
    assert (one["size"], one["real_len"]) == (3, 2)
    C.check_vocabulary(vocabulary, 2, one["fingerprint"])
    for bad in ((3, None), (None, "x")):
        with pytest.raises(ValueError):
            C.check_vocabulary(vocabulary, *bad)


def test_signals(spark):
    constant = [[20_000] * 512, [0] * 512, [20_000, -20_000] * 256]
    assert column(spark, constant, G.is_speech(F.col("x")), "array<int>") == [False, False, True]
    tone = (np.sin(2 * np.pi * 440 * np.arange(48_000) / 16_000) * 16_383).astype(np.int16)
    f = G.fbank_array(tone)
    assert f.shape == (300, 80)
    centers = 700 * (np.exp((np.arange(1, 81) * (1127 * np.log1p(7600 / 700) - 1127 * np.log1p(20 / 700)) / 81 + 1127 * np.log1p(20 / 700)) / 1127) - 1)
    assert abs(int(f[150].argmax()) - int(np.abs(centers - 440).argmin())) <= 1
    every = np.arange(-32768, 32768)
    for name, most in (("g711a", 0.03), ("g711u", 0.03)):
        back = G.CODECS[name](every)
        big = np.abs(every) > 2000
        assert (np.abs(back - every)[big] / np.abs(every[big])).max() <= most + 0.02 and (np.diff(back) >= 0).all() and len(np.unique(back)) <= 256
    with pytest.raises(ValueError):
        G.apply_codec(F.col("x"), "gsm")
    assert G.energy_segments(np.array([])) == [] and G.energy_segments(np.ones(16_000)) == [(0, 16_000)]
    long = G.energy_segments(np.ones(60 * 16_000), most=20.0)
    assert len(long) >= 3 and long[0][0] == 0 and long[-1][1] == 60 * 16_000 and all(b - a <= 21 * 16_000 for a, b in long) and all(x[1] == y[0] for x, y in zip(long, long[1:]))
    # rate 1000: frames of 30 samples, silence from frame 100 on reaches eleven frames at 110
    joined = np.concatenate([np.ones(3000), np.zeros(500), np.ones(3000)])
    assert G.energy_segments(joined, rate=1000) == [(0, 6500)]  # short enough: never cut
    assert G.energy_segments(joined, rate=1000, most=4.0) == [(0, 3300), (3300, 6500)]
    near_start = np.concatenate([np.zeros(420), np.ones(4000), np.zeros(420), np.ones(2000)])  # reached at 300, under half a second in, and at 158 * 30
    assert [a for a, _ in G.energy_segments(near_start, rate=1000, most=5.0)] == [0, 4740]
    dip = np.ones(6000)
    dip[2700:2730] = 0.9  # not silent, but the quietest frame between 2 and 4 seconds
    assert G.energy_segments(dip, rate=1000, most=4.0) == [(0, 2700), (2700, 6000)]
    assert G.energy_segments((dip * 16_000).astype(np.int16), rate=1000, most=4.0) == [(0, 2700), (2700, 6000)]
    assert column(spark, [[1.0, 2.0, 1.0], []], G.middle_index(F.col("x")), "array<double>") == [1, None]
    assert column(spark, [[1.0], [1.0, 2.0, 3.0]], G.padded(F.col("x"), F.lit(2)), "array<double>") == [[1.0, 0.0], [1.0, 2.0, 3.0]]
    assert len(G.resample_array(np.ones(1600), 16_000, 8000)) == 800
    stereo = [[[1.0, 3.0], [3.0, 5.0]]]
    assert column(spark, stereo, G.mono_mean(F.col("x")), "array<array<double>>") == [[2.0, 4.0]] and column(spark, stereo, G.mono_first(F.col("x")), "array<array<double>>") == [[1.0, 3.0]]
    assert column(spark, [[2.0, -2.0, 0.5]], G.to_int16(F.col("x")), "array<double>") == [[32767, -32767, 16383]]


@pytest.mark.parametrize(
    ("words", "times", "last", "tail", "new", "left"),
    [
        (["rio", "corre", "manso"], [0.2, 0.6, 1.1], None, ["rio", "corre"], ["rio", "corre"], ["manso"]),
        (["rio", "corre"], [0.2, 0.6], None, ["rios", "corre"], [], ["rio", "corre"]),
        # the committed word again, 0.2 s later: dropped; after half a second it is a word of its own
        (["sol", "nasce", "cedo"], [2.2, 2.7, 3.1], ("sol", 2.0), ["nasce"], ["nasce"], ["cedo"]),
        (["sol", "nasce"], [2.5, 2.7], ("sol", 2.0), ["sol"], ["sol"], ["nasce"]),
        (["lua", "nasce"], [2.1, 2.6], ("sol", 2.0), ["nasce"], [], ["lua", "nasce"]),
        (["antes", "sol", "depois"], [1.0, 2.0, 3.0], ("sol", 2.0), ["depois"], ["depois"], []),
        ([], [], ("sol", 2.0), ["nasce"], [], []),
    ],
)
def test_local_agreement(spark, words, times, last, tail, new, left):
    heard = live.Heard(tail=tail) if last is None else live.Heard(*last, tail)
    after, got = live.agree(heard, words, times)
    assert got == new and after.tail == left
    if new:
        assert (after.word, after.until) == (new[-1], times[words.index(new[-1])])


def test_decode_window_is_cut_only_when_long_and_committed():
    heard = live.Heard("sol", 9.0)
    assert live.window_start(heard, 5.0) == live.window_start(heard, 12.0) == 0.0
    assert live.window_start(heard, 12.1) == 7.0
    assert live.window_start(live.Heard(), 20.0) == 0.0  # nothing committed: nothing dropped
    assert live.window_start(live.Heard("sol", 1.0), 20.0) == 0.0  # the left context reaches before the window
    assert live.listen(heard, ["a"], [0.1], 0.2) == (heard, [], None)


def test_caption_lines():
    assert live.ends_line(["w"] * 16, ["x"], 0.0) and not live.ends_line(["w"] * 15, ["x"], 9.0)
    assert live.ends_line(["w"], [], 1.3) and not live.ends_line(["w"], [], 1.2) and not live.ends_line([], [], 9.0)


def test_captions_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    kind = "stream_id long, seq long, words array<string>, times array<double>, now double"
    rows = []
    for stream in range(3):
        words = [f"w{x}" for x in rng.integers(0, 5, 70)]
        for seq in range(1, 31):
            n = min(70, seq * 3 if seq < 20 else 60)
            hyp = [w if rng.random() < 0.95 else "zz" for w in words[:n]]
            rows.append((stream, seq, hyp, [0.3 * i for i in range(n)], 0.9 * seq))
    df = spark.createDataFrame(rows, kind)
    df.write.parquet(str(tmp_path / "h"))
    streamed = live.run_to_table(live.captions(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "h"))), "append").collect()
    assert len(streamed) == 90 and any(r["line"] for r in streamed) and max(r["start"] for r in streamed) > 2
    one = live.run_to_table(live.captions(spark.readStream.schema(kind).parquet(str(tmp_path / "h"))), "append").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, live.captions_batch(df).collect()))


def test_backlog_readings():
    assert live.readings(np.arange(100)) == (49, 94, 98, True)
    assert live.readings(np.array([3, 2, 1])) == (2, 3, 3, False) and live.readings(np.array([0, 0, 9, 0])) == (0, 9, 9, False)
    assert live.readings(np.zeros(0, np.int64)) == (0, 0, 0, False)


def test_backlog_state_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "HISTORY", 5)
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, "purchase" if i % 3 == 2 else "view", 1.0, "") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = live.run_backlog(spark, str(tmp_path)).first()
    # readings 14 to 19 are 5, 6, 7, 6, 7, 8; the last five count
    assert (got["produced"], got["consumed"], got["backlog"], got["p50"], got["p99"], got["growing"]) == (14, 6, 8, 7, 8, True)


def test_interval_join_deals_a_user_over_time(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", 1, t, 1.0, "") for i, (h, m, t) in enumerate([(0, 50, "click"), (1, 10, "purchase"), (1, 50, "purchase"), (1, 51, "purchase"), (0, 40, "purchase")])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    out = live.run_to_table(live.interval_join(live.event_stream(spark, str(tmp_path)), "click", "purchase", 3600), "append").collect()
    assert sorted(r["ts_b"].strftime("%H:%M") for r in out) == ["01:10", "01:50"]


def test_single_flight():
    ran = []
    assert live.single_flight(lambda: False, lambda: ran.append(1)) and not live.single_flight(lambda: True, lambda: ran.append(2)) and ran == [1]


def test_agreement_stream_equals_batch(spark, tmp_path):
    rows = [(s, q, [f"w{i}" for i in range(q + s)], [0.6 * i for i in range(q + s)]) for s in range(3) for q in range(1, 5)]
    kind = "stream_id long, seq long, words array<string>, times array<double>"
    df = spark.createDataFrame(rows, kind)
    df.write.parquet(str(tmp_path / "h"))
    streamed = live.run_to_table(live.agreement(spark.readStream.schema(kind).parquet(str(tmp_path / "h"))), "update")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, live.agreement_batch(df).collect()))


def test_count_windows_keep_the_remainder(spark, tmp_path):
    kind = "stream_id long, seq long, samples array<int>"
    spark.createDataFrame([(1, i, list(range(i * 300, i * 300 + 300))) for i in range(4)], kind).coalesce(1).write.parquet(str(tmp_path / "c"))
    out = live.run_to_table(live.count_windows(spark.readStream.schema(kind).parquet(str(tmp_path / "c"))), "append").orderBy("window").collect()
    assert [(r["window"], r["samples"][0], len(r["samples"])) for r in out] == [(0, 0, 512), (1, 512, 512)]


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("u1:\tref=['mar', 'alto']",), ("u1:\thyp=['mar', \"d'oeste\"]",), ("u1:\ttimestamp_hyp=[1]",)], "value string")
    assert [tuple(r) for r in R.recogs(lines).collect()] == [("u1", ["mar", "alto"], ["mar", "d'oeste"])]
    with pytest.raises(Exception, match="unpaired"):
        R.recogs(lines.limit(1)).collect()
    talk = spark.createDataFrame([("f", i, v) for i, v in enumerate(["ruído", "0:00:05", "pois não", "diga", "", "00:02:10", "até logo"])], "k string, i int, value string")
    assert [tuple(r) for r in R.transcript_blocks(talk, "k", "i", "value").orderBy("start").collect()] == [("f", 5, "pois não diga", 130), ("f", 130, "até logo", None)]
    vocabulary = spark.createDataFrame([(0, "<blk> 0"), (1, ""), (2, "a b 1"), (3, "x")], "line int, value string")
    assert [tuple(r) for r in R.vocabulary_by_line(vocabulary).collect()] == [(0, "<blk>"), (1, "a b"), (2, "x")]
    assert [tuple(r) for r in R.vocabulary_by_id(vocabulary).collect()] == [(0, "<blk>")]
    for name, rate in (("a.WAV", 16_000), ("b.wav", 8000), ("c.txt", 1)):
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(b"\1\0" * 5)
        (tmp_path / name).write_bytes(buffer.getvalue())
    (tmp_path / "d.wav").write_bytes(b"junk")
    wavs = R.files(spark, str(tmp_path)).select("recording_id", R.decode_wav("content").alias("w")).select("recording_id", F.size("w.samples").alias("n"), R.require_format(F.col("w")).alias("e"))
    got = {r["recording_id"]: r for r in wavs.collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["n"] == 5 and got["a"]["e"] is None and got["b"]["e"] == "sample rate 8000" and got["d"]["e"]
    (tmp_path / "votes.csv").write_text("file_path,text,up_votes,down_votes\ndev/sp/1.wav,é é é bom,2,0\nx.wav,y,,1\n")
    votes = R.csv_table(spark, str(tmp_path / "votes.csv"), "file_path string, text string, up_votes string, down_votes string")
    assert sorted(r["n"] for r in votes.select(Q.net_votes(F.col("up_votes"), F.col("down_votes")).alias("n")).collect()) == [-1, 2]
    with pytest.raises(ValueError):
        R.require_rows(votes.limit(0), "votes")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny", "train"), ("b", "z", "dev")], "recording_id string, text string, split string")
    K.manifest(rows, str(tmp_path / "m"))
    assert R.json_lines(spark, str(tmp_path / "m"), "recording_id string, text string").count() == 2
    K.corpus_text(rows, str(tmp_path / "t"), split="split")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["x y"]
    K.tsv(rows.groupBy("split").count(), str(tmp_path / "v"), F.desc("count"), "split")
    K.per_file(rows.withColumn("s", F.lit(1.5)), str(tmp_path / "p"), seconds="s")
    assert tuple(spark.read.json(str(tmp_path / "p" / "summary")).select("files", "characters", "audio_s").first()) == (2, 4, 3.0)
    sounds = spark.createDataFrame([("a", [1, -2, 3]), ("b", None)], "recording_id string, samples array<int>")
    assert [tuple(r) for r in K.wav_files(sounds, str(tmp_path / "w"), rate=8000).collect()] == [("a", "a.wav", 50)]
    back = spark.read.parquet(str(tmp_path / "w")).select(R.decode_wav("content").alias("w")).select("w.samples", R.require_format(F.col("w")).alias("e")).first()
    assert list(back["samples"]) == [1, -2, 3] and back["e"] == "sample rate 8000"
    K.golden(spark.createDataFrame([([1.0, 2.5],)], "v array<double>"), str(tmp_path / "g"), "v", rate=16_000)
    one = spark.read.parquet(str(tmp_path / "g")).first()
    assert np.frombuffer(one["content"], "<f4").tolist() == [1.0, 2.5] and (one["n"], one["rate"]) == (2, 16_000)
    K.error_stats(spark.createDataFrame([("u1", ["a", "b"], ["a", "c", "d"])], "u string, ref array<string>, hyp array<string>"), str(tmp_path / "e"))
    assert tuple(spark.read.option("sep", "\t").csv(str(tmp_path / "e")).first()) == ("u1", "2", "1", "1", "0", "1")
    K.card(rows.limit(1), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        K.card(rows, str(tmp_path / "c2"))
    assert K.markdown_report(rows.select("split"), "Splits").startswith("# Splits")
    with pytest.raises(ValueError):
        K.markdown_report(spark.range(200), "Too long")


def test_audits(spark):
    rows = spark.createDataFrame([("train", "a", "k1"), ("dev", "a", "k1"), ("dev", "a", None), ("dev", "b", None)], "split string, corpus string, k string")
    leaks = C.split_overlap(rows, "split", "corpus", "k")
    assert [tuple(r) for r in leaks.collect()] == [("a", "dev", "train", 1)] and C.leak_exit_code(leaks) == 1 and C.leak_exit_code(leaks.limit(0)) == 0
    assert sorted(map(tuple, C.unverifiable(rows, "split", "corpus", "k").collect())) == [("a", "dev", 1), ("b", "dev", 1)]
    seg = spark.createDataFrame([("dev", "", 0, True), ("dev", "x", -1, True), ("dev", "x", 1, False), ("dev", "x", 2, True)], "split string, t string, v int, p boolean")
    assert tuple(C.corpus_counts(seg, F.col("t"), F.col("v"), 0, F.col("p")).first()) == ("dev", 4, 1, 1, 1, 1)
    assert tuple(C.corpus_counts(seg, F.col("t"), None, None, F.col("p")).first()) == ("dev", 4, 2, 1, 1, 0)
    assert C.disjoint_ids([rows.limit(1), rows.filter("k is null").limit(1)], "k").count() == 2
    with pytest.raises(ValueError):
        C.disjoint_ids([rows, rows], "k")


def test_guards(spark):
    with pytest.raises(ValueError):
        C.guard_split("dev", 1)
    C.guard_split("train", 1)
    with pytest.raises(ValueError):
        C.refuse_pseudo_labels(spark.createDataFrame([(True,)], "pseudo_label boolean"))
    with pytest.raises(ValueError):
        C.paired(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int"), "k")
    with pytest.raises(ValueError):
        C.weighted_choice(F.lit(0.5), [("a", 0.0)])
    with pytest.raises(Exception, match="no label"):
        C.label_with_fallback(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(9, "x")], "key int, l string"), "a", "b", "l").collect()
    assert [r["i"] for r in C.even_indices(spark, 10, 1).collect()] == [0] and C.even_indices(spark, 3, 9).count() == 3


def test_model_hook(spark):
    df = spark.createDataFrame([("aa",), ("b",)], "x string")
    assert sorted(r["n"] for r in C.infer(C.length_sorted(df, "x"), lambda: lambda s: s.str.len(), "x", "n", "bigint").collect()) == [1, 2]


def test_two_models_and_padded_batches(spark):
    df = spark.createDataFrame([("aa",), ("b",)], "x string")
    both = C.infer_both(df, lambda: lambda s: s + "1", lambda: lambda s: s + "2", "x")
    assert sorted(map(tuple, both.collect())) == [("aa", "aa1", "aa2"), ("b", "b1", "b2")]
    frames = spark.createDataFrame([(i, [[float(i), 1.0]] * i) for i in range(1, 6)], "i int, f array<array<double>>").coalesce(1)
    out = C.infer_padded(frames, lambda: lambda x, n: [f"{x.shape[1]}:{k}:{row.sum():g}" for row, k in zip(x, n, strict=True)], "f", "o", "string", batch=2)
    assert {r["i"]: r["o"] for r in out.collect()} == {1: "2:1:2", 2: "2:2:6", 3: "4:3:12", 4: "4:4:20", 5: "5:5:30"}


def test_phoneme_targets(spark):
    symbols = spark.createDataFrame([("oi", 0, "o"), ("oi", 1, "i"), ("aia", 0, "a"), ("aia", 1, "i"), ("aia", 2, "a")], "text string, pos int, s string").withColumn("line", F.when(F.col("text") == "oi", 0).otherwise(1))
    ids = {r["s"]: r["id"] for r in C.first_seen_vocabulary(symbols, ["line", "pos"], "s").collect()}
    assert ids == {"o": 2, "i": 3, "a": 4}
    rows = C.with_targets(spark.createDataFrame([("oi",), ("x",)], "text string"), spark.createDataFrame([("oi", [2, 3])], "text string, ids array<int>"))
    assert {r["text"]: r["ids"] for r in rows.collect()} == {"oi": [2, 3], "x": [1]}


def test_telephone_band():
    """Gain of the band pass from its analog prototype, by frequency; causal, from rest."""
    n = 16_000
    for hz in (60, 150, 300, 1000, 2500, 3400, 3800):
        x = np.sin(2 * np.pi * hz * np.arange(n) / 8000)
        y = G.band_limit(x)[n // 2 :]
        warp = lambda f: np.tan(np.pi * f / 8000)
        w, lo, hi = warp(hz), warp(300), warp(3400)
        want = 1 / np.sqrt(1 + ((w * w - lo * hi) / (w * (hi - lo))) ** 8)
        assert abs(np.sqrt(2 * np.mean(y**2)) - want) < 0.005, hz
    assert len(G.band_limit(np.zeros(0))) == 0 and G.band_limit(np.eye(1, 9)[0])[0] != 0


def test_channels_go_through_the_telephone_one_by_one(spark):
    a = (np.sin(np.arange(1600) / 5) * 9000).astype(int).tolist()
    b = (np.sin(np.arange(1600) / 9) * 5000).astype(int).tolist()
    df = spark.createDataFrame([([a, b], a, b)], "s array<array<smallint>>, a array<smallint>, b array<smallint>")
    r = df.select(G.telephone_channels(F.col("s")).alias("s"), G.telephone(F.col("a")).alias("a"), G.telephone(F.col("b")).alias("b")).first()
    assert r["s"] == [r["a"], r["b"]] and len(r["a"]) == 1600


def test_reports_and_cards(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.md").write_text("# A")
    got = {r["name"]: (r["text"], r["error"]) for r in R.reports(spark, str(tmp_path / "r"), ["a.md", "b.md"]).collect()}
    assert got == {"a.md": ("# A", None), "b.md": (None, "missing report b.md")}
    (tmp_path / "card.json").write_text('{"x": {"y": "7"}}')
    assert R.card_field(spark, str(tmp_path / "card.json"), "x.y") == "7" and R.card_field(spark, str(tmp_path / "card.json"), "z") is None


def test_command_lines(spark, tmp_path, capsys):
    from quillforge import cli

    (tmp_path / "a.txt").write_text("u1:\tref=['x', 'y']\nu1:\thyp=['x']\n")
    assert cli.main(["error-rate", str(tmp_path / "a.txt")], spark) == 0 and "0.5" in capsys.readouterr().out
    assert cli.main(["compare", str(tmp_path / "a.txt"), str(tmp_path / "a.txt"), "--boot", "20"], spark) == 0
    rows = [("train", "c", "k"), ("dev", "c", "k"), ("dev", "c", None)]
    spark.createDataFrame(rows, "split string, corpus string, key string").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame(rows[1:], "split string, corpus string, key string").write.parquet(str(tmp_path / "clean"))
    assert cli.main(["overlap", str(tmp_path / "s")], spark) == 1 and cli.main(["overlap", str(tmp_path / "clean")], spark) == 0
    spark.createDataFrame([("oi", "oj"), ("ai", "aj")], "text string, phonemes string").write.parquet(str(tmp_path / "ph"))
    assert cli.main(["phonemes", str(tmp_path / "ph"), str(tmp_path / "targets")], spark) == 0
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "targets")).collect()) == ['{"text":"ai","ids":[2,3]}', '{"text":"oi","ids":[4,3]}']
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "1.wav").write_bytes(b"x")
    (tmp_path / "votes.csv").write_text("file_path,text,up_votes,down_votes,dataset\np/1.wav,Bom,1,0,d\np/2.wav,Sim,1,0,d\n")
    assert cli.main(["prepare", str(tmp_path / "votes.csv"), str(tmp_path / "audio"), str(tmp_path / "cuts"), "--min-net-votes", "0"], spark) == 0
    assert [r["id"] for r in R.json_lines(spark, str(tmp_path / "cuts"), "id string").collect()] == ["train_0000000"]
    with pytest.raises(ValueError):
        cli.main(["prepare", "x", "y", "z", "--split", "dev", "--min-net-votes", "0"], spark)
    (tmp_path / "tokens.txt").write_text("a 0\nb 1\n")
    assert cli.main(["card", str(tmp_path / "tokens.txt"), str(tmp_path / "model"), "--wer", "0.1"], spark) == 0
