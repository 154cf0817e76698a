import random
import re

from quillforge.llm import url_filters as u


def judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        h, p = h.lower(), slash + p
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), verdict, rule))
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "http://www.example.com/en", "http://a.b.net/es/1",
    "http://net/es/", "http://com", "http://com/", "ftp://x.com?/a", "http://xcom/", "http://a..com/ü/é", "http://a.com/x://b.net/fr/", "http://É.COM/A", "x\ny://a.net/fr/\n2", "http://b.net/fr",
]


def check(spark, urls, rules):
    df = spark.createDataFrame([(i % 7, x, "clash") for i, x in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    got = u.filter_urls(df, u.rules_frame(spark, rules)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i % 7, *judge(x, rules)) for i, x in enumerate(urls)), key=key)


def test_query_rules_and_random_urls(spark):
    rng = random.Random(1)
    made = [f"http://{'.'.join(rng.choices(['www', 'example', 'a', 'com', 'net'], k=rng.randint(1, 4)))}/{rng.choice(['en/', 'es/', 'fr/', 'x', ''])}{rng.choice(['', 'a/b'])}" for _ in range(300)]
    check(spark, URLS + made + made[:20], u.QUERY_RULES)


def test_other_shapes_and_ties(spark, monkeypatch):
    rules = [("b.com/x/", "block"), ("a.b.com/", "allow"), ("c.com", "block"), ("d.com/pre", "block"), ("", "block")]
    urls = ["http://a.b.com/x/", "http://c.com", "http://z.c.com/q", "http://d.com/prefix", "http://d.com/pr", "http://d.com/pre"]
    check(spark, urls, rules[:-1])
    monkeypatch.setattr(u, "BROADCAST_RULES", 0)
    check(spark, urls, rules[:-1])


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in u.filter_urls(df, u.rules_frame(spark, [("x", "allow")]).limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]
    assert u.filter_urls(df.limit(0), u.rules_frame(spark, u.QUERY_RULES)).collect() == []
