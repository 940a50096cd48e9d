import os
import random
import re
import time

from oracle import database, rows
import pytest
from tidemill.llm import urls

RULES = [*urls.HOST_RULES, *urls.read_rules()]
URLS = ["http://COM/", "http://com", "https://a.b.EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://xwww.example.com/en/", "http://x.net/es/", "http://x.net/ES/", "http://notnet/es/", "nothing", None, "", "http://x.org/login", "http://x.org/docs/login?a", "http://x.org/logins", "://net/fr/", "http://a.org/x.exe", "http://ads.foo.org/a", "http://example.com:80/en/", "a://b://com/", "http://x.com?/en/", "http://wıki.com/", "http://tracker.x.org/\nq", "http://É.net/es/a", "http://doubleclick.net", "http://x.doubleclick.net.org/"]


def parts(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL)
    return re.sub("[A-Z]", lambda c: chr(ord(c[0]) + 32), m[1]), m[2]


def brute_force(url, rules):
    host, path = parts(url)
    best = None
    for rule in rules:
        if rule.is_host:
            h, p = rule.pattern.split("/", 1)
            fits = (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        else:
            fits = re.search(rule.regex, host + path, re.DOTALL) is not None
        if fits:
            best = urls.better(best, rule)
    return host, path, best.pattern if best and best.is_host else None, best.action if best else "allow"


def test_contract_rules_on_odd_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, RULES).collect()}
    assert found == {i: brute_force(u, RULES) for i, u in enumerate(URLS)}


def test_many_rules_in_several_passes_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(2)
    labels = ["ads", "shop", "news", "a", "b1", "x%20y", "En"]
    hosts = [".".join(rng.choices(["ads", "shop", "news", "a", "b1", "com", "net"], k=rng.randrange(1, 4))) for _ in range(40)]
    rules = [urls.Rule(rng.choice(("allow", "block")), f"{h}/" + rng.choice(("", "en/", "a")), True) for h in hosts]
    rules += [urls.Rule(rng.choice(("allow", "block")), rng.choice(("||", "", "*")) + rng.choice(("/", ".")) * rng.randrange(2) + rng.choice(labels) + rng.choice(("^", "*", "/", ".", "*a^"))) for _ in range(60)]
    seen = [f"{rng.choice(('http', 'x'))}://{rng.choice(hosts)}/{'/'.join(rng.choices([*labels, 'en', ''], k=rng.randrange(4)))}{rng.choice(('', '?q', '#f'))}" for _ in range(600)]
    df = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(seen)], "page_id int, url string, verdict string, host int").repartition(3)
    monkeypatch.setattr(urls, "RULES_AT_ONCE", 30)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, rules).collect()}
    assert found == {i: brute_force(u, rules) for i, u in enumerate(seen)}


def test_rules_are_filed_under_the_rarest_token():
    index = urls.RuleIndex([urls.Rule("block", "/shop/rare/"), urls.Rule("block", "*free*")], {"shop": 9, "rare": 2})
    assert list(index.filed) == ["rare"] and len(index.rest) == 1


def test_sql_says_the_same(spark, data):
    from tidemill.llm.queries import ORACLE_SQL, op1_url_filter

    expected = database(data).sql(ORACLE_SQL["op1_url_filter"])
    found = op1_url_filter(spark, data)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())
    assert urls.filter_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_an_index_is_built_once_in_a_worker_and_rules_are_compiled_when_tried(monkeypatch):
    made = []
    plain = urls.RuleIndex.__init__
    monkeypatch.setattr(urls.RuleIndex, "__init__", lambda self, *a: made.append(1) or plain(self, *a))
    rules = [urls.Rule("block", f"/word{i}/") for i in range(100_000)]
    start = time.process_time()
    indexes = [urls._index("one", lambda: (rules, {})) for _ in range(5)]
    assert len(made) == 1 and len(set(map(id, indexes))) == 1 and time.process_time() - start < 5
    assert [r.pattern for r in indexes[0].fitting("x.org/word7/a")] == ["/word7/"] and len(indexes[0].compiled) == 1
    urls._index("two", lambda: (rules[:1], {}))
    assert len(made) == 2 and list(urls._built) == ["two"]


def test_parts_of_a_list_are_not_held_together(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h.org/word{i % 9}/") for i in range(50)], "page_id int, url string")
    rules = [urls.Rule("block", f"/word{i}/") for i in range(6)]
    monkeypatch.setattr(urls, "RULES_AT_ONCE", 2)
    found = urls.filter_urls(df, rules)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.page_id: r.verdict for r in found.collect()} == {i: "block" if i % 9 < 6 else "allow" for i in range(50)}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("block", "net/x/", True), ("block", "/y/", None), ("block", "/y/", None), ("drop", "/z/", False), ("allow", None, False), ("allow", "", True)], "action string, pattern string, is_host boolean")
    table = table.withColumn("id", table.pattern)
    assert urls.rules_from(table.where("false")) == [] and urls.rules_from(table) == [urls.Rule("block", "/y/"), urls.Rule("block", "net/x/", True)]
    df = spark.createDataFrame([(1, "http://a.net/x/1"), (2, "http://b.org/y/"), (3, "http://b.org/z/")], "page_id int, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, urls.rules_from(table)).collect()} == {1: ("net/x/", "block"), 2: (None, "block"), 3: (None, "allow")}
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_long_and_repeated_urls(spark):
    long = "http://x.org/" + "a/" * 200_000 + "casino/"
    rows = [(1, long), (1, long), (2, "http://adult-x.org/"), (3, "http://free-bets.org/a"), (4, "http://betsy.org/"), (5, "http://x.org/wiki/a/casino/")]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), RULES).collect()
    assert sorted((r.page_id, r.verdict) for r in found) == [(1, "block"), (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow")]


def test_rules_of_the_list_file_decide_pages(spark, data):
    """Which rules decide the pages of sf0.1, and how many are tried for it, against trying all."""
    pages = spark.read.parquet(f"{os.path.dirname(data)}/sf0.1/pages.parquet").select("page_id", "url").collect()
    texts = ["".join(parts(p.url)) for p in pages]
    tokens = [set(urls.TOKEN.findall(t.lower())) for t in texts]
    index = urls.RuleIndex(RULES, {t: sum(t in x for x in tokens) for t in {t for r in RULES for t in r.tokens()}})
    decided = [max((r for r in index.fitting(t)), key=lambda r: (r.is_host, len(r.pattern)), default=None) for t in texts]
    blocked = {r.pattern for r in decided if r and not r.is_host}
    assert len({r.pattern for r in decided if r and r.is_host}) == 4 and blocked
    tried = sum(len(index.candidates(t)) for t in texts) / len(texts)
    assert len(RULES) > 400 and tried < 5
    some = [t for t in texts if "adult" in t or "casino" in t or "bets" in t or "spam" in t or "track" in t][:60] + texts[:40]
    assert all(set(index.fitting(t)) == {r for r in RULES if re.search(r.regex, t, re.DOTALL)} for t in some)


def test_several_rules_and_exceptions_of_the_list_change_verdicts(spark):
    blocked = ["http://a.org/x/casino/1", "http://blog.casino-win.org/", "http://www.spam-farm.org/en/1", "http://m.ads-track.org/", "http://x.cheap-pills.net/en/1", "http://x.org/login", "http://x.org/a.zip", "http://x.org/wiki/login"]
    allowed = ["http://a.org/wiki/x/casino/1", "http://x.org/docs/login", "http://casinos-and-more.com/", "http://x.org/logins", "http://x.org/casinox/"]
    df = spark.createDataFrame(list(enumerate(blocked + allowed)), "page_id int, url string")
    verdicts = lambda rules: {r.page_id: r.verdict for r in urls.filter_urls(df, rules).collect()}
    assert verdicts(RULES) == {i: "block" if i < len(blocked) else "allow" for i in range(len(blocked + allowed))}
    without = verdicts([r for r in RULES if r.is_host or r.action == "block"])
    assert [allowed[i - len(blocked)] for i, v in without.items() if i >= len(blocked) and v == "block"] == allowed[:2]
    assert len({r.pattern for u in blocked for r in RULES if re.search(r.regex, "".join(parts(u)))}) >= len(blocked) - 1


def test_lists_of_rules():
    text = "# c\n\nwords a x y\nwords b z\n block /{a}/{b|a}^ \nallow ||{b}.\nallow ||z.\nblock plain\n"
    assert urls.parse_rules(text) == [urls.Rule("block", f"/{i}/{j}^") for i in "xy" for j in "zxy"] + [urls.Rule("allow", "||z."), urls.Rule("block", "plain")]
    assert urls.parse_rules("") == []
    for wrong in ("drop /x/", "block", "block {none}"):
        with pytest.raises((ValueError, KeyError)):
            urls.parse_rules(wrong)
