import random

from folioscope.llm import url_filters


def plain(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("a.b.c.com", "/x", "block"), ("b.c.com", "/xy/long/", "allow"), ("c.com", "", "block"), ("net", "/es/", "allow"),
    ("org", "/a", "block"), ("org", "/ab", "allow"), ("org", "/abc/", "block"),
]
SPECIAL = [
    None, "", "no scheme.com/en/", "http://", "http:///path", "HTTP://WWW.Example.COM/en/x?y#z", "http://com/", "http://xcom/",
    "http://example.com.", "http://.com/", "a://b://c.com/x", "http://É.com/", "http://net/es/", "http://c.com?q=/x", "x\ny://c.com/\n",
    "http://example.com/en", "http://c.com#/", "http://u:p@c.com:80/", "http://a.b.c.com/xy/long/" + "z" * 20_000,
]


def test_equals_plain_rules(shipped):
    random.seed(9)
    hosts = ["com", "example.com", "www.example.com", "net", "a.b.c.com", "z.a.b.c.com", "b.c.com", "c.com", "org", "x.org", "other.de"]
    paths = ["", "/", "/en/", "/en/1", "/es/", "/es", "/x", "/xy/long/1", "/a", "/ab", "/abc/d", "/en/?q=/es/", "/#/es/"]
    urls = SPECIAL + [f"http://{random.choice(hosts)}{random.choice(paths)}" for _ in range(600)]
    pages = shipped.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id bigint, url string, rule string, host int")
    rules = shipped.createDataFrame(RULES, "host string, path string, verdict string")
    rows = sorted(url_filters.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r)[1:] for r in rows] == [plain(u, RULES, "allow") for u in urls]


def test_hot_host_repeated_rows_and_empty_tables(shipped):
    pages = shipped.createDataFrame([(1, "http://www.example.com/en/")] * 500 + [(None, None)], "page_id bigint, url string")
    rules = shipped.createDataFrame(RULES, "host string, path string, verdict string")
    rows = url_filters.judge_urls(pages, rules, default="block")
    assert {tuple(r) for r in rows.groupBy("rule", "verdict").count().collect()} == {
        ("www.example.com/en/", "allow", 500), (None, "block", 1),
    }
    assert url_filters.judge_urls(pages.filter("false"), rules).count() == 0
    none = url_filters.judge_urls(pages, rules.filter("false"))
    assert none.filter("verdict = 'allow' and rule is null").count() == 501


def test_columns_of_any_name_stay(shipped):
    names = ["_first", "_last", "_key", "_is_rule", "_rule", "_rule_path", "_rule_verdict", "_range", "a b"]
    pages = shipped.createDataFrame([(1, "http://www.example.com/en/", *range(9))], "page_id int, url string, " + ", ".join(f"`{n}` int" for n in names))
    row = url_filters.judge_urls(pages, shipped.createDataFrame(RULES, "host string, path string, verdict string")).first()
    assert [row[n] for n in names] == list(range(9)) and row["rule"] == "www.example.com/en/"
