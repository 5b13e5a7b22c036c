import re

from sensorlake.llm import url_filters as uf

SCHEMA = "page_id long, url string"


def plain(url, lines):
    """By the rules' own words, without tokens or regular expressions of whole rules."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    host = host.translate(str.maketrans(uf.UPPER, uf.LOWER))
    path = re.match(r"[^?#]*", tail)[0]
    fits = []
    for line in lines:
        action, pattern = line.split(" ", 1)
        if pattern.startswith("||"):
            h, _, p = pattern[2:].partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(pattern), pattern[2:], action))
    rule = max(fits)[1] if fits else None
    return host, path, rule, max(fits)[2] if fits else None


def judged(spark, rows, lines=None, schema=SCHEMA):
    rules = None if lines is None else uf.rules_table(spark, lines)
    return uf.judge(spark.createDataFrame(rows, schema), rules).collect()


def test_hosts_paths_and_longest_rule(spark):
    urls = [
        "http://Example.ORG/es/x", "https://a.example.org/en/12?x#y", "https://example.org/en/2", "http://notexample.org/es/", "http://org", "http://org/", "http://org?x/",
        "http://x.com/fr/a", "http://x.com/fr", "http://x.com/FR/a", "https://com/de/", "no scheme", "://", "http://a/?u=http://example.org/es/", "http://example.org#/es/", "http://example.org./es/", None, "",
    ]
    got = {r["page_id"]: r for r in judged(spark, list(enumerate(urls)))}
    for k, url in enumerate(urls):
        host, path, rule, action = plain(url, uf.SITE_RULES)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), url
        assert got[k]["verdict"] == (action or "allow"), url


def test_patterns_decide_where_no_site_rule_fits(spark):
    urls = ["http://www.cheap-pills.example.net/", "http://pillstore.net/", "http://x.net/ADULT/education/", "http://x.net/adult", "http://x.net/redirect?a&url=http", "http://ads.example.org/", "http://x.net/a?casino"]
    got = {r["page_id"]: (r["verdict"], r["pattern"], r["rule"]) for r in judged(spark, list(enumerate(urls)))}
    assert got == {0: ("block", "^pills^", None), 1: ("allow", None, None), 2: ("allow", "^adult^education^", None), 3: ("block", "^adult^", None), 4: ("block", "^redirect*url=http", None), 5: ("allow", None, "org/"), 6: ("block", "^casino^", None)}


def test_a_rule_stands_under_its_rarest_token_and_only_whole_tokens_count(spark):
    assert uf.compiled("block ||example.org/en/1")[4] == ["en", "example", "org"]
    assert uf.compiled("block ads*in^pop^up")[4] == ["pop"]  # the others may go on beyond what is written
    assert uf.compiled("allow */x*")[4] == []
    pages = spark.createDataFrame([(k, f"http://a.example.org/es/{k}") for k in range(9)] + [(9, "http://b.com/fr/")], SCHEMA)
    rest = uf.after_scheme(pages["url"])
    index = uf.rule_index(pages.select(rest.alias("address")), uf.rules_table(spark, ["block ||example.org/es/", "block ^fr^", "block x*"]), True)
    tokens = {r["regex"][:12]: r["token"] for r in index.collect()}
    assert sorted(tokens.values()) == ["", "es", "fr"]


def test_rules_without_tokens_and_odd_characters(spark):
    rows = [(1, "http://x.net/a(b"), (2, "http://x.net/Kads/"), (3, "http://x.net/" + "a/" * 20_000 + "casino"), (4, "http://x.net/\nads")]
    got = {r["page_id"]: r["verdict"] for r in judged(spark, rows, ["block (b", "block ^ads^", "block ^casino^"])}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block"}


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark):
    schema = "page_id long, url string, host string, rule string, token string, __row long, html string"
    rows = [(None, "http://x.org/", "h", "r", "t", 5, None), (7, None, None, None, None, None, None), (7, None, None, None, None, None, None), (7, "http://X.org/a", "", "", "", 1, "")]
    got = sorted(((r["page_id"] or -1, r["host"], r["rule"] or "", r["verdict"]) for r in judged(spark, rows, schema=schema)))
    assert got == [(-1, "x.org", "org/", "allow"), (7, "", "", "allow"), (7, "", "", "allow"), (7, "x.org", "org/", "allow")]
    assert judged(spark, []) == []
    assert [r["verdict"] for r in judged(spark, [(1, "http://casino.net/")], [])] == ["allow"]


def test_many_rules_shuffle_and_no_python_runs(spark, monkeypatch):
    rows = [(k, f"http://h{k % 7}.example.net/{'ads' if k % 3 else 'x'}/{k}") for k in range(60)]
    few = sorted(judged(spark, rows))
    monkeypatch.setattr(uf, "BROADCAST_RULES", 1)
    out = uf.judge(spark.createDataFrame(rows, SCHEMA))
    assert sorted(out.collect()) == few and sum(r["verdict"] == "block" for r in few) == 40
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
