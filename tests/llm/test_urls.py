from keyloom.llm import urls


def brute(url, rules=urls.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:k], rest[k:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest.split("?")[0].split("#")[0]
    best = None
    for v, r in rules:
        h, s, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or (len(r), len(h)) > (len(best[1]), len(best[1].split("/")[0]))):
            best = (v, r)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [None, "", "x", "://", "http://", "http://COM/en/", "a://b.example.com/en/7", "http://example.com/en/8?/en/7", "http://notexample.com/en/7", "http://example.net/de/8#x", "http://q.net/de", "http://org/es/é\n",
        "http://org?x://com/en/", "http://É.COM/en/", "h://a.b.c.d.e.com/en/" + "x" * 100000, "ftp://" + "a." * 5000 + "org/es/", "//com/en/", "http://com./en/"]


def test_filter(spark):
    rows = [(i, u, "h", "clash") for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, extra string")
    got = urls.filter_urls(df)
    assert got.columns == ["page_id", "extra", "host", "path", "rule", "verdict"]
    got = got.collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert urls.filter_urls(df, rules=()).where("verdict <> 'allow'").count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))
    urls.DigestArray.write(str(tmp_path / "a"), {b"ab": 1, b"cd": 0, b"x": 1})
    a = urls.DigestArray(str(tmp_path / "a"))
    assert [a.entry(i) if i >= 0 else None for i in a.find([b"cd", b"ab", b"zz", b"x", b"", b"abcd"]).tolist()] == [b"cd", b"ab", None, b"x", None, None]


def test_columns_that_clash_and_rules_of_equal_length(spark):
    df = spark.createDataFrame([(1, "http://a.b.com/xy/z", "mine", 5)], "page_id long, url string, _url string, address int")
    got = urls.filter_urls(df, rules=(("block", "b.com/xy"), ("allow", "com/xy/z")))
    assert got.columns == ["page_id", "_url", "address", "host", "path", "rule", "verdict"]
    r = got.first()
    assert (r["_url"], r["address"], r["host"], r["path"]) == ("mine", 5, "a.b.com", "/xy/z")
    # of rules of equal length that with the longer host wins
    assert (r["rule"], r["verdict"]) == ("b.com/xy", "block") == brute("http://a.b.com/xy/z", (("block", "b.com/xy"), ("allow", "com/xy/z")))[2:]
