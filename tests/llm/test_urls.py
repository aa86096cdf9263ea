from tidemark.llm import urls as u

ENTRIES = [("example.com", "block"), ("good.example.com", "allow"), ("good.example.com/bad", "block"), ("good.example.com/bad/fine", "allow"), ("both.org", "block"), ("BOTH.org.", "allow"), ("", "block"), ("x.y/a//b", "block"), ("z", "other")]
CASES = [("http://example.com/x", False, "example.com"), ("https://a.b.EXAMPLE.com.", False, "example.com"), ("http://notexample.com", True, None), ("//good.example.com/ok", True, "good.example.com"), ("http://good.example.com/bad?q=/fine", False, "good.example.com/bad"), ("http://good.example.com/bad/fine/x#y", True, "good.example.com/bad/fine"), ("http://good.example.com/badder", True, "good.example.com"), ("http://user:pw@both.org:80/", True, "BOTH.org."), ("http://x.y/a/b/c", False, "x.y/a//b"), ("http://w.x.y/a/b", True, None), ("", True, None), (None, True, None), ("http:///nohost", True, None), ("not a url", True, None), ("http://example.com/" + "a/" * 20000, False, "example.com")]


def brute(url):
    """Every entry is compared; the longest that covers the URL wins."""
    way, best = u.keys(url), None
    for entry, action in ENTRIES:
        e = u.keys(entry)
        if way and e and action in ("allow", "block") and way[: len(e)] == e:
            rank = (-len(e), action, entry)
            best = min(best, rank) if best else rank
    return best


def test_both_ways_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(CASES * 2)], "page_id long, url string, entry string")
    want = [(k, c[1], c[2]) for k, c in enumerate(CASES * 2)]
    for c in CASES:
        b = brute(c[0])
        assert (b is None or b[1] == "allow", b and b[2]) == c[1:]
    frame = spark.createDataFrame(ENTRIES, "entry string, action string")
    for entries, limit in ((ENTRIES, 99), (ENTRIES, 2), (frame, 99), (frame, 2)):
        got = u.filter_urls(pages, entries, broadcast_entries=limit).orderBy("page_id").collect()
        assert [(r.page_id, r.allowed, r.entry) for r in got] == want


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(pages).count() == 0
    some = spark.createDataFrame([(None, "http://a.b")], "page_id long, url string")
    assert u.filter_urls(some, []).first().allowed


def test_ids_keep_their_type_and_names_may_clash(spark):
    pages = spark.createDataFrame([("p", "http://example.com", 1, "a", "w")], "page_id string, url string, allowed int, action string, ways string")
    for limit in (99, 2):
        assert u.filter_urls(pages, ENTRIES, broadcast_entries=limit).collect() == [("p", "http://example.com", False, "example.com")]
