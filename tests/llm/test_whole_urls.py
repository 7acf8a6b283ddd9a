from orrery.llm import queries, urls


def judged(weights, rows):
    blocked = [(urls.unwanted(weights, *urls.split(url)) >= urls.SURE, label) for url, label in rows]
    of = lambda want: [b for b, label in blocked if label == want]
    return sum(of(1)) / len(of(1)), sum(of(0)) / len(of(0))


def test_words_left_out_of_the_training():
    everything = frozenset(urls.UNWANTED + urls.WANTED)
    recall, false = [], []
    for fold in range(5):
        skip = frozenset(urls.UNWANTED[fold::5] + urls.WANTED[fold::5])
        found = judged(urls.train(urls.labelled_urls(skip)), urls.labelled_urls(everything - skip))
        recall.append(found[0])
        false.append(found[1])
    assert sum(recall) / 5 >= 0.5 and sum(false) / 5 <= 0.04


def test_words_of_the_training():
    recall, false = judged(urls.train(urls.labelled_urls()), urls.labelled_urls())
    assert recall >= 0.95 and false <= 0.01


def test_rules_against_python(spark):
    given = [None, "", "x", "http://a.org/b", "http://org/", "http://www.example.org/es/1", "http://example.org/esx/", "http://example.org/en/12?q", "http://a.com/fr/", "http://A.COM/de/x", "http://com/de", "http://xorg/", "http://" + "y" * 100_000 + ".com/fr/z"]

    def expected(url):
        host, path = urls.split(url)
        fits = [(len(rule), rule, kind) for kind, rule in queries.RULES for own, _, start in (rule.partition("/"),) if (host == own or host.endswith("." + own)) and path.startswith("/" + start)]
        return max(fits)[1:] if fits else (None, None)

    pages = spark.createDataFrame([(i, u, "s", "H") for i, u in enumerate(given)], "page_id long, url string, `sc.ore` string, HOST string")
    found = {r.page_id: r for r in urls.judge(pages, rules=queries.RULES).collect()}
    assert len(found) == len(given)
    for i, url in enumerate(given):
        rule, verdict = expected(url)
        assert (found[i].host, found[i].path) == urls.split(url) and found[i].rule == rule and found[i]["sc.ore"] == "s"
        assert found[i].verdict == verdict if rule else found[i].verdict in ("allow", "block")
    assert all(found[i].score == 0 and found[i].verdict == "allow" for i in (0, 1, 2))
    assert urls.judge(pages.limit(0), rules=queries.RULES).count() == 0
