import re
import time

from hypothesis import given, settings, strategies as st

from reco.llm import url_filter as uf
from reco.llm.queries import RULES
from tests.llm.tables import PAGES, clashing, empty

URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.org/x", "http://www.example.org/es/1", "http://example.org/es",
        "http://EXAMPLE.ORG/en/1", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/9?u=http://b.org/", "http://x.com/de/#t",
        "http://x.com?a=/de/", "ftp://u@a.b.com:80/de/x", "http://a..com/fr/", "http://com./fr/", "x://y://z.org/", "http://\u00c4.ORG/\n/es/",
        "http://example.org/en/1" + "9" * 5000, "://com/fr/"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    r = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"))
    return host, path, r.host + r.path, r.verdict


def run(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df, uf.rule_table(spark, rules)).collect()}


def test_awkward_urls(spark):
    got = run(spark, URLS, RULES)
    assert got == {i: brute(u, RULES) for i, u in enumerate(URLS)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.from_regex(r"https?://([ab]\.){0,3}(com|org)(/[a-c]{0,3}){0,3}", fullmatch=True), min_size=30, max_size=60),
       st.lists(st.builds(uf.Rule, st.sampled_from(["allow", "block"]), st.sampled_from(["com", "a.com", "b.a.org", "org"]),
                          st.sampled_from(["/", "/a", "/a/b", "/abc/"])), max_size=8, unique_by=lambda r: (r.host, r.path)))
def test_random_rules(spark, urls, rules):
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_repeats_extra_columns_and_empty_tables(spark):
    rules = uf.rule_table(spark, RULES)
    df = spark.createDataFrame([(1, "http://a.org/x", "h")] * 3 + [(None, None, None)], PAGES)
    out = uf.judge(clashing(df, "rule", "Digest", "prefix", "_hit"), rules)
    assert out.count() == 4 and {"Digest", "prefix", "_hit", "extra_map"} <= set(out.columns)
    assert out.columns.count("rule") == 1
    assert uf.judge(empty(spark, PAGES), rules).count() == 0
    assert {r.verdict for r in uf.judge(df, uf.rule_table(spark, []), default="block").collect()} == {"block"}


def test_a_host_of_very_many_labels(spark):
    """Work follows the rules' numbers of labels, not the host's."""
    host = "a." * 100_000 + "example.org"
    urls = [f"http://{host}/en/1", f"http://{host}.net/en/1", "http://" + "." * 50_000 + "com/de/", "http://x/" + "y/" * 100_000]
    start = time.time()
    assert run(spark, urls, RULES) == {i: brute(u, RULES) for i, u in enumerate(urls)}
    assert time.time() - start < 60
