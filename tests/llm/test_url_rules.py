import re

import pytest

from granary.llm import url_rules as u
from granary.llm.queries import HOST_RULES, PATTERN_RULES

URLS = [
    "http://a.com/x", "https://EXAMPLE.com/en/1?q=/fr/", "http://www.Example.com/en/", "http://sub.www.example.com/en/2", "http://example.com/EN/", "http://notexample.com/en/",
    "http://x.net/es/", "http://x.net/esx", "http://net/fr/a#b", "http://x.com", "x.com/a", "", None, "://", "http://", "http://a.com?x=/", "https://b.net:80/es/?utm_source=feed",
    "http://ads.b.org/", "http://ads1.b.org/", "http://b.org/?PHPSESSID=1&phpsessid=2", "http://cheap-pills.b.org/", "ftp://x://com/", "http://b.org/a?page=1&utm_source=feed", "http://É.com/é",
]


def plain(url):
    scheme, sep, rest = (url or "").partition("://")
    host, path = re.match("([^/?#]*)([^?#]*)", rest if sep else "", re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in HOST_RULES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.text), r.text, r.verdict))
    others = [r for r in PATTERN_RULES if re.search(r.pattern, url or "")]
    other = max(((r.verdict == "allow", r.text) for r in others), default=None)
    rule = max(fits)[1] if fits else None
    verdict = max(fits)[2] if fits else ("allow" if other is None or other[0] else "block")
    return host, path, rule, other and other[1], verdict


@pytest.mark.parametrize("limit", [1000, 0])
def test_against_plain_version(spark, limit):
    rows = [(k, url, "x") for k, url in enumerate(URLS + URLS[:2])]
    got = u.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), HOST_RULES + PATTERN_RULES, index_limit=limit).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: plain(url) for k, url, _ in rows}
    assert u.judge_urls(spark.createDataFrame([], "page_id long, url string"), HOST_RULES).count() == 0


def test_rules_are_filed_under_what_is_rare(spark):
    rule = u.host_rule("example.com/en/", "block")
    assert rule.literals == ("example", "com", "en")
    assert u.rarest_token(rule, {"com": 9, "example": 7, "en": 2}) == "en"
    assert u.host_rule("a.org/pre", "block").literals == ("a", "org")
    assert [r.verdict for r in u.judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), []).collect()] == ["allow"]
    with pytest.raises(ValueError):
        u.pattern_rule("x", "block", "x")
