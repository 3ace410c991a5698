"""URL rules against a loop over all rules, and the SQL of the query."""

import random

import pytest

from billquarry.llm import queries, urls
from tests.test_queries import table


def plain(url, rules, otherwise):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, otherwise)


def test_verdicts_match_a_loop(spark):
    chance = random.Random(3)
    label = lambda: chance.choice(["a", "b", "org", "com", "EXAMPLE", "É"])
    path = lambda: "".join(chance.choice(["/", "x", "en/", "1", "?", "#", "é"]) for _ in range(chance.randrange(6)))
    rules = {(".".join(label().lower() for _ in range(chance.randrange(1, 3))), "/" + path().replace("?", "").replace("#", "")): chance.choice(["allow", "block"]) for _ in range(25)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [(None, "/", "block"), ("a", None, "block"), ("a", "/", None)]
    given = ["http://" + ".".join(label() for _ in range(chance.randrange(1, 5))) + chance.choice(["", "/"]) + path() for _ in range(400)]
    given += [None, "", "no scheme/at/all", "://", "x://?", "http://A.ORG://b/c", "http://" + "a." * 3000 + "org/" + "y" * 9000, given[0], given[0]]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS short", "3 AS digest", "4 AS labels")
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    judged = urls.judge(pages, known, "method")
    assert judged.columns == ["page_id", "url", "short", "digest", "labels", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: plain(u, rules, "method") for i, u in enumerate(given)}
    assert urls.judge(pages.where("false"), known).count() == 0
    assert {r.verdict for r in urls.judge(pages, known.where("false")).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["op5_url_filters"])
def test_sql_gives_the_same_rows(spark, data, con_llm, name):
    df = queries.QUERIES[name](spark, data)
    result = con_llm.execute(queries.SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
