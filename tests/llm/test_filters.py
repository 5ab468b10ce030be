"""URL rules, clustering and the filter audit against brute force and SQL, and their defined results on odd rows."""

import collections
import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import centroids, filter_audit, url_rules
from pagewright.llm.common import flat, table, words_of

SF = "/root/testdata/sf0.001"


def oracle(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def equal_to_oracle(got, sql, *tables):
    names, want = oracle(sql, *tables)
    assert set(names) == set(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))


# 11 URL rules


def slow_verdict(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([after.index(c) for c in "/?#" if c in after], default=len(after))
    host, rest = after[:n].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), after[n:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None)))


URLS = [None, "", "no scheme", "http://NET/", "http://net", "http://a.net?x", "https://Example.NET/en/1", "https://x.example.net/en", "https://notexample.com/de/", "http://x.example.com/de/a#b", "http://a.org/fr/://net/", "://b.ORG/fr/x?y", "http://É.net/ü", "http://a.net#/en/", "http://h/" + "word-" * 5000 + "end?q=1"]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(pages, spark.createDataFrame([], "url string, bad boolean")).collect()}
    for i, u in enumerate(URLS):
        want = slow_verdict(u)
        assert got[i] == (*want[:3], want[3] or "allow"), u
    assert url_rules.judged(pages.filter("false"), pages.selectExpr("url", "true as bad")).count() == 0


def slow_rules(urls, limits):
    n, bad = len(urls), sum(b for _, b in urls)
    least = max(limits.min_support, limits.least / n) * n
    seen, hit = collections.Counter(), collections.Counter()
    for tokens, is_bad in urls:
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                seen[part] += 1
                hit[part] += is_bad
    sure = {p: hit[p] / seen[p] for p in seen if hit[p] >= least and hit[p] / seen[p] >= limits.min_confidence and url_rules.wilson_lower(hit[p], seen[p], limits.z) > bad / n}
    return {p: (c, seen[p]) for p, c in sure.items() if not any(sure.get(q, -1) >= c for k in range(1, len(p)) for q in itertools.combinations(p, k))}


def planted(rng, n):
    out = {}
    while len(out) < n:
        host, word = rng.choice(["a.com", "b.com", "c.org"]), rng.choice(["win", "news", "shop"])
        bad = rng.random() < (0.9 if (host, word) == ("b.com", "win") else 0.1)
        out[f"http://{host}/{word}/{len(out)}" + rng.choice(["", "?ref=x"])] = bad
    return out


def test_rules_are_those_of_brute_force_and_hold_out(spark):
    rng = random.Random(3)
    urls = planted(rng, 1500)
    labelled = spark.createDataFrame(list(urls.items()) + list(urls.items())[:200], "url string, bad boolean")  # repeats count once
    limits = url_rules.Limits(min_support=0.01)
    got = url_rules.mined(labelled, limits)
    tokens = {r["url"]: r["t"] for r in labelled.select("url", url_rules.tokens_of(labelled["url"]).alias("t")).distinct().collect()}
    frequent = collections.Counter(t for u in urls for t in tokens[u])
    assert max(len([t for t in tokens[u] if frequent[t] >= 20]) for u in urls) <= url_rules.ITEMS  # nothing is left out here
    want = slow_rules([(tokens[u], b) for u, b in urls.items()], limits)
    assert {items: (c, n) for items, c, n in got} == {p: (pytest.approx(c), n) for p, (c, n) in want.items()} and got
    fresh = planted(random.Random(4), 800)
    pages = spark.createDataFrame(list(enumerate(fresh)), "page_id long, url string")
    verdicts = {r["page_id"]: r for r in url_rules.judged(pages, labelled, rules=[], limits=limits).collect()}
    for i, u in enumerate(fresh):
        assert (verdicts[i]["verdict"] == "block") == ("b.com" in u and "win" in u)
    right = sum((verdicts[i]["verdict"] == "block") == bad for i, bad in enumerate(fresh.values()))
    assert right / len(fresh) > 0.87


def test_index_equals_subset_test():
    rng = random.Random(5)
    tokens = [f"t{i}" for i in range(12)]
    rules = [(tuple(sorted(rng.sample(tokens, rng.randrange(1, 4)))), 1.0, 1) for _ in range(30)]
    rows = [rng.sample([*tokens, "u", "v"], rng.randrange(0, 9)) for _ in range(300)] + [None, []]
    want = [next((i for i, r in enumerate(rules) if set(r[0]) <= set(row or [])), -1) for row in rows]
    assert url_rules.RuleIndex(rules).first(pa.array(rows, pa.list_(pa.string()))).tolist() == want
    assert url_rules.RuleIndex([]).first(pa.array(rows, pa.list_(pa.string()))).tolist() == [-1] * len(rows)


def test_rules_need_labels(spark):
    assert url_rules.mined(spark.createDataFrame([], "url string, bad boolean")) == []
    assert url_rules.mined(spark.createDataFrame([(None, True), ("http://a/", None)], "url string, bad boolean")) == []
    long = spark.createDataFrame([(f"http://h/{i}/" + "/".join(f"w{j}x{'y' * 70}" for j in range(200)), i % 2 == 0) for i in range(60)], "url string, bad boolean")
    assert url_rules.mined(long) == []  # no token tells good from bad, and many frequent ones don't explode


@pytest.mark.parametrize("cells", [url_rules.CELLS, 7])
def test_all_frequent_tokens_of_a_url_take_part(spark, monkeypatch, cells):
    monkeypatch.setattr(url_rules, "CELLS", cells)
    rng, urls = random.Random(8), {}
    while len(urls) < 400:
        words = [w for w in "abcdefghijk" if rng.random() < 0.8]
        pair = [w for w in ("x", "y") if rng.random() < 0.5]
        bad = rng.random() < (0.95 if len(pair) == 2 else 0.1 + 0.05 * ("a" not in words))
        urls[f"http://h.com/{len(urls)}/" + "/".join(words + pair)] = bad
    labelled = spark.createDataFrame(list(urls.items()), "url string, bad boolean").repartition(3)
    tokens = {r["url"]: r["t"] for r in labelled.select("url", url_rules.tokens_of(labelled["url"]).alias("t")).collect()}
    assert max(map(len, tokens.values())) > url_rules.ITEMS + 4
    want = slow_rules([(tokens[u], b) for u, b in urls.items()], url_rules.Limits())
    got = url_rules.mined(labelled)
    assert {items: (c, n) for items, c, n in got} == {p: (pytest.approx(c), n) for p, (c, n) in want.items()}
    assert ("p:x", "p:y") in want and max(map(len, want)) > 2


def test_tokens_that_come_together_make_no_combinations(spark):
    words = "/".join(f"w{j}" for j in range(60))
    rows = [(f"http://h.com/{i}/{words if i % 2 else 'day'}", i % 2 == 1 and i % 6 != 1) for i in range(240)]
    got = url_rules.mined(spark.createDataFrame(rows, "url string, bad boolean"))
    assert sorted(got) == sorted(((f"p:w{j}",), 80 / 120, 120) for j in range(60))


def test_rules_are_mined_from_the_ends_of_long_urls(spark):
    rows = [(f"http://h.com/{'/'.join(f'u{i}x{j}' for j in range(80))}/{'win' if i % 2 else 'day'}", i % 2 == 1) for i in range(120)]
    got = url_rules.mined(spark.createDataFrame(rows, "url string, bad boolean"))
    assert ((("p:win",), 1.0, 60)) in got and not any("p:day" in items for items, _, _ in got)


def test_url_query_covers_all_pages(spark):
    got = {r["page_id"]: r for r in url_rules.op11_url_rules(spark, SF).collect()}
    pages = table(spark, SF, "pages").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for p in pages:
        r, want = got[p["page_id"]], slow_verdict(p["url"])
        assert (r["host"], r["path"], r["rule"]) == want[:3] and r["verdict"] == (want[3] or ("block" if r["mined_rule"] else "allow"))


# 12 clustering


def slow_clusters(vectors, k=16, rounds=3):
    v = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in vectors]
    drawn = sorted(v, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(x) for _, x in drawn]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x: min(range(len(c)), key=lambda j: (d(x, c[j]), j))
    for _ in range(rounds):
        own = [near(x) for _, x in v]
        for j in range(len(c)):
            held = [x for (_, x), o in zip(v, own, strict=True) if o == j]
            if held:
                c[j] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    own = [near(x) for _, x in v]
    inertia = collections.Counter()
    for (_, x), o in zip(v, own, strict=True):
        inertia[o] += d(x, c[o])
    limit = centroids.LONG
    return sorted(((i, o, min(d(x, c[o]), limit), min(inertia[o], limit), min(sum(inertia.values()), limit), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, x), o in zip(v, own, strict=True)), key=repr)


def clusters(rows, **kw):
    return sorted((tuple(r)[:6] for r in centroids.clustered(rows, **kw).collect()), key=repr)


def test_clusters_equal_sql_and_brute_force(spark):
    got = centroids.op12_hamerly(spark, SF)
    equal_to_oracle(got, centroids.SQL, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_clusters(rows)


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(16, 64)) * 4
    rows = [(i, (middles[i % 16] + rng.normal(size=64) * 0.2).tolist()) for i in range(600)]
    out = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    scans = [r["scans"] for r in out.select("scans").collect()]
    assert min(scans) == 1 and sum(scans) < 0.6 * 4 * len(scans)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(2)
    v = lambda *x: ([*x, *[0.0] * 64])[:64]
    good = [(i, v(*(rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)))) for i in range(60)]  # many ties
    good += [(None, v(1.0)), (None, v(1.0)), (5, v(2.0)), (5, v(-2.0)), (70, v(1e6, -1e6)), (71, v(3e8))]
    bad = [(80, None), (81, []), (82, v(1.0)[:63]), (83, v(1.0) + [0.0]), (84, [None, *v()[1:]]), (85, v(float("nan"))), (86, v(float("inf"))), (87, v(-float("inf")))]
    schema = "vec_id long, embedding array<float>, cluster string, v string, id string"
    frame = lambda rows: spark.createDataFrame([(i, e, "x", "y", "z") for i, e in rows], schema)
    assert clusters(frame(good + bad).repartition(3)) == slow_clusters(good)
    assert clusters(frame(good[:5])) == slow_clusters(good[:5])
    assert clusters(frame(bad)) == [] and clusters(frame([])) == []
    assert clusters(frame(good), rounds=0) == slow_clusters(good, rounds=0)
    huge = clusters(frame([(1, v(3e38)), (2, v(-3e38)), (3, v(1.0))]))
    assert [r[1:3] for r in huge] and all(r[2] <= centroids.LONG for r in huge)


def test_components_that_are_large_are_exact():
    rng = np.random.default_rng(3)
    v, c = (rng.integers(-(1 << 40), 1 << 40, (n, 64)) for n in (20, 5))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert centroids.squared(v, c).tolist() == want and centroids.squared_own(v[:5], c).tolist() == [want[i][i] for i in range(5)]


# 13 the audit


def slow_audit(docs, labels):
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        parts[s or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        taken, all_steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                before = set(order[:step])
                taken[f] += len(gone)
                all_steps.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], taken[s[-1]]) for s in all_steps]
    return sorted(out)


def audit(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, n int")
    counts = filter_audit.counted(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(r) for r in filter_audit.audited(counts).collect())


def test_audit_equals_sql(spark):
    equal_to_oracle(filter_audit.op13_filter_audit(spark, SF), filter_audit.SQL, "documents", "labels")


def test_audit_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    labels = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    assert audit(spark, docs[:80], labels) == slow_audit(docs[:80], labels)


def test_audit_of_odd_rows(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice("one two Three $4 fünf".split()) + str(rng.randrange(90)) for _ in range(30_000))
    docs = [(1, None, None), (2, "", "a"), (None, "", "a"), (None, None, ""), (3, "same", "a"), (3, "same", "b"), (3, "same", "b"), (4, "same", None), (9, long, "b"), (9, long, "b"), (8, long, "c"), (5, "ÀÉ AB\x0bc", "c"), (6, "a|b", "ü")]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (4, None, None), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    assert audit(spark, docs, labels) == slow_audit(docs, labels)
    assert audit(spark, docs, []) == slow_audit(docs, []) and audit(spark, [], labels) == []


def test_masks_verify_equal_hashes():
    data, at = flat(pa.array(["ab cd ab", None, "x", "cd ab cd ef"]))
    start, end, row = words_of(data, at)
    for hashes in (None, np.zeros(len(start), np.uint64), np.arange(len(start), dtype=np.uint64) // 2):
        if hashes is not None and len(set(hashes.tolist())) > 1:
            continue
        assert filter_audit.distinct_words(data, start, end, row, 4, hashes).tolist() == [2, 0, 1, 3]
