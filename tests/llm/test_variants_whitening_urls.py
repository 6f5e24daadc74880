"""Spelling variants, embedding whitening and URL filters against brute force, and their odd cases."""

import math
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import embedding_whitening as ew, spelling_variants as sv, url_filters as uf
from threadloom.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


# ---- spelling variants

def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows, min_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}
    holes = {}
    for w in counts:
        for i in range(len(w) + 1):
            holes.setdefault((w[:i], w[i:], 0), set()).add(w)
            if i < len(w):
                holes.setdefault((w[:i], w[i + 1:], 1), set()).add(w)
    out = {}
    for w, n in counts.items():
        near = set()
        for i in range(len(w) + 1):
            near |= holes.get((w[:i], w[i:], 1), set())
            if i < len(w):
                near |= holes[w[:i], w[i + 1:], 1] | holes.get((w[:i], w[i + 1:], 0), set())
        near.discard(w)
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, n, len(near))
    result = {}
    for w, (form, n, many) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, n, many, counts.get(form))
    return result


def as_dict(df):
    rows = df.collect()
    found = {r["word"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_variants_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert as_dict(QUERIES["op11_spelling_variants"](spark, SF)) == want
    assert any(form for form, *_ in want.values()) and any(root != form for form, root, *_ in want.values() if form)


@pytest.mark.parametrize("limits", [{"shard": 300}, {"block": 60}, {"shard": 500, "block": 200}])
def test_variants_in_many_shards_and_blocks(spark, limits):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    want = variants([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    assert as_dict(sv.spelling_variants(docs, min_count=2, **limits)) == want


def test_variants_of_odd_rows(spark):
    long = "ab" * 3000
    rows = [
        (1, None), (2, ""), (3, "12 34 é ?"), (None, "Straße Straße straße STRASSE"), (None, "strasse Strasse"),
        (4, "colour colour colour color color color color color color colors"), (4, "colors colors coulour coulour coulour"),
        (5, f"{long} {long} {long}"), (6, f"{long}x {long}x {long}x x{long}"), (7, "Été été ÉTÉÉÉ ÉTÉÉÉ ÉTÉÉÉ Éteeé"),
        (8, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"), (9, "a" * 70_000),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert as_dict(sv.spelling_variants(df)) == variants(rows)
    assert sv.spelling_variants(df.limit(0)).collect() == []


@settings(max_examples=120, deadline=None)
@given(words=st.sets(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=40), data=st.data())
def test_index_finds_what_brute_force_finds(words, data):
    words = sorted(words)
    numbers = [np.array([ord(c) - 96 for c in w]) for w in words]
    index = sv.Index(numbers, 4)
    pattern = data.draw(st.text("abcd", min_size=1, max_size=9))
    exact = data.draw(st.integers(0, len(pattern)))
    rows, found = sv.one_edit(index, np.array([[ord(c) - 96 for c in pattern]]), exact)
    tail = pattern[len(pattern) - exact:]
    head = pattern[:len(pattern) - exact]
    want = [w for w in words if w.endswith(tail) and len(w) >= len(pattern) and one_apart(head, w[:len(w) - exact])]
    assert sorted(words[i] for i in found) == want and set(rows) <= {0}


# ---- embedding whitening

def whiten(vectors, weights=None):
    """Per row and component: what plain numpy makes of the distinct vectors, or of all with ``weights``."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    many = Counter(x)
    fit = [v for v in many for _ in range(many[v] if weights else 1)]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    matrix = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, directions = np.linalg.eigh(matrix.T @ matrix / n)
    values, directions = values[::-1], directions[:, ::-1]
    rows = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviation, rows @ directions / np.sqrt(np.where(values > 1e-9, values, 1)), values / values.sum()


def check_whitened(rows, ids, vectors, components, weights=None):
    n, deviation, white, shares = whiten(vectors, weights)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(ids)
    assert all(set(c) == set(range(1, components + 1)) for c in by.values())
    for k in range(components):
        got = np.array([by[i][k + 1]["whitened"] for i in ids])
        sign = np.sign(np.dot(got, white[:, k]))
        assert np.allclose(got, sign * white[:, k], atol=1e-6)
        assert all(abs(by[i][k + 1]["explained"] / shares[k] - 1) < 1e-9 for i in ids)
    for i, d in zip(ids, deviation):
        assert all((c["n"], c["deviation"]) == (n, d) and c["identity_error"] < 1e-8 for c in by[i].values())


def test_whitening_of_a_whole_table(spark):
    known = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert len(rows) == 16 * len(known)
    check_whitened(rows, [r["vec_id"] for r in known], [r["embedding"] for r in known], 16)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_of_repeated_vectors(spark, weights):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=4).tolist() for _ in range(30)]
    vectors += [vectors[0]] * 40 + [[c + 1e-4 for c in vectors[1]]] * 3
    # a third of the rows is one vector, and rows of all names that the results have
    df = spark.createDataFrame(
        [(i, v, "mine", "x", i) for i, v in enumerate(vectors)],
        "vec_id long, embedding array<double>, n string, x string, many int")
    got = ew.whitened(df, components=6, weights=weights)
    assert got.columns == ["vec_id", "embedding", "x", "many", *ew.RESULTS]
    rows = got.collect()
    check_whitened(rows, range(len(vectors)), vectors, 4, weights == "count")
    assert all(r["x"] == "x" and r["many"] == r["vec_id"] for r in rows)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [None, 1.0], [nan, 1.0], [1.0, inf], [-inf, 0.0], [3e38, 1.0]]
    good = [[0.0, 0.5], [1.0, 0.25], [0.5, -1.0], [-0.75, -0.25], [0.0, 0.5]]
    other = [[1.0, 2.0, 3.0], [2.0, 1.0, 3.5], [0.0, 0.0, 1.0], [1.0, 1.0, 1.0], [2.0, 2.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(odd + good + other)] + [(None, good[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ew.whitened(df).collect()
    two = [r for r in got if len(r["embedding"]) == 2 and r["vec_id"] is not None]
    check_whitened(two, range(7, 12), good, 2)
    check_whitened([r for r in got if len(r["embedding"]) == 3], range(12, 17), other, 3)
    assert len([r for r in got if r["vec_id"] is None]) == 2
    assert ew.whitened(df.limit(0)).collect() == []
    assert ew.whitened(df.filter("vec_id in (7, 11)")).collect() == []  # one distinct vector has no spread
    with pytest.raises(ValueError, match="weights"):
        ew.whitened(df, weights="some")


def test_exact_numbers_beyond_64_bits():
    x = np.array([[1 << 46, 5], [-(1 << 46), 7]])
    sums = [0, 12 * 10**9]
    apart = ew.deviations(x, 10**9, sums)
    assert apart.tolist() == [[(1 << 46) * 10**9, -7 * 10**9], [-(1 << 46) * 10**9, -5 * 10**9]]
    assert ew.squares(apart) == [sum(v * v for v in row) for row in apart.tolist()]
    assert ew.squares(np.array([[1 << 40, 1]])) == [(1 << 80) + 1]


# ---- URL filters

def ranks(edges, seeds, hosts, rounds=400):
    """A personalised PageRank by plain iteration; edges: {(a, b): weight}."""
    total = sum(seeds.get(h, 0) for h in hosts)
    start = {h: seeds.get(h, 0) / total if total else 0.0 for h in hosts}
    score = dict(start)
    out = Counter()
    for (a, _), w in edges.items():
        out[a] += w
    for _ in range(rounds):
        taken = Counter()
        for (a, b), w in edges.items():
            taken[b] += score[a] * w / out[a]
        lost = 1 - 0.85 * sum(taken.values())
        score = {h: 0.85 * taken[h] + (lost * start[h] if total else 0.0) for h in hosts}
    return score


def link_pages():
    """good.example links to near.example; poor.example and worse.example lead to bad.net."""
    def page(*urls):
        return "<body>" + "".join(f'<p><A class="x" href="{u}">y</a></p>' for u in urls) + "</body>"

    return [
        ("http://Good.org/fr/1", page("https://near.example/a", "//near.example/b", "/fr/2", "mailto:x@bad.net")),
        ("http://good.org/fr/2", page("https://near.example/a?b")),
        ("http://near.example/1", page("http://Near.example/2", "http://bad.net/x")),
        ("http://bad.net/x", page("https://far.example/")),
        ("http://poor.example/1", page("http://worse.example/")),
        ("http://worse.example/", page("http://bad.net/", "http://bad.net/2", "http://worse.example/3")),
        ("http://quiet.example/", "<p>bad.net <b href='http://bad.net'>x</b> <a data-href='http://bad.net'>z</a></p>"),
    ]


def test_links_of_pages(spark):
    pages = spark.createDataFrame(link_pages(), "url string, html string")
    got = {(r["src"], r["dst"]): r["links"] for r in uf.host_links(pages).collect()}
    assert got == {
        ("good.org", "near.example"): 3, ("near.example", "bad.net"): 1, ("bad.net", "far.example"): 1,
        ("poor.example", "worse.example"): 1, ("worse.example", "bad.net"): 2,
    }


@pytest.mark.parametrize("piece", [100, 1])
def test_scores_against_plain_iteration(spark, piece):
    rng = np.random.default_rng(2)
    hosts = [f"h{i}" for i in range(25)]
    edges = {}
    for _ in range(60):
        a, b = rng.integers(0, 20, 2)
        if a != b:
            edges[f"h{a}", f"h{b}"] = int(rng.integers(1, 5))
    edges |= {("h0", f"h{i}"): 1 for i in range(1, 20)}
    links = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, links long")
    good, bad = {"h1": 1, "h22": 1}, {"h3": 1, "h4": 1, "h23": 1}
    seeds = spark.createDataFrame([(h, good.get(h, 0), bad.get(h, 0)) for h in hosts], "host string, trusted int, blocked int")
    got = {r["host"]: r for r in uf.propagated(links, seeds, piece=piece, tolerance=1e-7, max_rounds=200).collect()}
    trust = ranks(edges, good, hosts)
    distrust = ranks({(b, a): w for (a, b), w in edges.items()}, bad, hosts)
    for h in hosts:
        assert got[h]["trust"] == pytest.approx(trust[h], abs=1e-5)
        assert got[h]["distrust"] == pytest.approx(distrust[h], abs=1e-5)


def test_verdicts_follow_links(spark):
    pages = spark.createDataFrame(link_pages(), "url string, html string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in uf.judged(pages, URL_RULES).collect()}
    assert got == {
        "http://Good.org/fr/1": ("org/fr/", "allow"), "http://good.org/fr/2": ("org/fr/", "allow"),
        "http://near.example/1": (None, "allow"),  # its trust outweighs one link to a blocked host
        "http://bad.net/x": ("net/", "block"), "http://poor.example/1": (None, "block"),
        "http://worse.example/": (None, "block"), "http://quiet.example/": (None, "allow"),
    }


def plain_judgement(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(UPPER)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, rule


def test_rules_on_a_whole_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op13_url_filters"](spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path, rule = plain_judgement(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert host == urlsplit(pages[r["page_id"]]).netloc
        assert r["verdict"] == (rule.verdict if rule else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_odd_urls(spark):
    urls = [
        None, "", "no url", "http://", "http:///x", "x://A.NET", "x://A.NET/", "http://net/x", "http://notnet/x",
        "http://a.example.net/en/", "http://a.example.net/EN/", "http://example.net?x=://b.org/fr/", "http://x.org/fr/\n#a",
        "http://ÀB.org/fr", "a://b.example.com/de/x?y#z", "a://b.example.com/de", "://c.net/", "http://a b.net/ x",
        "http://a.net://b", "x" * 50_000 + "://q.net/" + "y" * 50_000, "http://p.net#/x", "http://p.net/x", "http://p.net/x",
    ]
    rows = [(i, u, None, "mine", "theirs", 1) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, own string, Host string, many int")
    got = uf.judged(df, URL_RULES)
    assert got.columns == ["page_id", "url", "html", "own", "many", *uf.RESULTS]
    by = {r["page_id"]: r for r in got.collect()}
    assert len(by) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = plain_judgement(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule and rule.text), u
        assert by[i]["own"] == "mine" and by[i]["many"] == 1
    assert by[0]["verdict"] == "allow" and by[0]["host"] == "" == by[0]["path"]
    assert uf.judged(df.limit(0), URL_RULES).collect() == []
    assert {r["verdict"] for r in uf.judged(df, []).select(F.col("verdict")).collect()} == {"allow"}
