"""Filter audit, periodic runs and URL trust against brute force, and on awkward rows."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import filter_audit, periodic_runs, url_trust

SCHEMA = ("doc_id long, text string, lang string, source string, words string, digest int, cell int, runs string, "
          "Collapsed string, p int")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", "w", 1, 2, "r", "c", 3) for i, t, g in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a\x0bb\x0c\r\nc", "Ünïcode ſ K ÄÖ", "x" * 50_000, "ONE TWO", "price $5 & more"]
    texts += [" ".join(rng.choice(["a", "B", "cc", "DD", "e#", "f%"][:rng.randint(1, 6)]) for _ in range(rng.choice([3, 190, 200, 260])))
              for _ in range(25)]
    texts += [" ".join(f"w{i}" for i in range(250))] * 3 + [texts[12]] * 4
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, texts[9], "en"), (None, "only here", None), (0, "other text, same id", "de")]


# ---------------------------------------------------------------- op11

def audit_by_hand(rows, labels):
    """Walks every order over every document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, g in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > first[t]}
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((g or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                failing = [d for d in docs if d[0] == part and d[1][f]]
                left = [d for d in left if not d[1][f]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone),
                                           sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_walks_every_order(spark):
    rows = odd_rows()
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(30), *range(5), None, 999]]
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, id string")
    got = filter_audit.audit(make(spark, rows), table).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == audit_by_hand(rows, labels)
    assert len(got) == 3 * 600 and filter_audit.audit(make(spark, []), table).count() == 0
    assert sum(r.good_lost for r in filter_audit.audit(make(spark, rows), table.limit(0)).collect()) == 0


# ---------------------------------------------------------------- op12

def runs_by_hand(w):
    """Every lag, every stretch; the smallest period by trying all."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive_texts(n=160):
    rng = random.Random(7)
    out = [None, "", " ", "a a a a a", "a a a a a a", " a b a b a b a b ", "x " * 3000]
    for _ in range(n):
        words = []
        while len(words) < rng.choice([5, 60, 700]):
            period = [rng.choice("abcdefgh"[:rng.choice([1, 2, 8])]) + str(rng.choice([0, 0, rng.randrange(99)]))
                      for _ in range(rng.choice([1, 2, 3, 5, 16, 17, 32, 33, 40, 64, 65, 90]))]
            words += period * rng.choice([1, 1, 3, 4, 5, 9]) + period[:rng.randrange(len(period))]
            if rng.random() < .3:
                words[rng.randrange(len(words))] = "odd"
        out.append(rng.choice([" ", "  ", "\n", "\t\x0b"]).join(words))
    return out


def test_runs_against_all_lags():
    texts = repetitive_texts()
    found, cut = periodic_runs.find(pa.array(texts))
    seen = set()
    for t, r, c in zip(texts, found.to_pylist(), cut.to_pylist()):
        w = WORD.findall(t or "")
        want = runs_by_hand(w)
        assert [(x["start"], x["length"], x["period"]) for x in r] == want and c == collapse_by_hand(w, want)
        seen |= {q for _, _, q in want}
    assert {1, 2, 5, 16, 17, 32, 33, 40, 64, 65, 90} <= seen


def test_long_periods_against_the_planted_one():
    rng = random.Random(3)
    for q, times in ((1000, 4), (2047, 5), (2048, 4), (2049, 4), (12_345, 6)):
        block = [str(rng.randrange(50)) for _ in range(q)]
        text = " ".join(["head"] * 3 + block * times + block[:q // 3] + ["tail"])
        runs = [tuple(x.values()) for x in periodic_runs.find(pa.array([text, None, "a b"]))[0].to_pylist()[0]]
        start, length, period = max(runs, key=lambda r: r[1])
        assert period == q and q * times + q // 3 <= length and start <= 3


def test_query_plants_and_digests(spark):
    rows = [(i, t, "en") for i, t in enumerate(repetitive_texts(60))] + [(None, "a a a a a a", None), (5, "b " * 9, "x")]
    planted = 0
    for r in periodic_runs.op12(spark, make(spark, rows)).collect():
        options = []
        for t in [t for i, t, _ in rows if i == r.doc_id]:
            w = WORD.findall(t or "")
            h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
            if h % 10 == 0 and w:
                g = h // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
                planted += 1
            runs = runs_by_hand(w)
            best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            options.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
                            hashlib.sha256(collapse_by_hand(w, runs).encode()).hexdigest()))
        assert tuple(r)[1:] in options
    assert planted > 3
    kept = periodic_runs.runs(make(spark, rows[:9]))
    assert set(kept.columns) == {c for c in make(spark, []).columns if c != "Collapsed"} | {"collapsed"} and kept.count() == 9
    assert periodic_runs.op12(spark, make(spark, [])).count() == 0


# ---------------------------------------------------------------- op13

def page(*links):
    return "<html>" + "".join(f'<a class=x href="{u}">t</a>' for u in links) + "</html>"


PAGES = [
    ("https://a.net/x", page("http://TRUST.org/1", "https://b.net/")), ("https://b.net/y", page("//spam.com/q", "/local", "z.html")),
    ("http://trust.org/", page("https://a.net/x?y", "https://c.net")), ("http://c.net?q=/es/", page()), ("https://spam.com/de/1", page()),
    ("https://spam.com/en/1", page("https://d.net:80/")), ("https://d.net:80/", page("http://spam.com", "http://spam.com/2", "http://a.net")),
    ("https://Example.ORG/es/1", None), ("https://www.example.org/en/12#x", ""), ("https://badexample.org/es/", page()), ("x://org", page()),
    ("x://org?/", page()), ("x.org/", page()), (None, page("http://a.net")), ("", None), ("http:///path?x", page("http://spam.com")),
    ("https://mix.com/fr/1", page()), ("https://mix.com/de/1", page()), ("https://mix.com/de/2", page()), ("https://mix.com/en/2", page()),
    ("https://far.net/", "<a\nHREF = 'http://b.net'>" + "<p>long</p>" * 30_000 + "<abbr href=http://no.net><a title=\"\" href=https://mix.com#f>"),
    ("ÄÉ://ÄX.net://y/Z?", page("http://b.net")), ("https://b.net/y", page("//spam.com/q", "/local", "z.html")),
]


def judged_by_hand(pages, rules=url_trust.RULES, follow=url_trust.FOLLOW, rounds=url_trust.ROUNDS):
    rows, edges = [], Counter()
    low = str.maketrans(url_trust.UPPER, url_trust.LOWER)
    for url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(low)
        fits = [(n + p, v) for v, n, p in rules if (host == n or host.endswith("." + n)) and path.startswith(p)]
        rows.append((host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))))
        tags = re.findall(r"<a\s[^<>]*", html or "", re.I)
        links = {m[1].translate(low) for t in tags if (m := re.search(r"\shref\s*=\s*[\"']?(?:https?:)?//([^/?#\"'<>\s]+)", t, re.I))}
        edges.update((host, x) for x in links if host and x != host)
    hosts = sorted({r[0] for r in rows} | {x for e in edges for x in e})
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts),) * 2)
    for (a, b), n in edges.items():
        m[at[a], at[b]] = n
    score = []
    for flow, v in ((m, "allow"), (m.T, "block")):
        left = np.array([np.mean([r[3] == v for r in rows if r[0] == h] or [0]) if h else 0 for h in hosts])
        flow = flow / np.maximum(flow.sum(1, keepdims=True), 1)
        total = np.zeros(len(hosts))
        for _ in range(rounds + 1):
            total += (1 - follow) * left
            left = follow * flow.T @ left
        score.append(total)
    return [(h, p, r, v or ("block" if score[1][at[h]] > score[0][at[h]] else "allow")) for h, p, r, v in rows]


def test_urls_against_matrix_products(spark):
    schema = "page_id long, url string, html string, HOST string, found int, kind string, verdict int, blocked_host int"
    df = spark.createDataFrame([(i, u, h, "h", 1, "k", 2, 3) for i, (u, h) in enumerate(PAGES)], schema).repartition(3)
    want = judged_by_hand(PAGES)
    got = sorted(url_trust.op13(spark, df).collect())
    assert [tuple(r)[1:] for r in got] == want and len(got) == len(PAGES)
    verdict = {u: v for (u, _), (*_, v) in zip(PAGES, want)}
    # links to a blocked host taint, links from a trusted one clear
    assert verdict["https://spam.com/en/1"] == verdict["https://b.net/y"] == verdict["https://mix.com/en/2"] == "block"
    assert verdict["http://c.net?q=/es/"] == verdict["https://a.net/x"] == verdict["x.org/"] == "allow"
    assert verdict["https://far.net/"] == "block" and verdict["https://badexample.org/es/"] == "allow"
    kept = url_trust.judge(df)
    assert set(kept.columns) == {"page_id", "url", "html", "found", "kind", "blocked_host", "host", "path", "rule", "verdict"}
    assert url_trust.op13(spark, df.limit(0)).count() == 0
    no_links = [(u, None) for u, _ in PAGES]
    got = sorted(url_trust.op13(spark, spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(no_links)],
                                                             "page_id long, url string, html string")).collect())
    assert [tuple(r)[1:] for r in got] == judged_by_hand(no_links)


@pytest.mark.parametrize("rules", [(), (("block", "a.b", ""), ("allow", "b", "/x"))])
def test_rules_choose_the_longest(spark, rules):
    urls = ["http://a.b/xyz", "http://c.b/x", "http://b", "http://z.a.b?", "ftp://ab/x"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = url_trust.judge(df, rules).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == judged_by_hand([(u, None) for u in urls], rules)
