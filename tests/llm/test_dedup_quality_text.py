"""Operators 1, 2, 3, 5, 6, 8 and 9 against brute force on small tables."""

import datetime as dt
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import licenses, minhash, outliers, pii, rules, stats, templates, urls
from colonnade.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 1 ------------------------------------------------------------------------------------------------


def shingle_set(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute_components(docs, percent=85):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(least[find(i)]), d == min(least[find(i)])) for i, (d, _) in enumerate(docs))


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"w{k}" for k in range(4000)])
    docs = []
    for _ in range(12):
        base = rng.choice(vocab, int(rng.integers(60, 300)))
        docs.append(base)
        for _ in range(int(rng.integers(0, 9))):
            own = base.copy()
            at = rng.choice(len(own), int(rng.integers(0, 1 + len(own) // 30)), replace=False)
            own[at] = rng.choice(vocab, len(at))
            docs.append(own[: len(own) - int(rng.integers(0, 8))])
            if rng.random() < 0.3:
                base = own  # chains: the ends need not be alike
    texts = [" ".join(d) for d in docs] + [None, "", " \n", "one two", "One  two", "three", "long " * 30_000, "nbsp\u00a0stays one", "É é", "é É"]
    order = rng.permutation(len(texts))
    return [(int(k), texts[i].upper() if k % 7 == 0 and texts[i] else texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("limits", [{}, {"bucket_nodes": 3, "cluster_shingles": 700}])
def test_near_duplicates(spark, limits):
    docs = near_copies()
    df = spark.createDataFrame([(*d, "node", 1) for d in docs], "doc_id long, text string, node string, n_shingles int").repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(df, **limits).collect()))
    assert got == brute_components(docs)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "x y"), (None, "x y"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    base = [f"w{k}" for k in range(100)]
    alike = spark.createDataFrame([(None, " ".join(base)), (None, " ".join(base[1:])), (7, " ".join(base[2:])), (8, "other words that stand alone here")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(alike).collect()), key=str) == [(7, 7, True), (8, 8, True), (None, 7, False), (None, 7, False)]


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    schema = "doc_id long, text string, node string, own_id int"
    df = spark.createDataFrame([(1, "a b c", "x", 1), (1, "a b c", "x", 2), (1, "other text", "x", 3), (2, "A b c", "x", 4), (None, "x y", "x", 5), (None, "x y", "x", 6), (3, None, "x", 7), (3, None, "x", 8), (4, "", None, 9)], schema)
    got = minhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r["text"] or "") for r in got.collect()) == ["", "", "", "a b c", "other text", "x y"]
    plain = df.where("own_id in (1, 4, 7, 9)")
    assert sorted(r["own_id"] for r in minhash.deduplicate(plain).collect()) == [1, 7, 9]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_estimates_are_corrected_for_collisions(bits):
    rng = np.random.default_rng(1)
    a, b = minhash._permutations(960)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for both in (0, 1500, 2700):
        y = np.concatenate([x[:both], rng.integers(0, 2**63, 3000 - both).astype(np.uint64)])
        one, two = (minhash.unpacked([minhash.signature(minhash.minima(np.sort(s), a, b), bits)], bits) for s in (x, y))
        assert abs(minhash.estimates(one[0], two, 960)[0] - both / (6000 - both)) < 0.12


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r[0]: r[1] for r in got} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


# 2 ------------------------------------------------------------------------------------------------


def brute_counts(text):
    ws = WORD.findall(text)
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c d e a b c d e f", "x\n\nx\n x\nx ", "é ñ#\u00a0* 日本 |\r\n<>&%$", "q " * 50, "a b c d e " * 3 + "z", "one two three four five six"])
def test_counts(text):
    assert stats.counts(text.encode())[:5] == brute_counts(text)


def brute_mcd(x, steps=5):
    """One group by the same definition, in numpy over all rows at once."""
    q = np.sign(x * outliers.PER_UNIT) * np.floor(np.abs(x * outliers.PER_UNIT) + 0.5) / outliers.PER_UNIT
    med = np.array([np.sort(c)[math.ceil(len(c) / 2) - 1] for c in q.T])
    mad = np.array([1.4826 * np.sort(np.abs(c - m))[math.ceil(len(c) / 2) - 1] for c, m in zip(q.T, med)])
    scale = np.maximum(mad, outliers.FLOORS)
    z = (x - med) / scale
    u = z / np.sqrt((z**2).sum(1) + 1e-12)[:, None]
    signs = u.T @ u / len(u)
    spread = np.sqrt(np.diag(signs) + 1e-6)
    corr = signs / np.outer(spread, spread)
    np.fill_diagonal(corr, 1)
    best = None
    for cov in (np.diag(scale**2), 0.95 * corr * np.outer(scale, scale) + 0.05 * np.diag(scale**2)):
        m = med
        for k in range(steps + 1):
            cov = cov + np.diag(np.maximum(0, outliers.FLOORS**2 - np.diag(cov)))
            if k == steps:
                break
            d = np.maximum(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m), 0)
            bucket = np.floor(np.log(d + 1e-9) * outliers.PER_UNIT / 4)
            values, n = np.unique(bucket, return_counts=True)
            near = x[bucket <= values[np.searchsorted(np.cumsum(n), outliers.H_SHARE * len(x))]]
            m, cov = near.mean(0), outliers._consistency(len(near) / len(x), outliers.P) * np.cov(near.T, bias=True)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, m, cov
    _, m, cov = best
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    near = x[d <= outliers.chi2_quantile(0.975, outliers.P)]
    m, cov = near.mean(0), outliers._consistency(0.975, outliers.P) * np.cov(near.T, bias=True)
    cov = cov + np.diag(np.maximum(0, outliers.FLOORS**2 - np.diag(cov)))
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m), 0))


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))).capitalize() if rng.random() < 0.1 else "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(n))


def test_outliers_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = [(i, prose(rng, int(rng.integers(20, 200))) if i % 20 != 7 else "### $$$ !! " * int(rng.integers(2, 5)) + prose(rng, 30).replace(" ", "*** "), "en" if i % 3 else None, "hot" if i % 4 else f"s{i % 2}") for i in range(500)] + [(900, None, "en", "hot"), (901, "short one", "fr", "x"), (902, "a b c d e " * 9, "en", "hot")]
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), least=60).collect()}
    assert len(got) == len(docs)
    groups = {}
    for d, t, lang, source in docs:
        c = dict(zip(stats.COUNTS, stats.counts((t or "").encode())))
        assert tuple(got[d])[1:6] == brute_counts(t or "")
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        assert got[d]["base_failed"] == failed and (not failed or not got[d]["kept"])
        if not failed:
            x = [eval(e.replace("ln(", "math.log("), {"math": math}, c) for e, _ in outliers.FEATURES.values()]
            groups.setdefault((lang, source), []).append((d, x))
    pooled = {}
    for (lang, source), own in list(groups.items()):
        if len(own) < 60:
            pooled.setdefault(lang, []).extend(groups.pop((lang, source)))
    rest = []
    for lang, own in pooled.items():
        rest.extend(own) if len(own) < 60 else groups.__setitem__((lang,), own)
    for own in groups.values():
        distance = brute_mcd(np.array([x for _, x in own], float))
        for (d, _), want in zip(own, distance):
            assert got[d]["distance"] == pytest.approx(want, rel=1e-6, abs=1e-6)
            assert got[d]["kept"] == (want <= math.sqrt(outliers.chi2_quantile(0.9999, outliers.P)))
    for d, _ in rest:
        assert got[d]["distance"] is None and got[d]["kept"] or len(rest) >= 60
    assert not any(got[i]["kept"] for i in range(7, 500, 20))
    assert sum(got[i]["kept"] for i in range(500) if i % 20 != 7) > 465


def test_outliers_of_an_empty_table(spark):
    assert outliers.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_chi2():
    assert outliers.chi2_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)
    assert outliers.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-6)


# 3 ------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">x</a></li></ul></nav><div class="cookie-notice">Cookies!</div><!-- <p>no</p> -->
<article><h1>A &amp; B</h1><p><b>One&nbsp; two<br>three<p>Four &#233; <i>fi</i>ve</p><div class="ad">Buy</div><ul><li>x<li>y</ul><form>f</form>
<table><tr><td>c1<td>c2<tr><td>d</table><p>%s</p><div class="promo-x">kept out</div></article><aside>Side</aside><section id="comments"><article class="comment">No</article></section><footer>F</footer></body></html>"""


def test_extraction():
    want = "A & B\n\nOne two three\n\nFour é five\n\nx\n\ny\n\nc1 c2\n\nd\n\nown"
    assert templates.extract(PAGE % "own").replace("\n\nkept out", "") == want
    assert templates.extract(None) == templates.extract("") == ""
    assert templates.extract("<p>only &am") == "only &am"
    assert templates.extract("<body><p>a</p><nav>n</nav>b<script>x") == "a\n\nb"
    assert templates.extract("<article>cut in a <di") == "cut in a"
    assert templates.extract('<div class="layout with-sidebar"><div class="sidebar">s</div><article>own</article></div>') == "own"
    assert templates.extract('<article>own</article><div class="comments"><article>theirs</article></div>') == "own"
    assert templates.extract("<p>" * 20_000 + "deep" + "<div>" * 20_000) == "deep"


@pytest.mark.parametrize("broadcast_rows", [10, -1])
def test_site_templates(spark, broadcast_rows):
    page = lambda host, k: f"<body><div><p>Welcome to {host}</p><p>Own text {host} {k}</p></div><p>Same end</p></body>"
    rows = [(i, f"http://{h}.org/{i}", page(h, i)) for i, h in enumerate(["a"] * 12 + ["b"] * 3)]
    rows += [(100 + i, f"http://c.org/{i}", "<article><p>One page, many times</p></article>") for i in range(20)]
    rows += [(200, None, page("n", 1)), (201, "http://a.org/x", None), (None, "no url", "<p>t</p>")]
    got = {r["page_id"]: r for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), broadcast_rows=broadcast_rows).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i]["text"] == f"Own text a {i}"
    assert got[13]["text"] == "Welcome to b\n\nOwn text b 13\n\nSame end"
    assert all(got[100 + i]["text"] == "One page, many times" for i in range(20))
    assert got[201]["text"] == "" and got[201]["n_chars"] == 0 and got[None]["text"] == "t"


def test_templates_of_an_empty_table(spark):
    assert templates.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 5 ------------------------------------------------------------------------------------------------

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@pytest.mark.parametrize(
    "url, want",
    [
        (None, ("", "", None, "allow")),
        ("casino.example.net/x", ("", "", None, "block")),
        ("http://WWW.Example.ORG/es/casino", ("www.example.org", "/es/casino", "example.org/es/", "block")),
        ("https://example.org/en/12?q", ("example.org", "/en/12", "example.org/en/1", "block")),
        ("https://example.org/casino", ("example.org", "/casino", "org/", "allow")),
        ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("https://x.com/fr/porn", ("x.com", "/fr/porn", "com/fr/", "allow")),
        ("https://x.com/de/#a", ("x.com", "/de/", "com/de/", "block")),
        ("https://x.org", ("x.org", "", None, "allow")),
        ("http://free-bets.net/", ("free-bets.net", "/", None, "block")),
        ("http://freebets.net/free/free", ("freebets.net", "/free/free", None, "allow")),
        ("http://essex.net/sexton", ("essex.net", "/sexton", None, "allow")),
        ("a://b://c.com/de/", ("b:", "//c.com/de/", None, "allow")),
    ],
)
def test_urls(url, want):
    judge = urls.UrlFilter(RULES)
    host, path = urls.split_url(url)
    rule, verdict = judge.rule(host, path)
    hard, soft = judge.hits(url or "")
    assert (host, path, rule, verdict or ("block" if hard or len(soft) > 1 else "allow")) == want


def test_url_table(spark):
    df = spark.createDataFrame([(1, "http://casino.net/", "x"), (1, "http://casino.net/", "y"), (None, None, "z")], "page_id long, url string, host string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in urls.judge(df, RULES).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urls.judge(df.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def brute_licenses(text):
    known = dict(licenses.catalogue(licenses.SENTENCES))
    ids = []
    cut = re.sub(r"\n[\t\x0b\f\r ]*\n", "\x01", text or "")
    for s in re.sub(r"([.!?;:])[\t\n\x0b\f\r ]+", "\\1\x01", cut).split("\x01"):
        own = known.get(licenses.normalize(s))
        ids += [own] if own else [known[licenses.normalize(x)] for x in s.split("\n") if "\n" in s and licenses.normalize(x) in known]
    left, names = [f",{i}," for i in ids], []
    seq = "".join(left)
    for name, keys in licenses.RULES:
        key = "".join(f",{k}," for k in keys)
        if key in seq:
            seq = seq.replace(key, "|")
            names.append(name)
    return ids, list(dict.fromkeys(names)), seq.count(",") // 2


def test_licenses(spark):
    S = licenses.SENTENCES
    join = lambda *keys: "\n".join(S[k] for k in keys)
    texts = [None, "", "nothing", S["mit-short"], f"title without a stop\n{S['apache-short']}\nAll   rights\nreserved.", join("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), join("bsd-grant", "bsd-source", "bsd-binary"), join("bsd-source", "bsd-grant", "bsd-binary"), join("mit-grant", "mit-notice", "mit-warranty").upper().replace(" of ", "\n of\t"), join("gpl2-free", "gpl2-published", "gpl2-version", "reserved", "reserved"), "a\n \nb " + S["cc-by-nc"] + " more. " + S["cc0"], "word. " * 20_000 + S["gpl3-short"], "Software: all rights reserved? No."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["n_unmatched"]) for r in licenses.scan(df).collect()}
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert got[5][1] == ["BSD-3-Clause"] and got[6][1] == ["BSD-2-Clause"] and got[7][1] == [] and got[8][1] == ["MIT"]
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# 8 ------------------------------------------------------------------------------------------------


def test_rules_learn_and_compile(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = prose(rng, int(rng.integers(5, 120)))
        docs.append((i, (text.upper().replace(" ", "!! ") if i % 12 else text.replace(" ", "### ")) if bad else text, "x"))
        labels.append((i, int(not bad)))
    docs += [(1000, None, None), (1001, "", None), (1001, "", None)]
    labels += [(5000, 1), (None, 1), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, log_words string").repartition(4)
    model = rules.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 1 < len(model.rules) < 120
    got = rules.score(df, model).collect()
    assert len(got) == len(docs)
    told = dict(labels)
    texts = {d: t for d, t, _ in docs}
    hit = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        c = {k: np.array([float(v)]) for k, v in zip(stats.COUNTS, stats.counts((texts[r["doc_id"]] or "").encode()))}
        assert r["score"] == pytest.approx(float(model.score(np.array([[f(c)[0] for f in rules.FEATURES.values()]]))[0]), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in told:
            hit.append(r["predicted"] == told[r["doc_id"]])
    assert len(hit) > 80 and np.mean(hit) > 0.97
    kept = rules.keep(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_rules_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = rules.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules.score(df, model).first()["score"] == pytest.approx(0.5)
    assert rules.score(df.limit(0), model).count() == 0


# 9 ------------------------------------------------------------------------------------------------

KEY = "k'ey"


def prf(kind, n, r, i, told):
    return int(hashlib.sha256(f"{pii.derived(KEY)}|{kind}|{n}|{r}|{i}|{told}".encode()).hexdigest()[:12], 16)


def feistel(values, radices, kind):
    n, v = len(values), list(values)
    for r in range(pii.ROUNDS):
        told = ",".join(map(str, v[n // 2 :] if r % 2 == 0 else v[: n // 2]))
        v = [(x + prf(kind, n, r, i, told)) % radices[i] if (i < n // 2) == (r % 2 == 0) else x for i, x in enumerate(v)]
    return v


def characters(s, kind, hexadecimal=False):
    def alphabet(c):
        for a in ([pii._HEX] if hexadecimal else []) + [pii._DIGITS, pii._LOWERS, pii._UPPERS]:
            if c in a:
                return a
        return c

    al = [alphabet(c) for c in s]
    return "".join(a[v] for a, v in zip(al, feistel([a.index(c) for a, c in zip(al, s)], [len(a) for a in al], kind)))


def luhn(d, odd):
    return sum((x * 2 - 9 * (x > 4)) if i % 2 == odd else x for i, x in enumerate(map(int, reversed(d))))


def brute_pseudonym(kind, v):
    if kind == "card":
        d = re.sub("[ -]", "", v)
        p = characters(d[:-1], "card")
        full = iter(p + str(-luhn(p, 0) % 10))
        return "".join(c if c in " -" else next(full) for c in v)
    if kind == "ip":
        return ".".join(map(str, feistel([int(x) for x in v.split(".")], [256] * 4, "ip")))
    if kind == "email":
        a, b = v.split("@")
        return characters(a, "email") + "@" + b
    if kind == "date":
        n = (dt.date.fromisoformat(v) - dt.date(1900, 1, 1)).days
        a, b = feistel([n // 229, n % 229], [319, 229], "date")
        return (dt.date(1900, 1, 1) + dt.timedelta(a * 229 + b)).isoformat()
    if kind == "phone":
        made = iter(characters("".join(c for c in v[2:] if c.isdigit()), "phone"))
        return v[:2] + "".join(next(made) if c.isdigit() else c for c in v[2:])
    if kind == "secret":
        return characters(v, "secret", re.fullmatch("[0-9a-f]*", v) is not None)
    return characters(v, kind)


CASES = [("card", "4465758382889437"), ("card", "4465 7583 8288 9437"), ("ip", "8.196.197.208"), ("email", "thwhhe.68@mail2.example.com"), ("date", "1984-02-29"), ("phone", "+1 (663) 555-6869"), ("ssn", "123-45-6789")]


def test_pseudonyms_equal_brute_force(spark):
    rows = [(i, f"é {v}, {v} ñ{v}.", "x") for i, (_, v) in enumerate(CASES)] + [(50, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"# password=e3b3ed3cc8548923d6', None)]
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, v string"), KEY).collect()}
    for i, (kind, v) in enumerate(CASES):
        p = brute_pseudonym(kind, v)
        assert p != v and got[i]["text"] == f"é {p}, {p} ñ{p}.", kind
    assert got[50]["text"] == f'token = "{brute_pseudonym("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6")}"# password={brute_pseudonym("secret", "e3b3ed3cc8548923d6")}'
    assert luhn(re.search("[0-9]{16}", got[0]["text"])[0], 1) % 10 == 0


def test_neighbouring_numbers_stay_apart(spark):
    card, phone = "4465758382889437", "+1 (569) 555-6633"
    texts = [f"12 {card}", f"{card} 99", f"{card} {card}", f"{phone} 99", f"{phone} {card}", f"8.8.8.8 {card}", f"x,{card},y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [t.replace(card, brute_pseudonym("card", card)).replace(phone, brute_pseudonym("phone", phone)).replace("8.8.8.8", brute_pseudonym("ip", "8.8.8.8")) for t in texts]
    assert [r["text"] for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()] == want


def test_what_is_not_private_stays(spark):
    texts = [None, "", "4465758382889438", "999.1.1.1", "1.2.3.4.5", "1984-02-30", "version 4.0.1 of 12", "a4465758382889437", "000-12-3456", "GB82 WEST", "x@y", "12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()] == texts
    assert pii.pseudonymize(df.limit(0), KEY).count() == 0


def test_pseudonyms_are_permutations(spark):
    dates = [(i, (dt.date(1900, 1, 1) + dt.timedelta(i * 61)).isoformat()) for i in range(1190)]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(dates, "i int, text string"), KEY).collect()]
    assert len(set(got)) == len(dates) and all("1900-01-01" <= x <= "2099-12-31" for x in got)
    iban = pii.pseudonymize(spark.createDataFrame([("DE89370400440532013000",)], "text string"), "k'ey").first()[0]
    assert iban.startswith("DE") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    spaced = pii.pseudonymize(spark.createDataFrame([("to DE89 3704 0044 0532 0130 00 now",)], "text string"), KEY).first()[0]
    assert spaced == f"to {' '.join(iban[k : k + 4] for k in range(0, 22, 4))} now"


def test_pseudonyms_are_native_and_long_texts_whole(spark):
    df = spark.createDataFrame([("word " * 60_000 + "8.196.197.208 " * 50,)], "text string")
    out = pii.pseudonymize(df, KEY)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert out.select(F.length(F.regexp_replace("text", r"[0-9.]", "")).alias("n")).first()[0] == 300_000 + 50
    assert "8.196.197.208" not in out.first()[0]
