"""Each operator against brute force on small tables with nulls, empty and very
long texts, ties, repeated rows, extra columns, and no rows at all."""
import hashlib
import html
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import corpus_pipeline as P
from oracle import compare, connect
from proofmill.llm import bpe, groups, kdtree, links, mainline, mixing, probminhash, quality, secrets, suffixes, templates
from proofmill.llm.queries import CORPUS_ORACLES, CORPUS_QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` int, `size` int, version string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    """Columns of documents, and some whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "v") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(12)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[0], "s0") for i in range(4)]                       # exact copies
    words = base[1].split()
    out += [(200 + i, " ".join(words[:5 * i + 20] + ["new"] + words[5 * i + 21:]), None) for i in range(3)]
    out += [(300, None, "s1"), (301, "", "s1"), (302, " \n\t", None), (303, "one", "s2"), (7, base[7], "s1"), (None, base[3], "s2")]
    out += [(400, prose(rng, 9000), "s0"), (401, "x" * 70000, "s0"), (402, base[2] + "\n" + base[2], "é")]
    return out


@pytest.mark.parametrize("name", sorted(CORPUS_ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, CORPUS_QUERIES[name], CORPUS_ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(CORPUS_QUERIES))
def test_runs_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert CORPUS_QUERIES[name](spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows_and_none(spark, rows, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents(spark, rows), documents(spark, rows).limit(0)):
        for _, stage in P.STAGES[:-1]:
            odd = docs
            for c in ("kept", "shard", "n_lines", "n_dropped", "places", "part", "copies", "_row", "_mix", "probability"):
                odd = odd.withColumn(c, F.lit(7))
            out = stage(spark, odd, str(tmp_path))
            assert out.columns == odd.columns
            assert all(r[c] == 7 for r in out.collect() for c in ("kept", "shard", "n_lines", "places", "_mix"))
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_search_is_exact(spark):
    rng = np.random.default_rng(5)
    points = rng.integers(-3, 4, (400, 4)) / 256
    data = [(i, [float(x) for x in p], 1) for i, p in enumerate(points)]
    data += [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan")] * 4, 1), (904, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (5, data[5][1], 1), (950, [9.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=60, block_queries=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * points).astype(int)
    for q in range(0, 400, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(400) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 400, 50))


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 3))
    tree = kdtree.build(np.arange(500), points, leaf=16)
    for a, b, lo, hi in zip(tree.start, tree.end, tree.low, tree.high):
        assert (tree.points[a:b].min(0) == lo).all() and (tree.points[a:b].max(0) == hi).all()


def covered(rows, keep_first):
    counts, first, out = Counter(), {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t, _ in order:
        b = (t or "").encode()
        for p in range(len(b) - 399):
            counts[b[p:p + 400]] += 1
            first.setdefault(b[p:p + 400], (i, p))
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if counts[b[p:p + 400]] > 1 and not (keep_first and first[b[p:p + 400]] == (i, p)):
                gone[p:p + 400] = True
        out.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, rows, keep_first):
    some = [r for r in rows if r[0] not in (400, 401) and not (keep_first and r[0] in (7, None))] + [(500, "ab" * 700, None)]
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.kept(documents(spark, some), keep_first).collect()], key=repr)
    assert got == covered(some, keep_first)


def test_factors():
    rng = random.Random(1)
    for _ in range(25):
        t = [rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 50))] + [99]
        previous, following = suffixes.factors(np.array(t), 6)

        def common(i, j):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            return k
        for i in range(len(t)):
            assert min(6, previous[i]) == min(6, max([common(i, j) for j in range(i)], default=0))
            assert min(6, following[i]) == min(6, max([common(i, j) for j in range(i + 1, len(t))], default=0))


def test_rules_and_trust(spark):
    pages = [(1, "http://A.org/x?q#f", '<a href="https://good.net/a">'), (2, "https://example.org/es/9", "<a href=//bad.net/>"), (3, "https://example.org/en/12", None),
             (4, "http://www.x.com/fr/", ""), (5, "http://x.com/de/1", ""), (6, "http://good.net", ""), (7, "http://links.net/z", "<a class=x href='http://x.com/de/1'>"),
             (8, None, None), (9, "no scheme", "x"), (10, "http://notorg/", ""), (11, "http://org", ""), (12, "http://lone.net/", ""), (12, "http://lone.net/", "")]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, trust string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in links.filtered(df).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("good.net", "", None, "allow") and got[7][2:] == (None, "block")  # links.net links to a blocked host
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert links.filtered(df).count() == len(pages)


def test_distrust_reaches_far_hosts(spark):
    pages = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(11)] + [(11, "http://h11.net/", '<a href="http://x.com/de/1">'), (12, "http://x.com/de/1", "")]
    got = {r.page_id: r.verdict for r in links.filtered(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(13)}
    small = spark.createDataFrame([(0.0, 1e-14, True), (1e-14, 1e-14, False), (2e-14, 1e-14, False)], "t double, d double, bad boolean")
    assert small.filter(links.blocked(F.col("t"), F.col("d")) != F.col("bad")).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<p>a<b>b</b> c<p>d &amp; e<div class='comments'>x</div>", "ab c\nd & e"), (None, ""), ("", ""), ("plain  text", "plain text"),
    ("<article><header><h1>T</h1></header><section class=comments><p>c</p></section><p>x<br>y</p></article><footer>f</footer>", "T\nx y"),
    ("<div class=sidebar><p>" + "side " * 90 + "</p></div><h1>T</h1><p>" + "long " * 40 + "</p><form>Name<input></form>", "T\n" + ("long " * 40).strip()),
    ("<div><a href=x>Home</a> <a href=y>News</a></div><script>var a = '<p>';</script><p>" + "word " * 50 + "</p>", ("word " * 50).strip()), ("<p>x</p", "x")])
def test_main_text(page, text):
    assert mainline.main_text(page) == text


LONG = "long words of an article stand here " * 4


@pytest.mark.parametrize("page, text", [
    ("<p>one</p><a title=don't href=x>link</a><p>it's text</p><p>end</p>", "one\nlink\nit's text\nend"),
    ('<p>First</p><p class="x>Second para</p><p>third', "First\nSecond para\nthird"),
    ("<p>one <span class=ad>buy</span> two &amp; 1 < 2</p>", "one two & 1 < 2"), ("a <!-- > x --> b<!--> c", "a b c"), ("<P HIDDEN>x</P>y", "y"),
    ("<p>see <a href=x>this</p><p>more</p><p>and</p><p>more</p>", "see this\nmore\nand\nmore"), ("a<svg><p>x</svg >b<script>'</script", "ab"),
    # a mark without a surge does not hide the text; one with a surge does
    (f"<article><p>teaser</p></article><div>{LONG}</div>", f"teaser\n{LONG.strip()}"), (f"<h1>T</h1><div><div><p>{LONG}", f"T\n{LONG.strip()}"), (f"<article><p>{LONG}</p></article><div>{LONG}</div>", LONG.strip()),
    # three links in a row are a menu, also in an article; fewer are text
    (f"<article><p>{LONG}<ul><li><a href=1>a</a><li><a href=2>b</a></ul><p>end</article>", f"{LONG.strip()}\na\nb\nend"),
    (f"<article><p>{LONG}<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>end</article>", f"{LONG.strip()}\nend"),
    (f"<article><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article>", LONG.strip())])
def test_main_text_of_odd_markup(page, text):
    assert mainline.main_text(page) == text


def test_main_text_by_windows():
    """Pages without marks against surge and dive written out line by line."""
    rng = random.Random(8)
    for _ in range(400):
        blocks = [(rng.choice("pppplle"), rng.choice([1, 3, 10, 30, 60, 100])) for _ in range(rng.randint(1, 25))]
        page = "".join("<div class=ad>x</div>" if kind == "e" else f"<a href=x>{'l' * n}</a><hr>" if kind == "l" else f"{'t' * n}<hr>" for kind, n in blocks)
        shown = []
        for block in blocks:  # an empty line opens each advert; it counts once
            shown += [("e", 0), block] if block[0] == "e" else [block]
        blocks = shown
        plain = [n if kind == "p" else 0 for kind, n in blocks]
        window = [sum(plain[i:i + 3]) for i in range(len(plain))]
        on, kept = False, []
        for i in range(len(blocks)):
            on = window[i] > 0 if on else plain[i] > 0 and window[i] > 86
            kept.append(on)
        with_text = [i for i, (kind, _) in enumerate(blocks) if kind != "e"]
        menu, row = set(), []
        for i in with_text + [None]:
            if i is not None and blocks[i][0] == "l":
                row.append(i)
            else:
                menu |= set(row) if len(row) >= 3 else set()
                row = []
        some = [i for i in with_text if kept[i] and i not in menu] or [i for i in with_text if i not in menu] or with_text
        assert mainline.main_text(page) == "\n".join(("l" if blocks[i][0] == "l" else "t") * blocks[i][1] for i in some)


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<a b=\"" * 150_000, "<p x='>t" * 100_000, "<!--" * 250_000,
                                  "<" * 500_000, "<svg></svg " * 90_000, "<p" + " " * 1_000_000, "<p " + "= " * 300_000])
def test_main_text_takes_linear_time(page):
    begun = time.process_time()
    mainline.main_text(page)
    assert time.process_time() - begun < 5  # quadratic readers take minutes


def test_main_text_of_the_pages(spark):
    for r in mainline.extracted(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.split(r"<article>|</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_tokens(spark, rows):
    ranks, pattern = vocabulary()
    enc = bpe.encoding(ranks, pattern)
    docs = documents(spark, rows + [(600, " " * 50000 + "x", "s"), (601, ("wort " * 30000) + "é 🎉", "s")])
    for r in bpe.tokens(docs, ranks, pattern).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
    assert bpe.token_digests(docs, ranks, pattern).count() == len(rows) + 2


def test_pieces_do_not_change_tokens():
    enc = bpe.encoding(*vocabulary())
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "1", "'s", "!", "word ", "ß"]) for _ in range(3000))
    assert [i for p in bpe.pieces(text, 20) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert "".join(bpe.pieces(text, 20)) == text


def test_secrets(spark):
    texts = ["token = abc123 PassWord:'x' api_key=ZZZZZZ", "AKIA" + "A" * 16 + " AKIA12", "f" * 24 + " " + "f" * 23, None, "", "Secret: \"" + "a1" * 20 + "\" é AKIA" + "B2" * 9]
    got = {r.doc_id: r for r in secrets.findings(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), None).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(6)] == [(2, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (1, 1, 1)]
    assert got[0].spans == "assign:0:14,assign:28:42" and got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()


def test_network_finds_held_out_secrets():
    rng = random.Random(8)

    def found(i):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        card = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        left, value = ("x token = \"", key) if i % 2 else ("paid by card ", card)
        return left + value + "\" and more", len(left), len(left) + len(value)
    windows = [found(i) for i in range(300)]
    y = np.arange(300) % 2
    net = secrets.settle(secrets.train(secrets.windows(windows[:150]), y[:150], epochs=40), secrets.windows(windows[150:225]), y[150:225])
    p = net.probability(secrets.windows(windows[225:])) >= net.threshold
    assert (p == (y[225:] == 1)).mean() > 0.95


@pytest.mark.parametrize("odds", [1.0, 1e-3, 1e-6])
def test_recall_does_not_depend_on_how_rare_secrets_are(odds):
    rng = random.Random(5)

    def found(i):
        key = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(40))
        left, value = ("x token = \"", key) if i % 2 else ("see https:", "//www." + "".join(rng.choice("abcdefghij") for _ in range(20)) + ".com/2024/")
        return left + value + "\" and more", len(left), len(left) + len(value)
    rows, y = [found(i) for i in range(2000)], np.arange(2000) % 2
    net = secrets.settle(secrets.train(secrets.windows(rows[:300]), y[:300], epochs=40), secrets.windows(rows[300:1000]), y[300:1000], odds)
    p = net.probability(secrets.windows(rows[1000:])) >= net.threshold
    assert p[y[1000:] == 1].mean() >= 0.95 and net.recall >= 0.98 and net.precision > 0.9


def test_the_network_adds_keys_that_no_pattern_finds(spark):
    rng = random.Random(3)
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = lambda: "".join(rng.choice(letters) for _ in range(39)) + "7"
    docs = [(i, f'set token = "{key()}" here', "s") for i in range(60)] + [(100 + i, f"the key is {key()} for now", "s") for i in range(50)]
    docs += [(200 + i, f"see https://www.example.com/{'abcde'[i % 5] * 4}/pages/{i:06d}/index", "s") for i in range(400)]
    net = secrets.fit(documents(spark, docs))
    got = {r.doc_id: r for r in secrets.findings(documents(spark, docs), net).collect()}
    assert sum(got[100 + i].spans == "network:11:51" for i in range(50)) >= 45
    assert all(got[100 + i].n_assign + got[100 + i].n_access + got[100 + i].n_hex == 0 for i in range(50))
    assert sum(got[200 + i].spans != "" for i in range(400)) <= 8 and net.recall >= 0.98


def test_stretches_beside_spans():
    rng = random.Random(6)
    for _ in range(200):
        spans = sorted((a, a + rng.randint(1, 9), "hex") for a in (rng.randrange(60) for _ in range(rng.randint(0, 8))))
        found = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(8))]
        assert secrets.beside(spans, found) == [any(a < e and s < b for s, e, _ in spans) for a, b in found]
    begun = time.process_time()
    secrets.scan([" ".join(f"token=abcdef123456{i:06d}" for i in range(40_000))], None)
    assert time.process_time() - begun < 10


@pytest.mark.parametrize("labelled", [0, 60])
def test_network_reads_small_and_lopsided_tables(spark, labelled):
    rng = random.Random(21)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    docs = [(i, f'token = "{key()}"', "s") for i in range(labelled)]
    # one long document supplies nearly all candidates
    docs += [(1000, " ".join(f"https://www.example.com/pages/{i:06d}/index" for i in range(20_000)), "s"), (1001, "the key " + key().upper()[:40] + " here", "s")]
    net = secrets.fit(documents(spark, docs))
    assert net is not None and net.threshold <= 1
    got = {r.doc_id: r.spans for r in secrets.findings(documents(spark, docs), net).collect()}
    assert got[1000] == ""  # addresses are no secrets
    left, right = ('token = "', '"') if labelled else ('set secret = "', '" for')
    hidden = [(left + key() + right, len(left), len(left) + 40) for _ in range(40)]
    assert (net.probability(secrets.windows(hidden)) >= net.threshold).mean() >= 0.8


def test_the_network_learns_from_every_candidate(spark):
    docs = [(1, " ".join(f"https://www.example.com/{i:05d}/index" for i in range(7_000)), "s"), (2, 'token = "' + "a1" * 400 + '"', "s"), (3, None, "s")]
    rows = secrets.training_rows(documents(spark, docs)).withColumn("net", F.when(F.col("held"), 0).otherwise(1))
    own = rows.filter("own").collect()
    assert len(own) == 7_001 and sum(r.secret for r in own) == 1 and max(len(r.candidate) for r in own) == 800
    net = secrets.train(secrets.windows([("x token = abcdef12 y", 2, 18), ("see //www.a.com/12 y", 4, 18)]), np.array([1, 0]), epochs=2)
    got = secrets.pulled(rows.repartition(5).rdd.mapPartitions(lambda part: secrets.encoded(part, True)), [net, net])
    whole = rows.collect()
    for i in (0, 1):
        part = [r for r in whole if r.net == i]
        w = secrets.windows([(r.before + r.candidate + r.after, len(r.before), len(r.before) + len(r.candidate)) for r in part])
        want = secrets.pulls(net, w, np.array([r.secret for r in part]))
        assert all(np.abs(want[k] - got[i, k]).max() <= 1 + 1e-12 * np.abs(want[k]).max() for k in want)


def test_mix(spark, rows):
    got = mixing.plan(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].source_size == sum(r["size"] for r in own)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(documents(spark, rows)).collect()))
    dealt = mixing.dealt(documents(spark, rows))
    assert dealt.columns[:-1] == documents(spark, rows).columns
    words = Counter()
    for r in dealt.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == Counter({k: n for k, own in by.items() if (n := sum(r.taken for r in own))})


def test_quotas_are_exact_and_drawn_without_replacement(spark):
    ends = {r.place: r.ends for r in mixing.shard_quotas(spark.createDataFrame([(0, 800), (1, 7), (2, 0), (3, 4000)], "place int, blocks long"), 3).collect()}
    assert {k: e[-1] for k, e in ends.items()} == {0: 800, 1: 7, 2: 0, 3: 4000}
    totals = np.diff(np.array([[0, *e] for e in ends.values()]), axis=1).sum(0)
    assert totals.max() - totals.min() <= 1
    assert 40 < np.diff([0, *ends[0]]).min() and np.diff([0, *ends[0]]).max() < 170


def test_templates(spark):
    line = "user {} logged in from host {} after some minutes"
    docs = [(i, f"unique words of document number {i} {prose(random.Random(i), 8)}\n{line.format(i, i * 7)}\nshort", "s") for i in range(5)]
    docs += [(10, None, "s"), (11, "", "s"), (12, "alpha beta gamma delta words\n\nalpha beta gamma delta words", "s"), (0, docs[0][1], "s")]
    got = {r.doc_id: r for r in templates.cleaned(documents(spark, docs)).collect()}
    assert got[0].n_dropped == 0 and [got[i].n_dropped for i in range(1, 5)] == [2, 2, 2, 2]  # too little of the first line is constant
    assert got[12].n_dropped == 0 and got[10].text is None and got[11].text == "" and got[1].text == docs[1][1].split("\n")[0]


def test_lines_of_other_content_stay(spark):
    rows = [[f"12 7 33 4 {i}", f"the quick brown fox{chr(97 + i)} jumped{chr(97 + i)}", "All rights reserved.", "", f"only {i}"] for i in range(5)]
    long = prose(random.Random(9), 25)
    docs = [(i, "\n".join(r), "s") for i, r in enumerate(rows)] + [(20, f"a\n{long}", "s"), (21, f"{long}\nb", "s"), (None, "All rights reserved.", "s")]
    df = documents(spark, docs)
    for c in ("places", "n_lines", "n_dropped", "_id", "_version", "_row", "leaf"):
        df = df.withColumn(c, F.lit(7))
    out = templates.cleaned(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text.split("\n") for i in range(5)] == [rows[0]] + [r[:2] + r[3:] for r in rows[1:]]
    assert got[20].text == docs[5][1] and got[21].text == "b" and got[21].n_lines == 2 and got[21].places == 7
    assert got[None].text == "" and got[None].n_dropped == 1


def test_template_words_generalise(spark):
    rng = random.Random(4)
    docs = [(i, f"the service at place {prose(rng, 1)} was restarted by the night team again\n{prose(rng, 9)}", "s") for i in range(6)]
    assert [r.n_dropped for r in sorted(templates.cleaned(documents(spark, docs)).collect())] == [0, 1, 1, 1, 1, 1]


def near(rows):
    def grams(t):
        w = WORD.findall(t or "")
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [(i, grams(t)) for i, t, _ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in sets}


def test_near_duplicates(spark, rows):
    got = probminhash.classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == near(rows)
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_pairs_inside_a_family_of_boilerplate(spark):
    rng = random.Random(12)
    passage = prose(rng, 150)
    docs = []
    for i in range(150):  # 0.84 to each other, 0.79 or less to all others: the leader of a bucket is like few of them
        both = prose(rng, 6)
        docs += [(2 * i + k, f"{passage} {both} {prose(rng, 14)}", "s") for k in range(2)]
    got = {r.doc_id: r.class_id for r in probminhash.classes(documents(spark, docs)).collect()}
    assert got == near(docs) and len(set(got.values())) == 150


def test_bands_cover_the_unweighted_measure():
    text = np.repeat([0, 1], 100)
    shingle = np.concatenate([np.arange(100), np.arange(10, 110)]).astype(np.uint64)
    times = np.where(np.arange(200) % 100 < 10, 10**6, 1)  # what one text repeats often the other has once or not at all
    found, ends = probminhash.banded(text, shingle, times, 2)
    plain, _ = probminhash.banded(text, shingle, np.ones(200, int), 2)
    assert list(ends) == [0, 2 * probminhash.BANDS, 4 * probminhash.BANDS]
    assert set(plain[:probminhash.BANDS]) & set(plain[probminhash.BANDS:])
    assert set(found[:probminhash.BANDS]) == set(plain[:probminhash.BANDS])
    assert not set(found[probminhash.BANDS:ends[1]]) & set(found[ends[1] + probminhash.BANDS:])


def test_slots_agree_as_often_as_texts_do():
    agree = []
    for seed in range(30):
        text = np.repeat([0, 1], 90)
        shingle = np.concatenate([np.arange(90), np.arange(30, 120)]).astype(np.uint64) + np.uint64(1000 * seed)
        who = probminhash.signatures(text, shingle, np.ones(180, int), 2)
        agree.append((who[0] == who[1]).mean())
    assert abs(np.mean(agree) - 0.5) < 0.04  # 60 of 120


def test_groups(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randint(101, 160)) for _ in range(60)] + [(200, 200), (300, 250), (250, 301)]
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[301] == got[250] == 250 and {v for k, v in got.items() if 100 <= k <= 160} == {100}


def test_quality_counts(spark, rows):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        c, inside, seen, again = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for i in range(len(w) - 2):
            if c[tuple(w[i:i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), again, len(inside)
    rng = random.Random(2)
    texts = [r[1] for r in rows] + ["".join(rng.choice("ab \n\té#") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in quality.judged(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), None).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_lines_are_told_apart_by_more_than_their_form(spark):
    word = "a"
    while len(word) < 1024:  # a word and its complement meet in every polynomial of a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = documents(spark, [(1, f"{word}\n{other}", "s"), (2, f"{word}\n{word}", "s"), (3, f"{word} x y {other} x y", "s")])
    got = {r.doc_id: r for r in quality.judged(docs, None).collect()}
    assert [got[i].n_dup_lines for i in (1, 2)] == [0, 1] and got[3].n_repeat_words == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("doc_id % 3 > 0")
    model = quality.fit(docs, seen)
    rows = quality.judged(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").filter("not base_failed").collect()
    right = {k: np.mean([r.kept == bool(r.quality) for r in rows if r.quality == k]) for k in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.95
    assert quality.fit(docs, seen.filter("quality = 1")) is None
