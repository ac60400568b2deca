"""Near-duplicates, archives, extraction, search, mixing and the pipeline against brute force."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nautigraph.llm import components, extract, mixing, neardup, vafile, warc
from nautigraph.llm.common import filesystem, table
from tests.llm.data import SCHEMA, awkward, empty, words


def plain_classes(rows, least=0.8):
    """Class of each text by all pairs of plain sets of word runs."""
    sets = {}
    for _, t, *_ in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[t or ""] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[find(t or "")].append(i)
    least_id = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return Counter((i, least_id[find(t or "")]) for i, t, *_ in rows)


def near_rows(seed=5):
    rnd = random.Random(seed)
    rows, i = [], 1000
    for g in range(12):
        base = words(rnd, rnd.randrange(60, 200)).split()
        for _ in range(rnd.choice((2, 3, 25))):
            t = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 4))):
                t[rnd.randrange(len(t))] = f"new{rnd.randrange(10**6)}"
            rows.append((i, " ".join(t), "en", "a", 1, None, None, None, None, None))
            i += 1
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    df, rows = awkward(spark)
    more = near_rows()
    got = neardup.near_duplicates(df.unionByName(spark.createDataFrame(more, SCHEMA)))
    assert Counter(tuple(r) for r in got.collect()) == plain_classes(rows + more)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_a_large_group_and_texts_of_one_hash(spark, monkeypatch):
    """5,000 near copies of one text, 5,000 equal rows, and hashes that most texts share; no slice of a centre's members is large."""
    rnd = random.Random(9)
    base = words(rnd, 60).split()
    near = []
    for i in range(5000):
        t = list(base)
        t[rnd.randrange(len(t))] = f"new{i}"
        near.append((i, " ".join(t)))
    more = [(5000 + i, base[0]) for i in range(5000)] + [(20000 + i, words(rnd, 12)) for i in range(200)]
    df = spark.createDataFrame(near + more, "doc_id long, text string")
    # one change in 60 words leaves 51 of 56 shingles, so any two near copies share at least 46 of 66 or more
    got = dict(tuple(r) for r in neardup.near_duplicates(df).collect())
    classes = Counter(got.values())
    assert classes[0] == 5000 and classes[5000] == 5000 and len(classes) == 202
    monkeypatch.setattr(neardup, "_hashes", lambda: (F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(40)).alias("node"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("other")))
    few = spark.createDataFrame(near[:60] + more[:3] + more[-100:], "doc_id long, text string")
    shared = dict(tuple(r) for r in neardup.near_duplicates(few).collect())
    assert Counter(shared.values()) == Counter({0: 60, 5000: 3} | {20100 + i: 1 for i in range(100)})
    assert sorted(r["doc_id"] for r in neardup.deduplicated(few).collect()) == [0, 5000, *range(20100, 20200)]


def test_which_of_equal_rows_stays(spark):
    rows = [(1, "a b c", s) for s in ("x", "y", "z", "x")] + [(2, "a b c", "w")]
    made = [neardup.deduplicated(spark.createDataFrame(r, "doc_id long, text string, source string").repartition(3)).collect() for r in (rows, rows[::-1])]
    assert len(made[0]) == 1 and made[0] == made[1] and made[0][0]["doc_id"] == 1


def test_one_of_each_class_stays(spark):
    df, rows = awkward(spark)
    more = near_rows(6)
    both = df.unionByName(spark.createDataFrame(more, SCHEMA))
    kept = neardup.deduplicated(both)
    assert kept.columns == both.columns
    want = {c for _, c in plain_classes(rows + more)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(want, key=str)
    assert neardup.deduplicated(empty(spark)).count() == 0


def test_dart_minhash_estimates_weighted_similarity():
    rnd = random.Random(1)
    a = {i: rnd.choice([0.3, 1, 2.5, 7]) for i in range(200)}
    b = {i: w if rnd.random() < 0.7 else rnd.choice([0.3, 1, 2.5, 7]) for i, w in [*list(a.items())[30:], *[(i, 1) for i in range(200, 230)]]}
    true = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(230)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(230))
    h = neardup.splitmix(np.arange(230, dtype=np.uint64))
    e = np.array([h[i] for i in a] + [h[i] for i in b])
    w = np.array([*a.values(), *b.values(), 0.0])
    owner = np.array([0] * len(a) + [1] * len(b) + [2])
    k = 4000
    s = neardup.dart_minhash(np.append(e, h[0]), w, owner, 3, k)
    assert abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)
    assert (s[2] == 0).all() and (s[:2] != 0).all()
    again = neardup.dart_minhash(e[:200], w[:200], owner[:200], 1, k)
    assert (again[0] == s[0]).all()  # other sets make no difference


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3)]
    root = {i: i for i in range(300)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(300))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = "page_id long, url string, html string, key string, digest string, rows long, keeper long"


def awkward_pages(spark):
    rnd = random.Random(2)
    rows = [(1, "http://a.b/", "x"), (2, "http://a.b/", "x"), (2, "http://a.b/", "x"), (None, None, None), (7, "http://www.Q.com:80/é?q#f", "é\r\n\r\nWARC/1.1\r\n"), (8, None, ""), (None, "u\nv", "x"), (9, "https://u:p@c.d:8080", " ")]
    rows += [(20 + i, f"http://h{i % 7}.example.org/p/{i % 11}?q={i}", rnd.choice(["same", "<p>" + words(rnd, 20)])) for i in range(60)] + [(99, "http://long.org/" + "p" * 3000, words(rnd, 60000))]
    return spark.createDataFrame([(*r, "k", "d", 1, 2) for r in rows], PAGES), rows


@pytest.mark.parametrize("block,shard", [(512, 100_000), (2, 7)])
def test_archive_round_trip(spark, monkeypatch, block, shard):
    monkeypatch.setattr(warc, "BLOCK_LINES", block)
    monkeypatch.setattr(warc, "SHARD_LINES", shard)
    df, rows = awkward_pages(spark)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    want = Counter()
    for h, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        for i in ids:
            first = top is None or i == top or len(ids) == 1
            want[i, len(h.encode()), digest, "response" if first else "revisit", None if first else top] += 1
    got = warc.archive_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_lookup_and_records(spark):
    df, rows = awkward_pages(spark)
    archive = warc.write(df, min_bytes=2)
    key = warc.index_key("http://www.Q.com:80/é?q#f", 7)
    assert key == "com,q)/é?q 7"
    keys = spark.createDataFrame([(key,), ("nothing )/", ), (None,), (warc.index_key("http://a.b/", 1),)], "key string")
    got = {r["page_id"]: r for r in warc.read(warc.lookup(keys, archive), archive).collect()}
    assert set(got) == {1, 7} and bytes(got[7]["payload"]).decode() == rows[4][2] and got[7]["url"] == "http://www.Q.com:80/é?q#f"
    assert got[1]["record_type"] == "response"  # shorter than min_bytes
    place = warc.lookup(keys, archive).where("page_id = 7").first()
    fs, top = filesystem(archive.root)
    with fs.open_input_file(f"{top}/{place['file']}") as f:
        raw = gzip.decompress(f.read_at(place["length"], place["offset"]))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
    head, http, payload = warc.parse(raw)
    assert int(http["content-length"]) == len(payload)


def cost(terminal, links, side):
    return sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(terminal, side)) + sum(w for a, b, w in links if side[a] != side[b])


def test_cut_is_the_cheapest_of_all():
    rnd = random.Random(4)
    for _ in range(500):
        n = rnd.randint(1, 9)
        t = [rnd.uniform(-2, 2) for _ in range(n)]
        links = [x for x in ((rnd.randrange(n), rnd.randrange(n), rnd.uniform(0, 1.5)) for _ in range(rnd.randint(0, 14))) if x[0] != x[1]]
        best = min(cost(t, links, s) for s in itertools.product((False, True), repeat=n))
        assert cost(t, links, extract.min_cut(t, links)) == pytest.approx(best, abs=1e-9)


def test_classifier_on_new_pages():
    w = extract.trained()
    wrong = 0
    for page, labels in extract.sample_pages(200, 77):
        blocks = extract.parse(page)
        wrong += extract.min_cut((extract.features(blocks) @ w).tolist(), extract.edges(blocks)) != labels
    assert wrong <= 6


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><ul><li><a href="/">Home<li><a href="/x">More</a></ul></nav>
<header>Site name</header><div class="cookie-notice"><p>We use cookies to count visits. Accept?</p><button>OK</button></div><aside><p>Read this other story too.</p></aside>
<article class="post"><header><h1>A  title &amp;&nbsp;more</h1></header><p>First<b>part</b> of the text,<br>second line of it.<p>a &lt; b &eacute;&#233;<script>var x="<p>no</p>";</script> goes on here.
<div class="ad">Buy this great thing now.</div><ul><li>One point of it.<li>Another point of it.</ul><form><label>Mail</label><input value="x"><textarea>no</textarea></form></article>
<section id="comments"><h2>Comments</h2><p>I liked this text a lot, thank you for it.</p></section><footer>&copy; 2024 Someone. All rights.</footer></body></html>"""


def test_main_text_of_a_page(spark):
    w = extract.trained()
    assert extract.main_text(PAGE, w) == "A title & more Firstpart of the text, second line of it. a < b éé goes on here. One point of it. Another point of it."
    for s in ("<" * 20000, "<div>" * 20000 + "x", "<p>a" * 20000, '<a href="x>y</a>' * 5000, "<li>a" * 20000, "<b>" * 9000 + "</i>" * 9000, "<script>" * 9000, "<a <b <c", "</", "<p", "a<"):
        extract.main_text(s, w)
    rows = [(1, "u", PAGE, None, None, None, None), (1, "u", PAGE, None, None, None, None), (2, None, None, "k", None, None, None), (None, "v", "", None, None, None, None), (3, "w", "plain words of a text without any markup.", None, None, None, None)]
    got = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[2]["text"] == "" and got[None]["n_chars"] == 0 and got[3]["text"] == "plain words of a text without any markup."
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def plain_top(rows, every, k):
    use = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(use):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(use) if b != a and len(v) == len(q))[:k]
            for r, (s, j) in enumerate(best, 1):
                out[i, r, j, -s] += 1
    return out


def test_formulas_stay_and_unclosed_graphics_end_at_the_next_block():
    texts = lambda page: [t for _, t in extract.parse(page)]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><p>More</p>") == ["Let x=2 hold.", "More"]
    assert texts("<p>A <math><mi>x</mi></p><p>kept</p>") == ["A x", "kept"]
    assert texts('<p>see <object data="x">the table</object> here</p>') == ["see the table here"]
    assert texts("<p>A <svg><text>no</text></p><p>kept</p><p>b <svg><text>no</text></svg> c</p>") == ["A", "kept", "b c"]
    assert texts("<p>A <svg><foreignObject><div>no</div></foreignObject><text>no</text></svg> b</p>") == ["A b"]
    assert texts("<video><p>kept</p>") == ["kept"] and texts("<p>a<script>no <p>no</p>") == ["a"]


@pytest.mark.parametrize("block,query,group", [(16384, 4096, 16), (9, 3, 16), (9, 2, 2)])
def test_search_equals_all_scores(spark, monkeypatch, block, query, group):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", query)
    monkeypatch.setattr(vafile, "GROUP", group)
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(size=5))]) for i in range(90)]
    rows += [(200 + i, [0.5, 0.25, 0.0, -0.5, 0.125]) for i in range(30)]  # ties
    rows += [(300, None), (None, [1.0] * 5), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [1.0, float("nan"), 0.0, 0.0, 0.0]), (303, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    rows += [(304, [1.0, 2.0]), (320, [3.0, -1.0]), (40, rows[41][1]), (40, rows[41][1]), (400, []), (401, []), (402, [3e17] * 5), (420, [2e8] * 5)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, block string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    small = [(i, v) for i, v in rows if i != 402]
    got = vafile.top_k(df.where("vec_id <> 402 or vec_id is null"), 20, 20).collect()
    assert Counter(tuple(r) for r in got) == plain_top(small, 20, 20)
    assert vafile.top_k(df.limit(0)).count() == 0
    # components and scores that 64 bits don't hold end at their limits
    huge = spark.createDataFrame([(0, [3e17, 0.0]), (1, [3e17, 0.0]), (2, [-3e17, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in vafile.top_k(huge, 20, 20).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    x = rnd.integers(-70, 70, (300, 7))
    packed, edges = vafile.approximate(x)
    low, high = vafile.bounds(packed, edges, 7)
    assert (low <= x).all() and (x <= high).all()


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, None: 50, "c": 40})
    assert t["a"] == 30.0  # ranked a, b, c, null with 5, 2, 1, 5; a stops at three times its size
    assert sum(t.values()) == pytest.approx(200) and t["b"] == pytest.approx(170 * 2 / 8) and t[None] == pytest.approx(170 * 5 / 8)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flight_keeps_totals_and_landing_decides():
    rnd = random.Random(1)
    for _ in range(30):
        n = rnd.randint(3, 200)
        size = [float(rnd.randint(0, 500)) for _ in range(n)]
        p = [rnd.random() for _ in range(n)]
        total, tokens = sum(p), sum(a * b for a, b in zip(p, size))
        held = mixing.flight(p, size, rnd)
        assert len(held) <= 2 and sum(p) == pytest.approx(total, abs=1e-6) and sum(a * b for a, b in zip(p, size)) == pytest.approx(tokens, abs=1e-3)
        mixing.landing(p, size, held, rnd)
        assert set(p) <= {0.0, 1.0}
    mean = np.mean([[mixing_run(s)] for s in range(2000)])
    assert abs(mean - 0.3) < 0.04


def mixing_run(seed):
    rnd = random.Random(seed)
    p, size = [0.3] * 9, [float(10 + 7 * i % 5) for i in range(9)]
    mixing.landing(p, size, mixing.flight(p, size, rnd), rnd)
    return p[4]


def test_mix_rows(spark, monkeypatch):
    df, rows = awkward(spark)
    for bucket in (4096, 8):  # one level, and several
        monkeypatch.setattr(mixing, "BUCKET", bucket)
        monkeypatch.setattr(mixing, "SPARE", min(32, bucket // 4))
        got = mixing.mix(df).collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
        assert all(r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"] for r in got)
        again = mixing.mix(df.repartition(7)).collect()
        assert Counter((r["doc_id"], r["key"], r["taken"]) for r in got) == Counter((r["doc_id"], r["key"], r["taken"]) for r in again)
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["key"]] += r["copies"]
    got = Counter(tuple(r) for r in made.select("doc_id", F.xxhash64("doc_id", "text")).collect())
    assert got == +want
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mix_comes_near_its_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r["n"] / r["t"] - 1) < 0.02


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "byte_bpe"] and P.ORACLE_SQL is None
    docs = table(spark, sf, "documents")
    frames = [docs]
    for _, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
    for f in frames[1:-1]:
        assert f.columns == docs.columns and f.dtypes == docs.dtypes
    kept = Counter(c for _, c in plain_classes([tuple(r) for r in frames[1].select("doc_id", "text").collect()]))
    assert frames[2].count() == len(kept)
    assert frames[3].count() == frames[2].count() and frames[5].count() == frames[4].count()
    whole = P.run(spark, sf)
    assert Counter(tuple(r) for r in whole.collect()) == Counter(tuple(r) for r in frames[5].collect())
    stages = P.STAGES
    df, _ = awkward(spark)
    for name, stage in stages:
        assert stage(spark, df, sf).count() > 0
        assert stage(spark, df.limit(0), sf).count() == 0


def test_registered_queries(spark):
    from nautigraph.llm import queries as Q

    assert [n.split("_")[0] for n in Q.queries()] == [f"op{n}" for n in range(1, 11)]
    assert set(Q.oracle_sql()) <= set(Q.queries())


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op3_warc", "op5_vector_top_k"])
def test_query_equals_sql(spark, sf, name):
    import duckdb

    from nautigraph.llm import queries as Q

    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


STORY = "The harbour was quiet that morning, and nobody had come.", "Then three ships arrived, one after another, and the quay filled with people."
BODY = "".join(f"<p>{p}</p>" for p in STORY)
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Ships</a></li></ul>'
LAYOUTS = (
    f'<div class="layout has-sidebar">{BODY}</div>',
    f'<article class="post tags-news share-enabled">{BODY}</article>',
    f'<div class="layout has-sidebar">{BODY}<div class="sidebar">{MENU}</div></div>',
    f'<div class="container sidebar-right">{BODY}</div>',
    f'<div class="container sidebar-right"><main>{BODY}</main><div class="sidebar">{MENU}</div></div>',
    f'<div class="content-sidebar-wrap"><div class="entry">{BODY}</div></div>',
    f'<div class="no-ads"><article>{BODY}</article></div>',
    f'<div class="page with-footer">{BODY}</div><footer>Imprint</footer>',
    f'<div class="js-nav-open"><nav>{MENU}</nav><section>{BODY}</section></div>',
    f'<section class="entry category-advertising">{BODY}</section>',
    f'<div class="header-fixed"><article>{BODY}</article></div>',
    f'<article class="comments-open">{BODY}</article>',
    f'<article class="story related-on">{BODY}</article><div class="related"><p>Read this next.</p></div>',
    f'<main class="has-banner"><div class="banner">Buy boats now</div>{BODY}</main>',
    f'<div id="main-menu">{MENU}</div><div id="page-with-menu">{BODY}</div>',
    f"<div class='is-popup-closed'>{BODY}</div><div class='popup'><p>Subscribe to our letter today.</p></div>",
    f"<div class=layout-sidebar>{BODY}</div>",
    f'<div class="widget-free">{BODY}</div>',
    f'<article class="post type-post format-promo">{BODY}</article><section class="comments"><article class="comment"><p>Great read, thanks a lot for it.</p></article></section>',
    f'<div class="theme-overlay"><div class="post-content">{BODY}</div><div class="post-footer">Shared by many</div></div>',
    f'<script src="a.js"/>var leak=1;</script><div>{BODY}</div><style/>p {{color: red}}</style>',
    f'<title/>A title</title><div>{BODY}</div>',
)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_names_of_layouts_and_states_do_not_drop_the_article(layout):
    assert extract.main_text(f"<html><body>{layout}</body></html>", extract.trained()) == " ".join(STORY)


def test_what_names_tell():
    told = {"sidebar": "boiler", "leftSidebar": "part", "post-footer": "part", "footer-content": "part", "mainContent": "content", "entry-content": "content", "comment-list": "comment", "has-sidebar": "", "comments-open": "", "content-sidebar-wrap": "", "x1": "", "": ""}
    assert {name: extract._told(name) for name in told} == told


def test_many_equal_rows_fall_into_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 256)
    real = mixing._round

    def watched(level, last):
        decide = real(level, last)

        def run(rows):
            assert len(rows) < 600
            return decide(rows)

        return run

    monkeypatch.setattr(mixing, "_round", watched)
    rows = [(7, "one two three", "a")] * 5000 + [(i, words(random.Random(i), 3 + i % 40), "b") for i in range(100, 700)] + [(7, "one two three", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source_size"):
        assert g["taken"].sum() == pytest.approx(g["target"].iloc[0], rel=0.01)
    made = mixing.mixed_documents(df).groupBy("source").count().collect()
    copies = {r["source"]: r["count"] for r in made}
    assert copies["a"] == pytest.approx(got[got["source_size"] == 15000]["target"].iloc[0] / 3, rel=0.01)


def test_targets_of_many_sources_follow_the_same_rule(spark, monkeypatch):
    rnd = random.Random(12)
    sizes = {None: 40, "": 7, **{f"s{rnd.randrange(10**6)}é": rnd.choice((0, 1, 5, 200, 3000)) for _ in range(60)}}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 5)
    many = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(df).collect()}
    assert {k: v[0] for k, v in many.items()} == pytest.approx({k: v[0] for k, v in few.items()}) and {k: v[1] for k, v in many.items()} == {k: v[1] for k, v in few.items()}
