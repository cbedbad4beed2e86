"""The operators against brute force, on small documents with nulls, ties, repeats and odd texts, and on whole small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import xxhash

from scriptorium.llm import bpe, common, html_wrapper, lm, media, packing, pii, queries, simhash, token_files, toxicity, winnow

ODD = ["", " ", "one", "One two", "a b c", "a  b\n\nc ", "it's  don't \xa0 \n b <|endoftext|>", "ab\x1c. \x1d c", "x" * 3000, "é ́b Σ", "\U0001f600 mail a.b@c.de, +49 30 901820 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 256.1.1.1", "1 " * 2000, "a@" * 500, "tail \n", None, None]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """All documents of the smallest table, then odd ones, repeats, a null id; columns whose names clash with the operators' own."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = real + [(10**9 + 7 * k, x) for k, x in enumerate(ODD)] + real[:3] + [(None, real[5][1]), (None, None)]
    rows.append((5 * 10**9, " ".join(real[0][1].split()[:9000] * 40)))
    return spark.createDataFrame([(i, t, "en", "k", 1, 2) for i, t in rows], "doc_id long, text string, lang string, row string, run int, fp int").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def same_rows(found, expected):
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


# --- near duplicates ---


def brute_simhash(text, words=3):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(docs, texts, small, monkeypatch):
    if small:  # many shards, each a grid of cells
        monkeypatch.setattr(simhash, "SHARD_AIM", 8)
        monkeypatch.setattr(simhash, "SHARD_ROWS", 12)
    fps = [brute_simhash(t) for _, t in texts]
    root = brute_components(fps, 3)
    least = defaultdict(list)
    for (i, _), r in zip(texts, root, strict=True):
        least[r] += [i] if i is not None else []
    expected = [(i, f"{f:016x}", min(least[r]) if least[r] else None) for (i, _), f, r in zip(texts, fps, root, strict=True)]
    same_rows(simhash.near_duplicates(docs).collect(), expected)


def test_near_pairs_are_whole():
    rng = np.random.default_rng(1)
    home = rng.integers(0, 2**32, 900, dtype=np.uint64)
    home[300:600] = home[:300] ^ np.uint64(5)
    found = {(int(a), int(b)) for x, y in simhash.near_pairs(home, home, 3, rng) for a, b in zip(x, y, strict=True)}
    assert found == {(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(home[:, None] ^ home) <= 3), strict=True)}


def rows_of_joins(spark, since: int) -> int:
    """Rows that joins made in all executions after the first ``since``."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList().iterator()
    while runs.hasNext():
        k = runs.next().executionId()
        values, nodes = (store.executionMetrics(k), store.planGraph(k).allNodes().iterator()) if k >= since else ({}, None)
        while nodes and nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator() if "Join" in node.name() else None
            while metrics and metrics.hasNext():
                if (m := metrics.next()).name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    total += int(v.get().replace(",", ""))
    return total


def test_links_meet_labels_once(spark):
    """Many links within one large group, as each block gives its own, beside a chain, pairs and a loop: least labels; links aren't joined again in every round."""
    rng = np.random.default_rng(6)
    links = {(int(a), int(b)) for _ in range(15) for order in [rng.permutation(800)] for a, b in zip(order[1:], order[(np.arange(799) // 8)], strict=True)}
    links |= {(3000 + int(a), 3000 + int(b)) for order in [rng.permutation(40)] for a, b in zip(order, order[1:], strict=False)} | {(4000 + k, 4000 + k + 1) for k in range(0, 40, 2)} | {(5000, 5000)}
    name = lambda k: bytearray(k.to_bytes(8, "big"))
    edges = spark.createDataFrame([(name(min(e)), name(max(e))) for e in links], "a binary, b binary").cache()
    edges.count()
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {int.from_bytes(r.fp, "big"): int.from_bytes(r.label, "big") for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(800)} | {3000 + k: 3000 for k in range(40)} | {4000 + k: 4000 + k - k % 2 for k in range(40)} | {5000: 5000}
    assert 0 < rows_of_joins(spark, since) < 3 * len(links)
    assert simhash.components(edges.limit(0)).isEmpty()


def test_one_of_each(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(1, base), (2, base), (2, base), (3, base.replace("w7 ", "z ")), (4, " ".join(f"v{k}" for k in range(300))), (None, "alone at last"), (9, None), (8, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.NEAR_COPIES)
    same_rows(kept.collect(), [(1, base), rows[4], rows[5], (8, "")])
    assert kept.columns == ["doc_id", "text"]


def brute_similar(sets):
    """Components at 0.8: as brute_components, by exact similarity."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def test_similar_roots():
    rng = np.random.default_rng(8)
    sets = [{*range(k * 1000, k * 1000 + 40)} for k in range(4)]
    sets += [({*sorted(sets[k % 4])[: 40 - int(cut)]} | {*rng.integers(10**6, 10**9, more).tolist()}) for k, cut, more in zip(range(120), rng.integers(2, 28, 120), rng.integers(0, 16, 120), strict=True)]
    found = simhash.similar_roots([np.array(sorted(x), np.uint64) for x in sets], (4, 5)).tolist()
    expected = brute_similar(sets)
    parts = lambda root: {frozenset(k for k, r in enumerate(root) if r == one) for one in set(root)}
    assert parts(found) == parts(expected) and 4 < len(parts(expected)) < len(sets)


def test_one_of_each_is_exact_at_the_bound(spark):
    """Lone pairs at similarities from 0.70 to 0.90: those of 0.8 or more lose their second text, no other does."""
    rows, alike = [], {}
    for k in range(200):
        words = [f"w{k}x{j}" for j in range(304)]  # 300 shingles
        other = [*words]
        other[-(17 + k % 39) :] = [f"v{k}x{j}" for j in range(17 + k % 39)]
        shingles = [{tuple(x[j : j + 5]) for j in range(300)} for x in (words, other)]
        alike[k] = 5 * len(shingles[0] & shingles[1]) >= 4 * len(shingles[0] | shingles[1])
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.NEAR_COPIES).collect()}
    assert kept == {2 * k for k in alike} | {2 * k + 1 for k in alike if not alike[k]} and len(set(alike.values())) == 2


@pytest.mark.parametrize(("shard", "rows"), [(1 << 18, 1 << 20), (40, 30)])
def test_wide_links(spark, monkeypatch, shard, rows):
    """Candidates by wide fingerprints are all that brute force finds, in one cell a block as in many shards and cells."""
    monkeypatch.setattr(simhash, "WIDE_SHARD", shard)
    monkeypatch.setattr(simhash, "WIDE_ROWS", rows)
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        own = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for cut in (0, 4, 7, 30):
            sets.append(np.unique(np.concatenate((own[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)))))
    fps, sims = [k.to_bytes(8, "big") + bytes(8) for k in range(len(sets))], [simhash.wide_simhash(x) for x in sets]
    values = simhash.unpacked(sims)
    blocks = np.stack([simhash.block_bits(values, k, simhash.WIDE_BLOCKS) for k in range(simhash.WIDE_BLOCKS)], axis=1)
    lane = np.arange(simhash.WIDE_BLOCKS) * simhash.LANES // simhash.WIDE_BLOCKS
    root = list(range(len(sets)))
    for a in range(len(sets)):
        near = np.bitwise_count(blocks[a] ^ blocks) <= simhash.WIDE_RADIUS
        far = np.bitwise_count(values[a] ^ values).astype(int)
        near &= far[:, (lane + 1) % simhash.LANES] + far[:, (lane + 2) % simhash.LANES] <= simhash.NEAR_CHECK
        for b in np.flatnonzero(near.any(axis=1)).tolist():
            root = [root[a] if r == root[b] else r for r in root]
    frame = spark.createDataFrame(list(zip(map(bytearray, fps), map(bytearray, sims), strict=True)), "fp binary, sim binary")
    found = list(range(len(sets)))
    for r in simhash.wide_links(frame).collect():
        a, b = int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")
        found = [found[a] if x == found[b] else x for x in found]
    parts = lambda of: {frozenset(k for k, r in enumerate(of) if r == one) for one in set(of)}
    assert parts(found) == parts(root) and 40 <= len(parts(root)) < 120


# --- pages ---


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in html_wrapper.extract_pages(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


def test_pages_without_article(spark):
    page = "<html><head><title>t</title><script>var a='</div>';</script></head><body><div class='top-menu'>Home</div><div id=content><h1>H {0}</h1><p>one&nbsp;&amp; <b>two</b>\n {0}<ul><li>x{0}<li>y</ul></div><div class='comments'>bad</div><form>f</form><p>Copyright</p>"
    rows = [(k, "http://U@h.example:80/x", page.format(k)) for k in range(5)] + [(9, None, None), (9, "h", ""), (10, "http://h.example", "plain < text <!-- c"), (11, "http://h.example", "<div>" * 3000 + "deep")]
    found = html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    expected = [(k, rows[0][1], t := f"H {k}\n\none & two {k}\n\nx{k}\n\ny", len(t)) for k in range(5)] + [(9, None, "", 0), (9, "h", "", 0), (10, "http://h.example", "plain < text", 12), (11, "http://h.example", "deep", 4)]
    same_rows(found.collect(), expected)


def test_wrapper_folds_and_aligns():
    pages = ["<div><p>a</p><p>b</p><pre>same</pre></div>", "<div><p>c</p><pre>same</pre><table></table></div>"]
    div = html_wrapper.merge(*(html_wrapper.page_item(html_wrapper.parse(p)) for p in pages)).children[0]
    assert [(x.sign, x.repeated, x.optional, x.pages) for x in div.children] == [("p", 1, False, 2), ("pre", 0, False, 2), ("table", 0, True, 1)]
    assert div.children[0].children[0].slot() == 3 and div.children[1].children[0].slot() == 0
    again = html_wrapper.unpacked(html_wrapper.packed(div))
    assert html_wrapper.packed(again) == html_wrapper.packed(div) and [x.sign for x in again.children] == ["p", "pre", "table"]


def test_matches_are_longest():
    rng = np.random.default_rng(7)
    for n, m, k in [(0, 5, 2), (1, 1, 1), (9, 14, 3), (60, 45, 4), (700, 650, 12), (350, 5, 2)]:
        a, b = rng.integers(0, k, n).tolist(), rng.integers(0, k, m).tolist()
        best = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        found = html_wrapper.matches(a, b)
        assert len(found) == best[n, m] and all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


SITE = "<html><body class='single has-sidebar'><div class=top><p>Welcome to the daily site</p><ul><li><a href=/a>Home</a><li><a href=/b>All news</a></ul></div><div class=x>{}</div><div class=y><p>All rights are ours</p></div></body></html>"


def site_pages(n):
    """Pages of a host without telling names: only that their texts differ shows which is the article."""
    rng = np.random.default_rng(9)
    body = lambda: "".join(f"<p>{' '.join(f'w{k}' for k in rng.integers(0, 900, 30))}</p>" for _ in range(rng.integers(1, 5)))
    made = [body() for _ in range(n)]
    return [SITE.format(f"<h2>Share this with friends</h2>{b}") for b in made], ["\n\n".join(re.findall("<p>(.*?)</p>", b)) for b in made]


def test_the_wrapper_decides():
    """Fixed texts go and slots stay; with an empty wrapper, which knows neither, a page's text is another."""
    pages, texts = site_pages(12)
    trees = [html_wrapper.parse(p) for p in pages]
    wrapper = html_wrapper.infer(trees)
    assert [html_wrapper.extract(x, wrapper) for x in trees] == texts
    empty = html_wrapper.infer([])
    assert all(html_wrapper.extract(x, empty) not in (t, "") for x, t in zip(trees, texts, strict=True))


def test_names_and_headers():
    one = lambda page: html_wrapper.extract(tree := html_wrapper.parse(page), html_wrapper.infer([tree]))
    assert one("<body><header>Site name</header><p>the text</p></body>") == "the text"
    assert one("<body class='single has-sidebar'><p>the text</p></body>") == "the text"
    assert one("<article class='post category-advertising'><p>the text</p></article>") == "the text"
    assert one("<article class='post tag-social'><p>the text</p><aside>no</aside><div class='share-this'>no</div></article>") == "the text"
    assert one("<article><header><h1>Title</h1><p>by me</p></header><p>the text</p><section class=comments><article class=comment>no</article></section></article>") == "Title\n\nthe text"
    assert one("<div class='banner-layout'><h1>Title</h1><p>the text</p></div>") == "Title\n\nthe text"
    assert one("<a><div>in a link</div></a> <b>bold <span class=ad>no</span>") == "in a link\n\nbold"
    assert one("<div>" * 50_000 + "deep") == "deep"


def test_hosts_of_any_size_and_both_ways(spark):
    """A large host is merged in shares; whether wrappers are sent or meet their pages in a shuffle, texts are the same."""
    pages, texts = site_pages(90)
    rows = [(k, f"http://{'big' if k < 70 else f'h{k % 3}'}.example/{k}", p) for k, p in enumerate(pages)] + [(3, "http://big.example/3", pages[3]), (None, None, None), (7, None, "")]
    table = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, share int")
    expected = [(k, rows[k][1], t, len(t)) for k, t in enumerate(texts)] + [(3, rows[3][1], texts[3], len(texts[3])), (None, None, "", 0), (7, None, "", 0)]
    for how in ({}, {"share": 7}, {"share": 7, "sent_bytes": -1}):
        same_rows(html_wrapper.extract_pages(table, **how).collect(), expected)
        assert html_wrapper.extract_pages(table.limit(0), **how).isEmpty()


def test_wrapper_is_of_all_pages(spark):
    """A second layout that stands on few of a host's pages is aligned too, and the article may stand late in a long page."""
    page = "<body><p>Site of all</p><div><h2>T {0}</h2><p>text {0}</p></div></body>"
    other = "<body><p>Site of all</p><section><p>Fixed words of the second layout</p><p>{0} is new</p></section></body>"
    rows = [(k, "http://h.example", page.format(k)) for k in range(60)] + [(100 + k, "http://h.example", other.format(k)) for k in range(40)]
    long = "<body><div class=post>small</div>" + "<div><i>x</i></div>" * 5000 + "<div class=story>" + "<p>the article itself</p>" * 4000 + "</div></body>"
    rows.append((999, "http://long.example", long))
    found = {r.page_id: r.text for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == 101 and found[999] == "\n\n".join(["the article itself"] * 4000)
    items = html_wrapper.infer(html_wrapper.parse(h) for _, _, h in rows[:100])
    signs = lambda x: {x.sign}.union(*map(signs, x.children))
    assert {"h2", "section"} <= signs(items) and all("Site of all" not in t for k, t in found.items() if k < 999)


# --- packing ---


def word_ids(text):
    return common._json_tokenizer(queries.tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def check_packed(rows, expected_pieces, capacity):
    same_rows([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], expected_pieces)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("block", [40, packing.BLOCK_PIECES])
def test_packing(docs, texts, block):
    encoder = queries.word_encoder(queries.tokenizer_path("word_bpe_49k.json"))
    expected = []
    for i, t in texts:
        ids = np.array([*word_ids(t), 1], "<u4")
        expected += [(i, k, s, len(p), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 4096)) for p in [ids[s : s + 4096]]]
    pieces = packing.pieces_of(docs, encoder).cache()
    rows = packing.pack(pieces, 4096, block).collect()
    n = check_packed(rows, expected, 4096)
    least = -(-sum(e[3] for e in expected) // 4096)
    assert n <= least + (1 if block > 1000 else 4)


def test_ids_of_odd_characters_are_the_library_s():
    encode, library = queries.word_encoder(queries.tokenizer_path("word_bpe_49k.json"))(), common._json_tokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    pool = [*map(chr, range(0x250)), *list(" \t\n.,;:!?'\"()-\u0130i") * 8, *list("abcdefgXYZ019") * 8, "\u0307", "\u0301", "\u4e2d", "\U0001f600"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 24))) for _ in range(20_000)] + ["\u0130.\u00d6. 500 y\u0131l\u0131nda", "AKP-\u0130'nin"]
    wrong = [t for t, found, e in zip(texts, encode(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True) if found.tolist() != e.ids]
    assert not wrong


def test_pairs_of_a_bin_have_every_sum_of_two():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 70, 300):
        lengths = rng.integers(1, 20, n).tolist()
        search = packing._Search([list(range(n))], lengths, 4096)
        assert {lengths[i] + lengths[j] for i, j in search.pair.tolist()} == {lengths[i] + lengths[j] for i in range(n) for j in range(i)}


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    encoder = queries.word_encoder(queries.tokenizer_path("word_bpe_49k.json"))
    out = packing.pack_documents(none, encoder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and not out.count()


def test_packing_encodes_few_bytes_at_once(spark):
    texts = ["a " * 50_000] * 50 + ["b " * 1_500_000, "c"]  # 5 MB, then one long text

    def counting():
        def encode(column):
            sizes = [len(t) for t in column.to_pylist()]
            assert len(sizes) == 1 or sum(sizes) <= 2 << 20
            return [np.array([n], "<u4") for n in sizes]

        return encode

    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.length) for r in packing.pieces_of(docs, counting).collect()) == [(k, 2) for k in range(len(texts))]


def test_local_search_empties_a_bin():
    lengths = [60, 50, 40, 30, 20]
    bins = [[0, 3], [1, 4], [2]]  # 90, 70, 40 of 100
    found = packing.local_search(bins, lengths, 100)
    assert len(found) == 2 and sorted(i for b in found for i in b) == [0, 1, 2, 3, 4]
    assert all(sum(lengths[i] for i in b) <= 100 for b in found)
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 100, 60).tolist()
        first = packing.best_fit(lengths, 100)
        found = packing.local_search(first, lengths, 100)
        assert len(found) <= len(first) and sorted(i for b in found for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 100 for b in found)


def test_local_search_goes_on_beyond_the_emptiest_bin():
    """One document alone that fits nowhere is the emptiest bin; the next two still become one."""
    lengths = [50, 40, 35, 45, 55, 48, 51]
    bins = [[0], [4, 1], [6, 3], [5, 2]]  # 50, 95, 96, 83 of 100
    found = packing.local_search(bins, lengths, 100)
    assert sorted(i for b in found for i in b) == [*range(7)] and all(sum(lengths[i] for i in b) <= 100 for b in found)
    rng = np.random.default_rng(9)
    lengths = rng.integers(900, 1401, 400).tolist()
    first = packing.best_fit(lengths, 4096)
    found = packing.local_search(first, lengths, 4096)
    assert sorted(i for b in found for i in b) == [*range(400)] and all(sum(lengths[i] for i in b) <= 4096 for b in found)
    assert len(found) < len(first)
    fill = [sum(lengths[i] for i in b) for b in found]
    for v, own in enumerate(found):  # no step of any kind is left
        for t, other in enumerate(found):
            if v != t and fill[v] <= fill[t]:
                room = 4096 - fill[t]
                one, two = ([lengths[i] for i in b] for b in (own, other))
                pairs = lambda x: [a + b for k, a in enumerate(x) for b in x[k + 1 :]]
                assert not any(0 < g - b <= room for g in one + pairs(one) for b in [0, *two])
                assert not any(0 < g - b <= room for g in one for b in pairs(two))


# --- token files ---


def test_token_files(spark, docs, texts, tmp_path):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    token_files.write_token_files(docs, str(tmp_path / "t"), queries.byte_encoder(path), block_ids=5_000)
    tokenizer = common._json_tokenizer(path)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0]))
    rows = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    at = 0
    by = defaultdict(list)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        by[i].append((len(ids), zlib.crc32(ids.tobytes())))
    found = defaultdict(list)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by.items()}


def test_block_round_trip():
    rng = np.random.default_rng(5)
    ids = [rng.zipf(1.2, n).clip(0, 70_000).astype("<u4") for n in (0, 1, 3, 4, 5000)] + [np.arange(70_000, dtype="<u4")]
    names = [None, 5, 6, -7, 2**40, 1]
    found = list(token_files.decode_block(token_files.encode_block(names, ids)))
    assert [n for n, _ in found] == names and all(np.array_equal(a, b) for a, (_, b) in zip(ids, found, strict=True))


# --- personal data ---

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and brute_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_personal_data(docs, texts):
    expected = []
    for i, t in texts:
        found = brute_spans(t)
        n = Counter(k for k, _, _ in found)
        expected.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    rows = pii.report(docs).collect()
    same_rows([r[:6] for r in rows], expected)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20


def test_more_personal_data_and_masks(spark):
    text = "bank DE89 3704 0044 0532 0130 00, DE89370400440532013001, 650-253-0000; write to a@b.de" + " " * 60 + "call (650) 253-0000"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, pii_x string")
    rows = pii.redact(docs).orderBy("doc_id").collect()
    assert rows[0].text == "bank [IBAN], DE89370400440532013001, 650-253-0000; write to [EMAIL]" + " " * 60 + "call [CALL]"
    assert rows[1].text is None and rows[2].text == "" and rows[0].pii_x == "x"
    first = pii.report(docs).orderBy("doc_id").first()
    assert first.spans.startswith("email:") and "iban:5:32" in first.spans and first.scores.startswith("1.00")


def test_long_runs_do_not_recurse(spark):
    docs = spark.createDataFrame([(1, "1" * 200_000), (2, "1-" * 50_000), (3, "a" * 200_000), (4, "1." * 20_000), (5, "+1" * 20_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_ip for r in pii.report(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 5000, 5: 0}


# --- byte-level BPE ---


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (200, 60), (64, 64)])
def test_byte_bpe(docs, texts, chunk, overlap):
    import tiktoken

    with open(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in texts:
        ids = own.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    found = bpe.encode_documents(docs, queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, chunk, overlap)
    same_rows(found.collect(), expected)


# --- language model ---


def test_language_model(docs, texts):
    words = lambda t: [*t.encode().lower().split(), b""]
    key = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7
    count = Counter(w for i, t in texts if key(i) != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    expected = {}
    for i, t in texts:
        w = words(t)
        expected.setdefault((i, len(w), sum(count[x] > 0 for x in w)), []).append(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    rows = lm.score_corpus(docs, head=500).collect()
    assert len(rows) == len(texts)
    found = defaultdict(list)
    for r in rows:
        assert r.train_tokens == n and r.held_out == (key(r.doc_id) == 2) and math.isfinite(r.score) and r.score <= 0
        found[r.doc_id, r.n_tokens, r.n_known].append(r.base_score)
    assert found.keys() == expected.keys() and all(np.allclose(sorted(found[k]), sorted(expected[k])) for k in found)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_by_brute_force(spark):
    """Each token's probability by loops: its class from the hashed rows of the words before, its share within the class."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.5, n) if k < 400) for n in rng.integers(0, 60, 60)] + ["", "W1 w1 unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm.count_words(docs).cache()
    model = lm.train(docs, lm.build_model(counts, 20))
    count = {bytes(r.word): r.c for r in counts.collect()}
    mask, scale = (1 << 64) - 1, len(model.weights) // sum(lm.ROWS)
    mixed = lambda h, salt: (h * 0x9E3779B97F4A7C15 + salt & mask) * 0xD6E8FEB86659FD93 % (1 << 64) >> 40

    def brute(text):
        words = [*text.lower().encode().split(), b""]
        codes = [0 if not w else model.ids.get(w, len(model.base) + zlib.crc32(w) % lm.RARE_CODES) for w in words]
        total = 0.0
        for i, (w, code) in enumerate(zip(words, codes, strict=True)):
            before = [codes[i - k] + 1 if i >= k else 0 for k in (1, 2, 3)]
            hashed = [mixed(h, k) for k, h in enumerate(before)] + [mixed((before[0] << 20) + before[1], 3)]
            rows = [h % (n * scale) + scale * sum(lm.ROWS[:k]) for k, (h, n) in enumerate(zip(hashed, lm.ROWS, strict=True))]
            z = model.bias.astype(float) + sum(model.weights[r].astype(float) for r in rows)
            head = code < len(model.base)
            own = model.classes[code] if head else lm.RARE
            within = model.within[code] if head else math.log10((count.get(w, 0) + 1) / (model.rare_n + model.rare_v + 1))
            total += (z[own] - math.log(np.exp(z).sum())) / math.log(10) + within
        return total

    found = {r.doc_id: r.score for r in lm.score(docs, counts, model).collect()}
    assert len(found) == len(texts) and len(model.ids) <= 20 and model.weights.any()
    assert np.allclose([found[k] for k in range(len(texts))], [brute(t) for t in texts], rtol=1e-4)


def test_words_within_classes_by_brute_force(spark, monkeypatch):
    """Of any context all head words of a class sum to one; they depend on the words before; a score is the sum of all choices, by loops."""
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(5)
    texts = [" ".join(x for k in rng.integers(0, 60, n) for x in (f"a{k}", f"b{k}")) for n in rng.integers(0, 60, 80)] + ["", "A1 b1 unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm.count_words(docs).cache()
    plain = lm.build_model(counts, 200)
    fresh = lm.with_words(plain)
    codes, ends, _ = plain.codes([t.encode() for t in texts])
    none = [np.zeros(len(codes), np.uint64)] * 4
    assert np.allclose(fresh.within_logs(codes, none), plain.within_logs(codes, none), atol=1e-4)
    model = lm.train(docs, fresh)
    assert model.fan_weights.any() and len(model.ids) > 100
    every = np.arange(len(model.classes))
    seen = []
    for before in ("", "a1", "a2", "b7 a7"):
        words, ends, _ = model.codes([before.encode()])
        hashed = [np.repeat(h[-1:], len(every)) for h in model.hashes(words, lm.places(ends), 0, len(words))]
        p = np.exp(model.within_logs(every, hashed))
        assert np.allclose([p[model.classes == k].sum() for k in np.unique(model.classes)], 1, atol=1e-4)
        seen.append(p)
    assert not np.allclose(seen[0], seen[1], atol=1e-3) and not np.allclose(seen[1], seen[2], atol=1e-3)
    count = {bytes(r.word): r.c for r in counts.collect()}
    salted = lambda h, salt: (h * 0x9E3779B97F4A7C15 + salt) * 0xD6E8FEB86659FD93 % (1 << 64) >> 40

    def brute(text):
        words, (own, ends, _) = [*text.lower().encode().split(), b""], model.codes([text.encode()])
        hashed = model.hashes(own, lm.places(ends), 0, len(own))
        classes = model.class_logs(model.class_rows(hashed)).astype(float)
        total, each = 0.0, len(model.fan_weights) // 4
        for i, (w, code) in enumerate(zip(words, own.tolist(), strict=True)):
            total += classes[i, model.classes[code] if code < len(model.base) else lm.RARE]
            if code >= len(model.base):
                total += math.log((count.get(w, 0) + 1) / (model.rare_n + model.rare_v + 1))
                continue
            for node, turn in zip(model.nodes[code].tolist(), model.turns[code].tolist(), strict=True):
                if node >= 0:
                    z = model.shares[node].astype(float) + sum(model.fan_weights[salted((int(h[i]) << 20) + node, k) % each + k * each].astype(float) for k, h in enumerate(hashed))
                    total += z[turn] - math.log(np.exp(z).sum())
        return total / math.log(10)

    found = {r.doc_id: r.score for r in lm.score(docs, counts, model).collect()}
    assert np.allclose([found[k] for k in range(len(texts))], [brute(t) for t in texts], rtol=1e-4)


def test_frequent_words_have_short_ways():
    """The mean number of choices within a class, by frequency, is at most one above the entropy in digits of FAN, and below that of a tree of equal depth."""
    rng = np.random.default_rng(2)
    c = np.sort(rng.zipf(1.3, 3000).clip(1, 10**6))[::-1].astype(float)
    classes = np.append(lm.END, rng.integers(0, 2, len(c)))
    mass = np.bincount(classes[1:], c)
    share = np.append(1, c / mass[classes[1:]])
    model = lm.with_words(lm.Model({}, np.zeros(3001), np.log10(share), classes, 9, 9, 0, 0, np.zeros(lm.N_CLASSES, np.float32), np.zeros((lm.n_rows(2), lm.N_CLASSES), np.float32)))
    steps = (model.nodes >= 0).sum(axis=1)
    assert steps[0] == 0
    for k in (0, 1):
        own = np.flatnonzero(classes == k)
        assert (share[own] * steps[own]).sum() <= 1 - (share[own] * np.log(share[own])).sum() / np.log(lm.FAN) and (share[own] * steps[own]).sum() < 2
        ways = {tuple(sorted((n, t) for n, t in zip(model.nodes[w].tolist(), model.turns[w].tolist(), strict=True) if n >= 0)) for w in own}
        assert len(ways) == len(own)
    assert np.allclose(model.within_logs(np.arange(3001), [np.zeros(3001, np.uint64)] * 4), np.log(share), atol=1e-3)


@pytest.mark.parametrize("named", [3, 900, 20_000])
def test_lm_steps_over_all_rows_or_some(named):
    """A feature most of whose rows are touched changes row after row, another row by row: with equal results, feature by feature."""
    rng = np.random.default_rng(named)
    sizes, weights = [256, 32_768], rng.normal(size=(33_024, 20)).astype(np.float32)
    steps = lm._Steps(weights, sizes)
    want, squares, used = weights.astype(float), np.zeros(weights.shape), np.zeros(len(weights), int)
    for _ in range(3):
        rows = np.stack([rng.integers(0, min(named, 256), 30_000), 256 + rng.integers(0, named, 30_000)]).T
        slope = rng.normal(size=(30_000, 20)).astype(np.float32)
        steps.add(rows, slope)
        for column in rows.T:
            n, g = np.bincount(column, minlength=len(weights)), np.zeros(weights.shape)
            np.add.at(g, column, slope)
            g /= np.sqrt(np.maximum(n, 1))[:, None]
            used, squares = used + n, squares + g * g
            want += lm.RATE * g / np.sqrt(1 + squares)
    assert (steps.used == used).all() and np.allclose(steps.weights, want, atol=1e-4) and np.allclose(steps.squares, squares, rtol=1e-3, atol=1e-4)
    assert not steps.sums.any() and steps.weights.ctypes.data % 64 == 0
    steps.add(np.zeros((0, 2), np.int64), np.zeros((0, 20), np.float32))
    assert (steps.used == used).all()


def test_lm_codes_of_words_that_are_known():
    texts = [b"b  A\x0bb c\n", b"", b" \t ", "\u00e9 a\0 B\x7f A".encode()]
    ids = {b"a": 1, b"nowhere": 2, b"b": 3}
    model = lm.Model(ids, np.zeros(4), np.zeros(4), np.array([lm.END, 0, 0, 0]), 9, 9, 0, 0, np.zeros(lm.N_CLASSES, np.float32), np.zeros((lm.n_rows(2), lm.N_CLASSES), np.float32))
    split = [t.lower().split() for t in texts]
    for own in (model, lm.replace(model, ids={})):
        codes, ends, words = own.codes(texts)
        want = [[*(own.ids.get(w, 4 + zlib.crc32(w) % lm.RARE_CODES) for w in ws), 0] for ws in split]
        assert codes.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert words.to_pylist() == sum(split, []) and words.dictionary.to_pylist()[: len(own.ids)] == list(own.ids)
        assert own.codes([])[0].tolist() == [] and own.codes([b""])[0].tolist() == [0]


def test_lm_ways_through_the_tree():
    """Only the choices that a word has, each with its node, the child taken and the hashed rows of its features."""
    rng = np.random.default_rng(1)
    c = rng.integers(1, 50, 400).astype(float)
    model = lm.with_words(lm.Model({}, np.zeros(401), np.log10(np.append(1, c / c.sum())), np.append(lm.END, np.zeros(400, int)), 9, 9, 0, 0, np.zeros(lm.N_CLASSES, np.float32), np.zeros((lm.n_rows(2), lm.N_CLASSES), np.float32)))
    codes, hashed = rng.integers(0, 450, 1000), [rng.integers(0, 1 << 24, 1000).astype(np.uint64) for _ in range(4)]
    each, want = len(model.fan_weights) // 4, []
    for t, code in enumerate(codes.tolist()):
        for level in range(model.nodes.shape[1] if code <= 400 else 0):
            if (node := int(model.nodes[code, level])) >= 0:
                rows = [int(lm._mixed((h[t : t + 1] << np.uint64(20)) + np.uint64(node), k)[0]) % each + k * each for k, h in enumerate(hashed)]
                want.append((t, node, int(model.turns[code, level]), *rows))
    token, node, turn, rows = model.ways(codes, hashed)
    assert list(zip(token.tolist(), node.tolist(), turn.tolist(), *rows.T.tolist(), strict=True)) == want and want


@pytest.mark.parametrize("named", [1, 7, 3000])
def test_lm_sums_of_slopes_by_row(named):
    rng = np.random.default_rng(named)
    column, slope = (rng.random(5000) ** 4 * named).astype(np.int64), rng.normal(size=(5000, 20)).astype(np.float32)
    rows, n, sums = lm.sums_by_row(column, slope)
    want = np.zeros((named, 20))
    np.add.at(want, column, slope)
    assert sorted(rows.tolist()) == np.unique(column).tolist() and (n == np.bincount(column)[rows]).all()
    assert np.allclose(sums, want[rows], atol=1e-3) and n[: (n > 1).sum()].min(initial=2) > 1


def test_lm_softmax_of_any_size():
    """Exponents beyond what float32 can raise are shifted first."""
    for top in (0, 200, -200):
        weights = np.array([[top, top - 1, top - 2]], np.float32)
        rows, bias = np.zeros((2, 1), np.int64), np.zeros((2, 3), np.float32)
        want = np.array([0, -1, -2]) - np.log(1 + np.exp(-1) + np.exp(-2))
        assert np.allclose(lm._softmax_logs(weights, rows, bias), want, atol=1e-4)
        assert np.allclose(lm._taken_logs(weights, rows, bias, np.array([2, 0])), want[[2, 0]], atol=1e-4)
        assert np.allclose(lm._slopes(weights, rows, bias, np.array([2, 0])), np.eye(3)[[2, 0]] - np.exp(want), atol=1e-4)


def test_lm_training_sends_weights_by_tokens_not_by_parts(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of text ', id % 9) AS text").repartition(40)
    cores = spark.sparkContext.defaultParallelism
    counts = lm.count_words(docs)
    model = lm.build_model(counts, 20)
    tasks = []
    monkeypatch.setattr(lm, "training_tasks", lambda rows, n, own=lm.training_tasks: tasks.append(own(rows, n)) or tasks[-1])
    assert np.isfinite(lm.train(docs, model).weights).all()
    assert tasks[0].rdd.getNumPartitions() == min(40, cores) and tasks[0].count() == lm._training(docs).count()
    monkeypatch.setattr(lm, "TASK_TOKENS", 1)
    assert lm.training_tasks(docs.select("text"), 10**6).rdd.getNumPartitions() == 40


def test_class_probabilities_sum_to_one():
    model = lm.Model({b"a": 1}, np.zeros(2), np.zeros(2), np.array([lm.END, 0]), 2, 2, 0, 0, np.zeros(lm.N_CLASSES, np.float32), np.random.default_rng(0).normal(size=(lm.n_rows(2), lm.N_CLASSES)).astype(np.float32))
    codes, ends, words = model.codes([b"A\t zz", b""])
    assert ends.tolist() == [3, 4] and codes[0] == 1 and codes[2] == codes[3] == 0 and words.to_pylist() == [b"a", b"zz"]
    assert np.allclose(np.exp(model.class_logs(model.rows(codes, lm.places(ends)))).sum(axis=1), 1, atol=1e-5)


def test_head_has_all_words_above_a_count(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1 + 300 // (k + 1)) for k in range(600)], "word binary, c long")
    number = {r.word: r.c for r in counts.collect()}
    for most in (0, 1, 50, 299, 600):
        found = {r.word for r in lm.head_of(counts, most).collect()}
        assert len(found) <= most and (not found or min(number[w] for w in found) > max([0, *(number[w] for w in number if w not in found)]))
    assert lm.head_of(counts, 600).count() == 600 and lm.head_of(counts, 50).count() > 40


def test_rows_are_put_and_words_listed_whole():
    rng = np.random.default_rng(5)
    for width in (16, 20):
        table, at, rows = np.zeros((50, width), np.float32), rng.permutation(50)[:20], rng.normal(size=(40, width)).astype(np.float32)[::2]
        want = table.copy()
        want[at] = rows
        lm.put_rows(table, at, rows)
        assert (table == want).all()
        lm.put_rows(table, at[:0], rows[:0])
        assert (table == want).all()
    words, _ = lm.words_column([b"a B a", "\u00e9\0 b".encode(), b""])
    assert lm.listed(words) == words.dictionary.to_pylist() == [b"a", b"b", "\u00e9\0".encode()]
    assert lm.listed(lm.words_column([b" "])[0]) == []


def test_slabs_and_steps_change_no_score(spark, sf_dir, monkeypatch):
    """Rows of weights and scores don't depend on how a worker cuts its texts."""
    rng = np.random.default_rng(1)
    model = lm.Model({f"w{k}".encode(): k + 1 for k in range(50)}, np.zeros(51), np.zeros(51), np.array([lm.END, *rng.integers(0, 18, 50)]), 9, 9, 0, 0, np.zeros(lm.N_CLASSES, np.float32), rng.normal(size=(lm.n_rows(2), lm.N_CLASSES)).astype(np.float32))
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, n)).encode() for n in (0, 1, 2, 500, 3, 70)]
    codes, ends, _ = model.codes(texts)
    place = lm.places(ends)
    whole = model.rows(codes, place)
    assert all((model.rows(codes, place, a, a + 37) == whole[a : a + 37]).all() for a in range(0, len(codes) - 37, 37))
    alone = np.concatenate([model.rows(*(lambda c, e, _: (c, lm.places(e)))(*model.codes([t]))) for t in texts])
    assert (alone == whole).all()
    b = lm.batch(lm.pa.schema([("text", lm.pa.binary())]), [texts])
    monkeypatch.setattr(lm, "SLAB_BYTES", 100)
    cut = [s.column(0).to_pylist() for s in lm.slabs(b, 0)]
    assert len(cut) == 4 and sum(cut, []) == texts and not list(lm.slabs(b.slice(0, 0), 0))


def test_language_model_of_nothing(spark):
    assert lm.score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- toxicity ---


def toxic_tables(spark, n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{k}" for k in rng.integers(0, 300, 60)]
        bad = i % 4 == 0
        if bad:
            for k in rng.integers(0, 60, 4):
                words[k] = "Vile!" if i % 8 else f"scum{k}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    rows = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        for s in filter(None, r.spans.split(",")):
            a, b = map(int, s.split(":"))
            assert text[r.doc_id][a:b].startswith(("Vile!", "scum"))


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = toxic_tables(spark, 200)
    turned = labels.selectExpr("doc_id", "cast(if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as int) toxic")
    score = lambda given: {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.train(docs, given)).collect()}
    assert score(labels) == score(turned)


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    """Texts are taken whole, of any length; one that fits no more is passed over, and the next rows of the class take its place."""
    rows = [(i, "x" * (5 if i % 3 else 50), i % 2) for i in range(200)]
    docs = spark.createDataFrame([*rows, (1, None, 0), (1, "y" * 5, 0)], "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_field", lambda texts, toxic, share: seen.append((texts, toxic)))
    for most, chars in ((10, 10**6), (200, 10**6), (200, 120)):
        toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), rows=most, chars=chars)
    train = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert sorted(seen[1][1]) == sorted(i % 2 for i in train) and all(len(t) in (0, 5, 50) for t in seen[1][0])
    assert seen[0][1].count(0) == seen[0][1].count(1) == 10
    for label in (0, 1):
        sizes = [len(t) for t, y in zip(*seen[2], strict=True) if y == label]
        assert 70 < sum(sizes) <= 120 and set(sizes) <= {0, 5, 50}


def test_toxicity_looks_at_all_labelled_rows(spark, monkeypatch):
    """The few short rows of a class are found behind any number of longer ones; a class without any is an error."""
    rows = [(i, "x" * (5 if i >= 380 else 50), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_field", lambda texts, toxic, share: seen.append(toxic))
    toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), rows=200, chars=10)
    assert sorted(seen[0]) == [0, 0, 1, 1]
    with pytest.raises(ValueError, match="toxic = 0"):
        toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), rows=200, chars=4)


def test_chains_change_little(monkeypatch):
    """Training over short chains finds the same tokens as over whole texts."""
    rng = np.random.default_rng(8)
    texts = [" ".join("vile" if i % 3 == 0 and k % 40 == 7 else f"w{x}" for k, x in enumerate(rng.integers(0, 500, 400))) for i in range(60)]
    found = []
    for chain in (16, 10_000):
        monkeypatch.setattr(toxicity, "CHAIN", chain)
        field = toxicity.fit_field(texts, [int(i % 3 == 0) for i in range(60)], 1 / 3)
        found.append([s > 0.5 for s in toxicity.score_texts(field, texts)[0]])
    assert found[0] == found[1] == [i % 3 == 0 for i in range(60)]


def test_toxicity_odd_texts(spark, docs, texts, sf_dir):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == len(texts) and all(r.score == 0 and r.predicted == 0 for r in rows)
    rows = toxicity.score_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)


def test_marginals_by_enumeration():
    field = toxicity.Field(np.zeros(toxicity.WEIGHTS, np.float32), 0.0, np.array([-0.7, 0.3, 0.9]), None, 0.0)
    emission, moves = [0.5, 3.0, 0.2, 1.5], {(0, 0): 1.0, (0, 1): math.exp(-0.7), (1, 0): math.exp(0.3), (1, 1): math.exp(0.9)}
    total, on = 0.0, np.zeros(4)
    for y in np.ndindex(2, 2, 2, 2):
        # the place before the first token counts as clean
        p = math.prod(e if s else 1.0 for e, s in zip(emission, y, strict=True)) * moves[0, y[0]] * math.prod(moves[a, b] for a, b in zip(y, y[1:], strict=False))
        total += p
        on += p * np.array(y)
    assert np.allclose(field.marginals(emission), on / total)


# --- winnowing ---


def brute_winnow(text, gram, window):
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    h = (winnow.gram_hashes(codes, gram) & np.uint64(0xFFFFFFFF)).tolist()
    w = min(window, len(h))
    return sorted({(h[k], k) for a in range(len(h) - w + 1) for k in [min(range(a, a + w), key=lambda x: (h[x], -x))]}, key=lambda x: x[1])


@pytest.mark.parametrize("runs", [1, 7, None])
def test_winnowing(docs, texts, runs):
    named = [(i, t) for i, t in texts if i is not None]
    ids = Counter(i for i, _ in named)
    rows = winnow.fingerprint_with_next(docs, 5, 8, runs).collect()
    assert len(rows) == len(texts)
    order = sorted({i for i, n in ids.items() if n == 1}, reverse=True)
    text = dict(named)
    every = sorted(ids, reverse=True)
    lookup = defaultdict(list)
    for r in rows:
        lookup[r.doc_id].append(r)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in order:
        (r,) = lookup[i]
        at = every.index(i)
        if at + 1 == len(every) or ids[every[at + 1]] > 1:
            continue  # followed by rows without an id, or by equal ids
        own, following = text[i], text[every[at + 1]]
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        a, b, c = (brute_winnow(t, 5, 8) for t in (own, changed, following))
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(",".join(f"{h:x}:{p}" for h, p in x) for x in (a, b))
        sets = [{h for h, _ in x} for x in (a, b, c)]
        assert (r.near_edited, r.near_next) == pytest.approx((jaccard(sets[0], sets[1]), jaccard(sets[0], sets[2])))


def test_winnowing_wraps_and_guarantees(spark):
    docs = spark.createDataFrame([(3, "abcdef"), (2, "xy"), (1, "123456")], "doc_id long, text string")
    edits = {r.doc_id: r.edited_sha256 for r in winnow.fingerprint_with_next(docs).collect()}
    assert edits == {3: hashlib.sha256(b"abcxy").hexdigest(), 2: hashlib.sha256(b"x1").hexdigest(), 1: hashlib.sha256(b"123abc").hexdigest()}
    rng = np.random.default_rng(4)
    shared = "".join(map(chr, rng.integers(97, 123, winnow.GRAM + winnow.WINDOW - 1)))
    a, b = ("".join(map(chr, rng.integers(97, 123, n))) + shared + "tail" for n in (500, 777))
    assert set(winnow.winnow(a)[0].tolist()) & set(winnow.winnow(b)[0].tolist())
    assert not winnow.fingerprint_with_next(docs.limit(0)).count()


def test_winnowing_of_short_texts(spark):
    """A text of 100 code points keeps several fingerprints, and a half copy of it shares some."""
    rng = np.random.default_rng(10)
    docs = spark.createDataFrame([(k, "".join(map(chr, rng.integers(97, 123, 100)))) for k in range(50)], "doc_id long, text string")
    rows = winnow.fingerprint_with_next(docs).collect()
    assert all(r.fingerprint.count(",") >= 4 and 0 < r.near_edited < 1 for r in rows)


# --- media ---


def test_media(docs, texts):
    rows = media.media_features(media.to_media(docs)).collect()
    expected = []
    for i, t in texts:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        stored = out.getvalue()
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    same_rows([r[:7] for r in rows], expected)
    by = defaultdict(set)
    for r in rows:
        by[r.payload_sha256].add(r.feature)
    assert all(len(x) == 1 for x in by.values())


def test_feature_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (64, 256, 300, 256 * 9, 256 * 40 + 17):
        samples = rng.integers(0, 256, n).astype(np.uint8)
        samples[: n // 2] = (128 + 90 * np.sin(np.arange(n // 2) * 0.9)).astype(np.uint8)
        found = []
        for t in range(max(1, -(-(n - media.FRAME) // media.HOP) + 1)):
            frame = np.zeros(media.FRAME)
            part = samples[t * media.HOP : t * media.HOP + media.FRAME].astype(float) - 128
            frame[: len(part)] = part
            size = np.abs(np.fft.rfft(frame * np.hanning(media.FRAME)))
            for a, b in zip(media.BANDS, media.BANDS[1:], strict=False):
                k = a + int(size[a:b].argmax())
                if size.mean() > 0 and size[k] >= media.STRONG * size.mean():
                    found.append((t, k))
        pairs = sorted((t, f << 12 | g << 4 | u - t) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 1 + media.PAIRS] if u - t <= media.REACH)
        last, out = 0, []
        for t, code in pairs:
            out.append(f"{t - last}:{code:x}")
            last = t
        assert media.feature_string(samples) == ",".join(out)


def test_peaks_of_a_tone():
    t = np.arange(media.FRAME * 6)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8)
    frames, bins = media.peaks(tone)
    assert set(bins.tolist()) & {19, 20, 21} and len(set(frames.tolist())) >= 5
    times, codes = media.pair_codes(tone)
    assert len(times) == len(codes) > 0


def test_slabs_change_nothing(monkeypatch):
    samples = np.random.default_rng(6).integers(0, 256, 100_000).astype(np.uint8)
    whole = media.feature_string(samples)
    monkeypatch.setattr(media, "SLAB", 4096)
    assert media.feature_string(samples) == whole != ""


# --- all operators ---


def test_empty_tables(spark, tmp_path):
    """Every operator gives an empty table, with its columns, for an empty one."""
    docs = spark.createDataFrame([], "doc_id long, text string, n long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    token_files.write_token_files(docs, str(tmp_path / "t"), queries.byte_encoder(queries.tokenizer_path("byte_bpe_50k.json")))
    made = [
        simhash.near_duplicates(docs),
        simhash.one_of_each(docs, **simhash.NEAR_COPIES),
        packing.pack_documents(docs, queries.word_encoder(queries.tokenizer_path("word_bpe_49k.json"))),
        token_files.read_token_files(spark, str(tmp_path / "t")),
        pii.report(docs),
        pii.redact(docs),
        bpe.encode_documents(docs, queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        lm.score_corpus(docs),
        toxicity.score_documents(docs, toxicity.train(docs, labels)),
        toxicity.without_toxic(docs, toxicity.train(docs, labels)),
        winnow.fingerprint_with_next(docs),
        media.media_features(media.to_media(docs)),
    ]
    assert all(m.isEmpty() and len(m.columns) >= 3 for m in made)


#: The columns that each contract names.
CONTRACT = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_html": "page_id url text n_chars",
    "op3_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_token_files": "doc_id start n_tokens ids_crc32",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_winnowing": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, sf_dir, name):
    """Each registered query over its whole table: the contract's columns, and each row's id (packing: each piece's)."""
    found = queries.QUERIES[name](spark, sf_dir)
    assert found.columns[: len(CONTRACT[name].split())] == CONTRACT[name].split()
    table, key = ("pages", "page_id") if name == "op2_html" else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()]
    rows = found.filter("piece = 0") if name == "op3_packing" else found
    assert Counter(r[0] for r in rows.select(key).collect()) == Counter(ids)
