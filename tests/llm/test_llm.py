"""Each operator against brute force, and its defined results on nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagewright.llm import bwt, components, fingerprint, html_text, masked_lm, minhash, packing, quality, sharding, suffix_dedup, token_files, transducer
from pagewright.llm.common import PrefixHash, shared_folder, table, words_of
from pagewright.llm.vocab import byte_level_encoder, library_byte_ids, library_word_ids, read_ranks, word_encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, text_crc32 string"
ODD = [(3, None, "a", "x"), (1, "", None, "x"), (1, "one two", "a", None), (1, "one two", "a", None), (None, "null id", "b", "x"), (7, "é" * 3000 + " ß", "b", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").toPandas().sort_values("doc_id")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_prefix_hash_and_words():
    data = np.frombuffer("ab  abé\tx\nab".encode(), np.uint8)
    start, end, row = words_of(data, np.array([0, 5, 5, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["ab", "a", "bé", "x", "ab"] and row.tolist() == [0, 0, 2, 2, 2]
    h = PrefixHash(data)(start, end)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


# 1 fingerprints


def slow_ends(b):
    seen, i, out = set(), 0, []
    for j in range(1, len(b) + 1):
        if b[i:j] not in seen:
            seen.add(b[i:j])
            out.append(j)
            i = j
    return out


def test_phrases():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(60))) for _ in range(2))
        assert fingerprint.phrase_ends(a, set(), 0) == slow_ends(a)
        cut = rng.randrange(len(a) + 1)
        assert fingerprint._with_edit(a, a[:cut] + b, cut) == (slow_ends(a), slow_ends(a[:cut] + b))


def test_fingerprints(spark, docs):
    got = fingerprint.op1_lz_fingerprint(spark, SF).toPandas().sort_values("doc_id")
    texts = docs.text.tolist()
    for r, t, nxt in zip(got.itertuples(), texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = (t[: len(t) - half] + nxt[:half]).encode()
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited).hexdigest())
        own, changed, after = fingerprint.signatures([t.encode(), edited, nxt.encode()], [slow_ends(x) for x in (t.encode(), edited, nxt.encode())])
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint._hex(own), fingerprint._hex(changed))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, changed), fingerprint.likeness(own, after))
    assert got.near_edited.mean() > got.near_next.mean() + 0.1


def test_fingerprints_of_odd_rows(odd):
    got = fingerprint.fingerprinted(odd).toPandas()
    assert len(got) == len(ODD) and got.doc_id.isna().sum() == 1 and set(got[got.n_chars == 0].fingerprint) == {""}
    assert got[got.n_chars == 7].fingerprint.nunique() <= 2 and fingerprint.fingerprinted(odd.filter("false")).count() == 0


# 2 packing, 3 token files


def test_taken_is_the_least_virtual_times():
    rng = np.random.default_rng(2)
    for _ in range(30):
        totals = rng.integers(0, 40, 4)
        weights = rng.integers(1, 9, 4)
        order = sorted(((2 * j + 1) / (2 * w), q) for q, (t, w) in enumerate(zip(totals, weights)) for j in range(t))
        x = np.arange(totals.sum() + 1)
        got = packing.taken(x, totals, weights)
        for n in x:
            assert got[n].tolist() == [sum(q == i for _, q in order[:n]) for i in range(4)]


def test_packing(spark, docs):
    got = packing.op2_packing(spark, SF).toPandas()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in docs[["doc_id", "text"]].itertuples(index=False):
        ids = tokens.encode(t, add_special_tokens=False).ids + [0]
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    sizes, upto = [], 0
    shares = got.groupby("source").length.sum() / got.length.sum()
    for n, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
        sizes.append(s.length.sum())
        upto = upto + s.groupby("source").length.sum().reindex(shares.index, fill_value=0)
        if n < got.sequence_id.max() - 1:  # a quantum is 64 tokens; what is short of one is carried on, so no window adds to it
            assert (upto - 1024 * (n + 1) * shares).abs().max() < 64 * (1 + 20 * shares.max() / 2)
    assert set(sizes[:-1]) == {1024}


def pieces_by_force(docs, weights, window):
    """One run after another, by the deficits; docs: (queue, tokens). Document, start, length, window, offset."""
    queues = collections.defaultdict(list)
    for d, (q, n) in enumerate(docs):
        queues[q] += [(d, i) for i in range(n)]
    quantum = window // 16
    runs = sorted(((2 * j + 1) / (2 * weights[q]), q, j) for q, held in queues.items() for j in range(len(held) // quantum))
    stream = []
    for i in range(0, len(runs), 16):
        for _, q, j in sorted(runs[i : i + 16], key=lambda r: r[1:]):
            stream += queues[q][j * quantum : (j + 1) * quantum]
    for q in sorted(queues):
        stream += queues[q][len(queues[q]) // quantum * quantum :]
    out = []
    for place, (d, i) in enumerate(stream):
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == i and place % window:
            out[-1][2] += 1
        else:
            out.append([d, i, 1, place // window, place % window])
    return sorted(map(tuple, out))


def test_pieces_by_force(monkeypatch):
    rng = random.Random(12)
    for count in (1, 2, 5, 60):
        for cells in (1 << 20, 100):
            monkeypatch.setattr(packing, "CELLS", cells)
            docs = [(rng.randrange(count), rng.choice((1, 2, 30, 200))) for _ in range(120)]
            totals = np.bincount([q for q, _ in docs], [n for _, n in docs], count).astype(np.int64)
            upto, at = [0] * count, []
            for q, n in docs:
                at.append(upto[q])
                upto[q] += n
            for weights in (np.maximum(totals, 1.0), np.array([1.0 + i % 4 for i in range(count)])):
                p = packing.pieces_of(np.array([q for q, _ in docs]), np.array(at), np.array([n for _, n in docs]), totals, weights, 64)
                got = sorted(zip(*(p[k].tolist() for k in ("doc", "start", "length", "sequence_id", "offset"))))
                assert got == pieces_by_force(docs, weights, 64)


def test_packing_of_many_sources(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice((5, 5, 40, 300)))), rng.choice([None, *map(str, range(40))])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "doc_id")
    got = packing.packed(frame, public_tokenizers.path("byte_bpe_50k.json"), window=64, weights={str(i): float(1 + i % 4) for i in range(40)}).toPandas()
    assert got.source.isna().any() and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all() and got.doc_id.nunique() == 150
    for n, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and (s.length.sum() == 64 or n == got.sequence_id.max())


def test_token_files(spark, docs, odd):
    got = token_files.op3_token_files(spark, SF).toPandas().sort_values("doc_id")
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    base = 0
    for r, t in zip(got.itertuples(index=False), docs.text):
        ids = tokens.encode(t, add_special_tokens=False).ids + [1]
        assert tuple(r)[1:] == (base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        base += len(ids)
    for rows, n in ((odd, len(ODD)), (odd.filter("false"), 0)):
        folder = shared_folder(spark)
        back = token_files.read_token_files(spark, folder, token_files.write_token_files(rows, folder, public_tokenizers.path("word_bpe_49k.json"))).toPandas()
        assert len(back) == n and sorted(back.start) == sorted(np.cumsum([0, *back.sort_values("start").n_tokens])[:-1])
    assert packing.packed(odd, public_tokenizers.path("byte_bpe_50k.json")).count() >= len(ODD)
    assert packing.packed(odd.filter("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


TEXTS = ["", "  ", "it's IT'S 'sun a'b 'll", "日本語テキスト12３4½²", "😀😀 a😀b 𝒜", "a\x1cb c\x85d e", "x" * 3000, "ab" * 500, "a,b.c;;d 1,2", "<|endoftext|> </w>", "ΣΑΣ ὈΔΥΣΣΕΎΣ İ"]


def test_encoders_equal_the_library():
    for name, make in (("byte_bpe_50k.json", byte_level_encoder), ("word_bpe_49k.json", word_encoder)):
        tokens = Tokenizer.from_file(public_tokenizers.path(name))
        tokens.encode_special_tokens = True
        ours = make(public_tokenizers.path(name))
        for t in TEXTS:
            assert ours(t) == tokens.encode(t, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark):
    marked = [*TEXTS, "hello <|endoftext|> world", "<|startoftext|>a<|ENDOFTEXT|>", "it's \u1c89\ua7cb", "Über naïve cafés"]
    for name, make in (("byte_bpe_50k.json", library_byte_ids), ("word_bpe_49k.json", library_word_ids)):
        tokens = Tokenizer.from_file(public_tokenizers.path(name))
        assert [make(public_tokenizers.path(name))(t) for t in marked] == [tokens.encode(t, add_special_tokens=False).ids for t in marked]
    rows = spark.createDataFrame([(1, "hello <|endoftext|> world", "a")], "doc_id long, text string, source string")
    (piece,) = packing.packed(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert (piece.doc_tokens, piece.ids_crc32) == (5, zlib.crc32(np.array([31373, 220, 50256, 995, 0], "<u4").tobytes()))
    folder, path = shared_folder(spark), public_tokenizers.path("word_bpe_49k.json")
    (row,) = token_files.read_token_files(spark, folder, token_files.write_token_files(rows, folder, path)).collect()
    assert row.n_tokens == 4


# 4 pages


def test_longest_common_subsequence():
    rng = random.Random(3)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(10))] for _ in range(2))
        assert len(html_text.shared_lines(a, b)) == length(a, b)


def test_articles_keep_what_their_words_name():
    page = """<body><div class="top-banner">Ad</div><h2 id="related-work">Above</h2><div id="comments"><p>First!</p></div><article class="with-comments"><h1>T</h1>
    <h2 id="comments-on-the-treaty">On the treaty</h2><p>Body</p><h2 id="related-work">Related</h2><p class="notice">A notice of 1848</p>
    <section id="advertising"><p>Advertising grew.</p></section><div class="related-ideas"><p>Ideas</p></div><ul class="menu"><li>Soup</ul><p id="ad">Anno</p>
    <div class="box ad">Buy</div><div class="comments"><p>Me too</p></div><aside>Aside</aside><div role="navigation">Next</div><nav>Nav</nav></article></body>"""
    told = html_text.page_blocks(page)
    kept = [t for t, kind in told if kind == html_text.KEPT]
    assert kept == ["T", "On the treaty", "Body", "Related", "A notice of 1848", "Advertising grew.", "Ideas", "Soup", "Anno"]
    assert [t for t, kind in told if kind == html_text.OPEN] == ["Above"]


def test_pages(spark):
    rows = [
        (1, "http://a/x/1", "<body><div>Site menu</div><p>Own one</p><div class='comments'>c</div><p>All rights</p></body>"),
        (2, "http://a/x/2", "<body><div>Site menu</div><p>Own &amp two&nbsp; x<script>z</script></p><p>All rights</p>"),
        (3, "http://b/", "<p>solo<form>f<input></form> tail"),
        (4, None, None),
        (5, "http://a/y", '<article><header><h1>T</h1></header>a<div class="ad-box">buy</div><b>b</article><section id=comments>no</section>'),
        (None, "http://a/y", ""),
        (6, "http://a/z", "<nav>n</nav><article><p>same</p></article>"),
        (7, "http://a/z/1", "<article><p>same</p><!-- <p>x</p> --></article><footer>f"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(frame).collect()}
    want = {1: "Own one", 2: "Own & two x", 3: "solo\ntail", 4: "", 5: "T\na\nb", None: "", 6: "same", 7: "same"}
    assert got == {k: (t, len(t)) for k, t in want.items()}
    assert html_text.extracted(frame.filter("false")).count() == 0


def test_pages_against_copies_and_articles(spark):
    plain = "<body><div>Menu</div><p>The whole story, told twice</p></body>"
    story = lambda own: f"<article><p>{own * 9}</p><p>Share this story</p></article>"
    rows = [(1, "http://a/p?id=1", plain), (2, "http://a/p?id=2", plain), (3, "http://b/1", story("one ")), (4, "http://b/2", story("two "))]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Menu\nThe whole story, told twice"  # copies don't empty each other
    for page, own in ((3, "one "), (4, "two ")):  # an article keeps what others hold as well
        assert got[page] == (own * 9).strip() + "\nShare this story"


def test_articles_are_differenced(spark):
    """Inside articles, shared lines go by whole containers with a mark that the neighbour's article holds as well."""
    page = lambda own, box="", last="": f"<article><h1>Title {own}</h1><p>{f'{own} ' * 40}</p><p>A sentence of many articles</p>{box}{last}</article>"
    share = '<ul class="share-links"><li>Share this</li><li>Print</li></ul>'
    menu = lambda own: f'<div class="menu"><p>Soup</p><p>{own}</p></div>'
    rows = [
        (1, "http://a/1", page("one", share)),
        (2, "http://a/2", page("two", f'<div class="no-sidebar"><p>Two again</p>{share}</div>', share.replace("class", "id"))),
        (3, "http://b/1", page("one", menu("Fish"))),  # not shared whole
        (4, "http://b/2", page("two", menu("Bread"))),
        (5, "http://c/1", page("one", share)),
        (6, "http://c/2", page("two", share.replace(' class="share-links"', ""))),  # no mark there
        (7, "http://d/1", page("one", share)),  # no neighbour
        (8, "http://e/1", page("one", share)),  # copies tell nothing
        (9, "http://e/1?again", page("one", share)),
        (10, "http://f/1", page("one", '<h2 class="related" id="related">Related work</h2>')),  # no container
        (11, "http://f/2", page("two", '<h2 class="related" id="related">Related work</h2>')),
    ]
    got = {r.page_id: r.text.split("\n")[3:] for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    boxed = ["Share this", "Print"]
    assert got == {1: [], 2: ["Two again", *boxed], 3: ["Soup", "Fish"], 4: ["Soup", "Bread"], 5: boxed, 6: boxed, 7: boxed, 8: boxed, 9: boxed, 10: ["Related work"], 11: ["Related work"]}


def test_pairing_of_pages_by_force(spark):
    """Neighbours, agreements and copies, page by page; ties (two rows of one url and id, equal agreements) included."""
    rng = random.Random(21)
    pool = [f"<div>Line {i}</div>" for i in range(6)]
    rows = []
    for i in range(160):
        body = "".join(rng.sample(pool, 3)) + "".join(f"<p>own text {i if rng.random() < 0.8 else 7} {j}</p>" for j in range(rng.randrange(4)))
        path = "/".join(rng.choice(["a", "ab", "b", "news", "x"]) for _ in range(rng.randrange(4)))
        rows.append((i, rng.choice([f"http://h{rng.randrange(3)}/{path}", f"http://h1/{path}?id={i}", None, "http://["]), body))
    rows += [(200, "http://h0/same", pool[0] + "<p>twice</p>"), (200, "http://h0/same", pool[0] + "<p>twice</p>")]
    parsed = sorted(((html_text._key(u, i), [t for t, _ in html_text.page_blocks(h)], i, html_text.page_blocks(h)) for i, u, h in rows), key=lambda r: r[:2])
    want = []
    for at, (key, _, i, blocks) in enumerate(parsed):
        beside = [(html_text._agreement(key, parsed[n][0]), n < at, parsed[n][3]) for n in (at + 1, at - 1) if 0 <= n < len(parsed)]
        beside = sorted((x for x in beside if x[0] >= 0), key=lambda x: (-x[0], x[1]))  # the next one first, of equals
        want.append((i, html_text.main_text(blocks, [x[2] for x in beside])))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = sorted((r.page_id, r.text) for r in html_text.extracted(frame).collect())
    assert got == sorted(want)
    assert any(t and "Line" not in t for _, t in got) and any("Line" in t for _, t in got)


# 5 repeated strings


def repeats_by_force(rows, length=100):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                hit[j : j + length] = b"\1" * length
            else:
                seen.add(b[j : j + length])
        out.append((d, len(b), sum(hit), hit.count(b"\0\1") + (hit[:1] == b"\1"), hashlib.sha256(bytes(x for x, c in zip(b, hit) if not c)).hexdigest()))
    return out


def test_merged_transforms():
    rng = random.Random(4)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))]
        depth, where = rng.randrange(1, 9), collections.defaultdict(list)
        for i, s in enumerate(strings):
            for j in range(len(s) - depth + 1):
                where[s[j : j + depth]].append((i, j))
        got = sorted(sorted(zip(a.tolist(), b.tolist())) for a, b in bwt.repeated(strings, depth, rng.randrange(1, 4)))
        assert got == sorted(v for v in where.values() if len(v) > 1)


def test_repeated_strings(spark, docs, monkeypatch):
    got = suffix_dedup.op5_suffix_dedup(spark, SF).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == repeats_by_force(docs[["doc_id", "text"]].itertuples(index=False, name=None))
    monkeypatch.setattr(suffix_dedup, "CROWDED", 5)  # the finer keys as well
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, short = words(40), words(12)
    rows = [(None, ""), (1, long + " é" * 80), (1, long + "é"), (1, long + "é"), (2, None), (3, words(30) + long + words(30)), (4, "a" * 500), (5, "ab" * 300 + long)]
    rows += [(10 + i, words(20) + short + words(20)) for i in range(20)] + [(50 + i, words(20) + long + short + words(20)) for i in range(20)]
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: [-1 if x is None else x for x in r]
    assert sorted(map(tuple, suffix_dedup.reported(frame).collect()), key=key) == sorted(repeats_by_force(rows), key=key)
    kept = suffix_dedup.deduplicated(frame).toPandas()
    assert list(kept.columns) == ["doc_id", "text"] and 2 in set(kept.doc_id)
    assert suffix_dedup.reported(frame.filter("false")).count() == 0


def test_repeated_strings_of_hot_keys(spark, monkeypatch):
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line, passage = words(19), words(60)
    rows = [(i, words(12) + " " + line + " " + words(12)) for i in range(60)] + [(100 + i, words(9) + passage + words(9)) for i in range(30)]
    rows += [(200 + i, passage) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot, crowded in ((4, 10**6), (4, 5), (10**6, 5)):
        for name, value in (("HOT", hot), ("SAMPLE", 1), ("CROWDED", crowded)):
            monkeypatch.setattr(suffix_dedup, name, value)
        assert (len(suffix_dedup._hot_keys(frame.select(frame.doc_id.alias("d"), "text"))) > 0) == (hot == 4)
        assert sorted(map(tuple, suffix_dedup.reported(frame).collect())) == repeats_by_force(rows)


def test_recurring_windows():
    rng = random.Random(18)
    text = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    shared = text(130)
    strings = [text(59) + b"w" + shared + b"x" + text(59), text(29) + b"y" + shared + b"z" + text(89), text(300)]
    of, begin, runs = suffix_dedup.recurring_windows(strings)
    assert (of.tolist(), begin.tolist(), runs) == ([0, 1], [60, 30], [shared] * 2)


CLASHING = ["d", "null", "__marks", "__range", "__w", "__h", "__l", "__g", "kept", "n_words", "removed_lines", "line", "u0", "part", "queue", "id", "h"]


def clashing(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


def test_columns_with_clashing_names(spark, odd):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + "\nthe same line here", "h") for i in range(12)]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for made in (quality.cleaned(frame), suffix_dedup.deduplicated(frame)):
        assert made.columns == frame.columns and made.count() == 12
        assert all(r[c] == f"{c}{r.doc_id}" for r in made.collect() for c in CLASHING)
    assert {r["part"] for r in quality.judged(frame).collect()} == {f"part{i}" for i in range(12)}
    pages = clashing(spark.createDataFrame([(1, "http://a/x", "<p>one</p>")], "doc_id long, url string, html string"))
    assert html_text.extracted(pages, "doc_id").first().text == "one"
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    folder = shared_folder(spark)
    for made in (
        fingerprint.fingerprinted(frame), packing.packed(frame, byte), transducer.encoded(frame, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), minhash.near_duplicates(frame),
        sharding.sharded(frame, 2), masked_lm.scored(frame), token_files.read_token_files(spark, folder, token_files.write_token_files(frame, folder, word)), suffix_dedup.reported(frame),
    ):
        assert {r.doc_id for r in made.collect()} == set(range(12))


def test_null_texts_stay_null(spark):
    frame = spark.createDataFrame([(1, None, 5), (None, "a", 6)], "doc_id long, text string, n long")
    assert sorted(map(str, suffix_dedup.deduplicated(frame).collect())) == sorted(map(str, frame.collect()))


def test_very_long_texts(spark):
    rng = random.Random(19)
    words = [f"w{rng.randrange(3000)}" for _ in range(150_000)]
    long = " ".join(words)
    rows = [(1, long, "a"), (2, " ".join(words[:-5]) + " the end", "b"), (3, "short", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = [len(t) for _, t, _ in rows]
    assert [r.n_chars for r in fingerprint.fingerprinted(frame).orderBy("doc_id").collect()] == size
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(tokens.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows]
    pieces = packing.packed(frame, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert pieces.groupby("doc_id").length.sum().tolist() == n and pieces.groupby("sequence_id").length.sum().max() == 1024
    got = {r.doc_id: r for r in suffix_dedup.reported(frame).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > size[1] - 120 and got[2].n_spans == 1
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()}
    assert near == classes_by_force([r[:2] for r in rows], 5)
    assert {r.doc_id: r.n_words for r in quality.judged(frame).collect()} == {1: 150_000, 2: 149_997, 3: 1}
    assert {r.doc_id: r.size for r in sharding.sharded(frame, 2).collect()} == {i + 1: x + 1 for i, x in enumerate(size)}
    assert {r.doc_id: r.n_words for r in masked_lm.scored(frame).collect()} == {1: 150_000, 2: 149_997, 3: 1}
    page = spark.createDataFrame([(1, "http://a/", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert html_text.extracted(page).first().n_chars == size[0]


# 6 transducer


def test_transducer():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = transducer.encoder(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice(["th", "er", "an", " ", "é", "tion", "1", "語"]) for _ in range(200)) for _ in range(50)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == library.encode_ordinary(t) and transducer.decoded(ours.decode(ids)) == "".join(ours.decoder.pieces(ids)) == t


def test_transducer_on_one_long_word(monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rng = random.Random(20)
    drawn = "".join(rng.choice(["th", "er", "an", "tion", "in", "st", "é"]) for _ in range(2_000))
    for text in (drawn * 250, "a" * 1_000_000):  # a word of a million letters
        assert transducer.encoder(path).encode(text) == library.encode_ordinary(text)
    random_word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))
    monkeypatch.setattr(transducer, "MAX_STATES", 1000)  # tables are dropped inside a word
    assert transducer.encoder(path).encode(random_word) == library.encode_ordinary(random_word)


def test_streaming_decoder():
    rng = random.Random(7)
    drawn = [bytes(rng.choice([0x41, 0x80, 0xBF, 0xC0, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xE8, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF]) for _ in range(rng.randrange(12))) for _ in range(300)]
    for data in ["aé語😀".encode() * 3, b"\xff\xc3(\xe8\xaa", b"\xf0\x9f\x98", b"\x80\x80a\xe8", *drawn]:
        for _ in range(20):
            stream, out, i = transducer.Utf8Stream(), "", 0
            while i < len(data):
                n = rng.randrange(1, 4)
                out += stream.feed(data[i : i + n])
                i += n
            assert out + stream.close() == data.decode("utf-8", "replace")


def test_decoder_of_any_tokens(monkeypatch):
    """Streams of tokens that cut characters, or are no text, with arcs that are dropped now and then."""
    rng = random.Random(12)
    whole = "a é 漢 😀 \u0000 ﷽".encode()
    token = {i: bytes(rng.choice([whole[j : j + rng.randrange(1, 5)] for j in range(len(whole))] + [b"\xff", b"\xed\xa0", b"\xf4\x90", b"\xc3"])) for i in range(60)}
    for arcs, piece in ((10**6, 7), (40, 1), (1, 4096)):
        monkeypatch.setattr(transducer, "MAX_ARCS", arcs)
        monkeypatch.setattr(transducer, "_PIECE", piece)
        decoder = transducer.Decoder(token)
        for n in (0, 1, 7, 14, 300):
            for _ in range(30):
                ids = [rng.randrange(60) for _ in range(n)]
                data = b"".join(token[i] for i in ids)
                assert "".join(decoder.pieces(iter(ids))) == data.decode("utf-8", "replace")


def test_transducer_query(spark, docs, odd):
    import tiktoken

    got = transducer.op6_bpe_transducer(spark, SF).toPandas().set_index("doc_id")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    for i, t in docs[["doc_id", "text"]].itertuples(index=False):
        ids = library.encode_ordinary(t)
        assert got.loc[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert (got.loc[i].n_tokens, got.loc[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert transducer.encoded(odd, path).count() == len(ODD) and transducer.encoded(odd.filter("false"), path).count() == 0


# 7 near-duplicates


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (20, 20)]
    got = {r.v: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20}


def classes_by_force(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs):
    rows = list(docs[["doc_id", "text"]].itertuples(index=False, name=None))
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(60):  # near copies of a text that is there, most of which are closer to it than to each other
        w = list(base)
        for j in rng.sample(range(120), rng.randrange(12)):
            w[j] = f"x{i}_{j}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, "A b"), (20_001, "a  B"), (20_002, " "), (20_003, None), (20_004, "a")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes_by_force(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(odd):
    got = minhash.near_duplicates(odd, size=2)
    assert got.count() == len(ODD) and minhash.near_duplicates(odd.filter("false"), size=2).count() == 0


# 8 quality rules


def test_quality_rules(spark, docs, odd):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = quality.op8_quality_rules(spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({quality.SQL})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
    assert quality.judged(odd).filter("kept").count() == 0 and quality.judged(odd).count() == len(ODD) and quality.judged(odd.filter("false")).count() == 0


def test_boilerplate_lines(spark):
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, f"The  SAME line\n{own(i)}\nsame tail", "h") for i in range(20)] + [(100 + i, f"{own(500)}\n{own(501)}", "h") for i in range(20)]
    rows += [(200 + i, "\n".join(["the same line " * 20, "filler " + str(i)]), "g") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in quality.cleaned(frame).collect()}
    assert {i for i in kept if i < 200} == {r[0] for r in rows if r[0] < 200}  # copies don't condemn each other
    assert kept[3] == own(3) and kept[100] == rows[20][1]


def test_template_lines(spark):
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    template = [f"template line {k}" for k in range(10)]
    rows = [(i, "\n".join([*template[:5], own(i), *template[5:]]), "h") for i in range(12)]
    got = {r.doc_id: r.text for r in quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: own(i) for i in range(12)}  # each own line makes a document of its own


# 9 sharding


def test_sharding(spark, docs, odd):
    got = sharding.op9_sharding(spark, SF).toPandas()
    texts = docs.set_index("doc_id").text
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.rename(columns={"size": "size"}).itertuples(index=False))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and (sums - sums.mean()).abs().max() <= got["size"].max()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    hot = spark.createDataFrame([(i, "copy " * 20) for i in range(400)] + [(1000 + i, f"t{i}" * 30) for i in range(50)], "doc_id long, text string")
    sums = sharding.sharded(hot, 8).toPandas().groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 300
    assert sharding.sharded(odd, 4).count() == len(ODD) and sharding.sharded(odd.filter("false"), 4).count() == 0


def places_by_force(rows, shards):
    """(shard, slot) of each row, one after another; rows: (id, text, hash)."""
    size = lambda r: len(r[1].encode()) + 1
    total, groups, out = sum(map(size, rows)), collections.defaultdict(list), {}
    for r in rows:
        groups[r[2]].append(r)
    heavy = {h: sum(map(size, g)) for h, g in groups.items() if len(g) > 1 and sum(map(size, g)) * shards * sharding.HEAVY > total}
    room = [total / shards] * shards
    for h, n in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        left = list(groups[h])
        while left:
            s, upto = room.index(max(room)), 0.0
            fits = sum(map(size, left)) <= room[s] + total / shards / sharding.HEAVY or room[s] <= 0
            limit, taken = room[s], []
            while left and (fits or upto < limit):
                taken.append(left.pop(0))
                upto += size(taken[-1])
            room[s] -= upto
            for r in taken:
                out[r[0]] = s
    rest = sorted((r for r in rows if r[2] not in heavy), key=lambda r: (r[2], r[0]))
    room = [max(x, 0) for x in room]
    ends, at, last = np.cumsum(room) * sum(map(size, rest)) / sum(room), 0, None
    for r in rest:
        if last is None or r[2] != last[0]:
            last = r[2], at
        out[r[0]] = int(min(np.searchsorted(ends, last[1], "right"), shards - 1))
        at += size(r)
    return out


def test_sharding_by_force(spark, monkeypatch):
    import xxhash

    rng = random.Random(13)
    texts = [f"copied {i} " * 20 for i in range(25) for _ in range(40)] + [f"own {i} " * rng.randrange(1, 60) for i in range(800)]
    rows = [(i, t, int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    for rows_a_range in (sharding.ROWS_A_RANGE, 30):
        monkeypatch.setattr(sharding, "ROWS_A_RANGE", rows_a_range)
        got = sharding.sharded(frame, 8).toPandas()
        assert dict(zip(got.doc_id, got.shard)) == places_by_force(rows, 8)
        got["text"] = got.doc_id.map(dict(enumerate(texts)))
        assert (got.groupby("text").shard.nunique() == 1).all()  # no group is cut
        sums = got.groupby("shard")["size"].sum()
        assert (sums - sums.mean()).abs().max() <= sums.mean() / 32 + got["size"].max()
        assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)


def test_places_of_heavy_groups():
    rng = np.random.default_rng(14)
    for _ in range(50):
        groups = -np.sort(-rng.integers(1, 4000, 12))
        total = int(groups.sum() + rng.integers(1, 9000))
        pieces, room = sharding.places_of(groups, total, 8)
        used = np.zeros(8)
        for size, (ends, where) in zip(groups, pieces):
            assert ends[-1] == pytest.approx(size)
            np.add.at(used, where, np.diff(ends, prepend=0))
        assert used.max() <= total / 8 * (1 + 2 / sharding.HEAVY) and (room <= total / 8).all()


# 10 language model


def test_masked_model(spark, odd):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["a b c d", "e f g h", "i j k l"]) for _ in range(80))
    frame = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")
    counts = masked_lm.bucket_counts(frame)
    vocab = masked_lm.vocabulary(counts)
    assert counts.sum() == 60 * 320
    net, fresh = masked_lm.trained(frame, vocab), masked_lm.Network.fresh(vocab.odds)
    held = pa.array([text()])
    shuffled = held[0].as_py().split()
    rng.shuffle(shuffled)
    mean = lambda n, t: masked_lm.log_probabilities(n, vocab, *masked_lm.word_ids(t)).mean()
    assert mean(net, held) > mean(fresh, held) + 0.1 and mean(net, held) > mean(net, pa.array([" ".join(shuffled)]))
    ids, edges = masked_lm.word_ids(held)
    every, used = np.arange(masked_lm.BUCKETS), np.bincount(vocab.classes, minlength=masked_lm.CLASSES) > 0
    for n in (net, fresh):  # the probabilities of all words between two neighbours
        around = np.repeat(masked_lm.contexts(ids, edges)[3:4], len(every), 0)
        assert np.exp(n.log_wanted(around, every, vocab, used)).sum() == pytest.approx(1, abs=1e-3)
    got = masked_lm.scored(odd).toPandas()
    assert len(got) == len(ODD) and set(got[got.n_words == 0].log_prob) == {0.0} and masked_lm.scored(odd.filter("false")).count() == 0


def test_trees_give_each_id_its_share():
    counts = np.zeros(masked_lm.BUCKETS, np.int64)
    counts[:2000] = np.arange(2000) ** 2
    vocab = masked_lm.vocabulary(counts)
    ids = np.array([0, 1, 5, 1999, 1500, 3000])
    row, node, right = vocab.ways(ids)
    turn = -np.logaddexp(0, np.where(right > 0, -1, 1) * vocab.odds[node])
    share = np.log((counts + 1) / np.bincount(vocab.classes, counts + 1)[vocab.classes])
    assert np.bincount(row, turn, len(ids)) == pytest.approx(share[ids], abs=1e-4)
    net = masked_lm.Network.fresh(vocab.odds)
    assert net.log_turns(np.ones((len(ids), masked_lm.WIDTH), np.float32), ids, vocab) == pytest.approx(share[ids], abs=1e-4)


def test_ways_by_level_are_the_ways_of_the_rows():
    vocab = masked_lm.vocabulary(np.random.default_rng(3).zipf(1.3, masked_lm.BUCKETS).clip(0, 10**6))
    ids = np.random.default_rng(4).integers(0, masked_lm.BUCKETS, 500)
    row, node, right = vocab.ways(ids)
    order, levels, nodes, rights = vocab.levels(ids)
    told = [[] for _ in ids]
    for lo, hi in levels:
        for k in range(lo, hi):
            told[order[k - lo]].append((int(nodes[k]), float(rights[k])))
    assert told == [[(int(n), float(r)) for n, r in zip(node[row == i], right[row == i])] for i in range(len(ids))]
    assert vocab.levels(ids[:0])[1] == []
    table, rows = np.random.default_rng(5).normal(size=(50, 8)).astype(np.float32), np.array([3, 3, 49, 0])
    assert np.array_equal(masked_lm._taken(table, rows), table[rows])


def test_a_training_step_by_force():
    """Adagrad steps in plain float64; sums of rows by key; inputs of 16 bits."""
    draw = np.random.default_rng(8)
    keys = draw.zipf(1.5, 900).clip(0, 400).astype(masked_lm._NODE)
    order, starts, found = masked_lm._by_key(keys)
    rows = draw.normal(size=(900, 8)).astype(np.float32)
    want = np.zeros((401, 8))
    np.add.at(want, keys, rows)
    assert sorted(found) == sorted(set(keys.tolist())) and (np.diff(starts) > 0).all()
    assert masked_lm._row_sums(rows[order], starts) == pytest.approx(want[found], abs=1e-4)
    vocab = masked_lm.vocabulary(draw.zipf(1.3, masked_lm.BUCKETS).clip(0, 10**6))
    net = masked_lm.Network.fresh(vocab.odds)
    seen = {k: np.zeros(s, np.float32) for k, s in masked_lm._SIZES.items()}
    w, squares = ({k: v.astype(np.float64) for k, v in x.items()} for x in (net.weights, seen))
    for size in (1300, 700, 1):  # more and fewer rows than are taken at a time
        ids = np.minimum(draw.zipf(1.2, size), 60000)
        around = masked_lm.contexts(ids, np.array([0, size // 3, size // 3, size]))
        assert around.dtype.itemsize == 2
        net.train(around, ids, vocab, seen)
        h = np.tanh(w["near"][around].sum(1) + w["bias"])
        g = np.exp(h @ w["out"] + w["shift"])
        g /= g.sum(1, keepdims=True)
        g[np.arange(size), vocab.classes[ids]] -= 1
        row, node, right = vocab.ways(ids)
        t = 1 / (1 + np.exp(-(h[row, : masked_lm.INNER] * w["turns"][node]).sum(1) - w["odds"][node])) - right
        back, grads = g @ w["out"].T, {k: np.zeros_like(v) for k, v in w.items()}
        np.add.at(back[:, : masked_lm.INNER], row, t[:, None] * w["turns"][node])
        np.add.at(grads["turns"], node, t[:, None] * h[row, : masked_lm.INNER])
        np.add.at(grads["odds"], node, t)
        back *= 1 - h * h
        np.add.at(grads["near"], around, back[:, None])
        grads |= {"out": h.T @ g, "shift": g.sum(0), "bias": back.sum(0)}
        for k, grad in grads.items():
            squares[k] += (grad / size) ** 2
            w[k] -= masked_lm.RATE * grad / size / np.sqrt(squares[k] + 1e-8)
            assert np.abs(net.weights[k] - w[k]).max() < 1e-3, k


def test_words_of_one_class_are_told_apart_by_context(spark):
    """Words of equal frequency, each after a word of its own: only the trees can tell them apart."""
    rng = random.Random(10)
    text = lambda: " ".join(f"a{k} b{k}" for k in rng.choices(range(40), k=100))
    frame = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    vocab = masked_lm.vocabulary(masked_lm.bucket_counts(frame))
    net, fresh = masked_lm.trained(frame, vocab), masked_lm.Network.fresh(vocab.odds)
    ids, edges = masked_lm.word_ids(pa.array([text()]))
    around, used = masked_lm.contexts(ids, edges), np.bincount(vocab.classes, minlength=masked_lm.CLASSES) > 0
    inside = lambda n: n.log_turns(n.hidden(around), ids, vocab).mean()
    assert inside(net) > inside(fresh) + 0.1 and net.log_wanted(around, ids, vocab, used).mean() > fresh.log_wanted(around, ids, vocab, used).mean() + 0.5


def test_every_word_is_a_target(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(masked_lm.Network, "train", lambda self, around, ids, vocab, sums: seen.append(len(ids)))
    monkeypatch.setattr(masked_lm, "_averaged", lambda models: models)

    class Rows:  # runs the task here
        def select(self, name):
            return self

        def mapInArrow(self, task, schema):
            return list(task(iter([pa.RecordBatch.from_arrays([pa.array(["a b c", "d", None, "e f " * 3000])], ["text"])])))

    (out,) = masked_lm.trained(Rows(), masked_lm.vocabulary(np.zeros(masked_lm.BUCKETS, np.int64)))
    assert sum(seen) == out.column("words")[0].as_py() == 6004


def test_scores_by_force(spark, monkeypatch):
    rng = random.Random(15)
    texts = [" ".join(rng.choice("ab" if i % 3 else "abcdefg") for _ in range(rng.randrange(60))) for i in range(50)]
    texts += ["the only text of its kind " * 3, "once and again but never more", "once and again but never more", None, "", "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    split = [(t or "").split() for t in texts]
    around = lambda w, i: (w[i - 1] if i else None, w[i + 1] if i + 1 < len(w) else None)
    both = collections.Counter((*around(w, i), w[i]) for w in split for i in range(len(w)))
    beside = collections.Counter(around(w, i) for w in split for i in range(len(w)))
    counts = masked_lm.bucket_counts(frame)
    vocab = masked_lm.vocabulary(counts)
    net = masked_lm.trained(frame, vocab)
    want = {}
    for d, (t, w) in enumerate(zip(texts, split)):
        prior = np.exp(masked_lm.log_probabilities(net, vocab, *masked_lm.word_ids(pa.array([t], pa.string()))))
        p = [(both[*around(w, i), w[i]] - 1 + prior[i]) / (beside[around(w, i)] - 1 + 1) for i in range(len(w))]
        want[d] = (len(w), float(np.log(p).sum()) if w else 0.0)
    one = collections.defaultdict(float)  # of all words, given two neighbours
    for (left, right, w), n in both.items():
        one[left, right] += n / (beside[left, right] + 1)
    assert all(one[k] + 1 / (beside[k] + 1) == pytest.approx(1) for k in one)
    plain = None
    for range_words, sample in ((masked_lm.RANGE_WORDS, masked_lm.SAMPLE), (1200, 1), (200, 1)):  # none, some and many hot neighbours
        monkeypatch.setattr(masked_lm, "RANGE_WORDS", range_words)
        monkeypatch.setattr(masked_lm, "SAMPLE", sample)
        got = {r.doc_id: (r.n_words, r.log_prob) for r in masked_lm.scored(frame).collect()}
        assert {d: n for d, (n, _) in got.items()} == {d: n for d, (n, _) in want.items()}
        assert all(got[d][1] == pytest.approx(want[d][1], abs=1e-3 * (1 + want[d][0])) for d in want)
        plain = plain or got
        assert all(got[d][1] == pytest.approx(plain[d][1], abs=1e-5) for d in got)
    assert got[51][1] == got[52][1]


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(16)
    vocabulary = [f"w{i}" for i in range(800)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    mean = {r.doc_id: r.mean_log_prob for r in masked_lm.scored(frame).collect()}
    assert min(mean[i] for i in (*range(20), *range(200, 220))) > max(mean[i] for i in range(20, 200))


@pytest.mark.parametrize("module, name", [(suffix_dedup, "op5_suffix_dedup"), (minhash, "op7_minhash")])
def test_queries_equal_their_sql(spark, module, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = getattr(module, name)(spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({module.SQL})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    frame = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert 0 < kept.count() <= frame.count()
        if name == "near_duplicates":
            want = classes_by_force([(r.doc_id, r.text) for r in frame.collect()], 5)
            assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
        frame = kept
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in frame.collect()}


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    text = " ".join(f"w{j}" for j in range(80))
    rows = [(i, text if i < 3 else f"{text} own{i} " * 2 if i == 3 else " ".join(f"x{i}y{j}" for j in range(70)), "s") for i in range(9)]
    rows += [(8, rows[8][1], "s"), (None, " ".join(f"n{j}" for j in range(60)), None), (20, None, "s"), (21, "", "s")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for docs in (frame, clashing(odd), frame.filter("false")):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), docs.schema)
            if docs is frame and name == "near_duplicates":
                assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 0, 4, 5, 6, 7, 8]
        out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        assert out.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
