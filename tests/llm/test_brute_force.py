"""Operators without SQL against plain versions."""

import hashlib
import math
import os
import random
import re
import string
import sysconfig
import time
import zlib
from html import unescape
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histomill.llm import decontam, graph, html_text, licenses, packing, quality, queries, secrets, sentence_dedup, simhash, spotsigs, url_filter

RANKS, TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.characters(blacklist_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def plain(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENS)


@settings(max_examples=800, deadline=None)
@given(text=TEXT | st.text("ab'st <|endoftext|>\n²½\x1c ſ", max_size=80) | st.text("aB'LlVe019_-.,!?\t\r\n \xa0éßñÅ中の½Ⅷ٣", max_size=120))
def test_encoder_gives_the_tokenizers_ids(tokenizer, text):
    ids = np.frombuffer(packing.encoder(RANKS, TOKENS).encode(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_is_close_to_the_bound():
    r = random.Random(1)
    sizes = sorted((r.randint(1, 1024) for _ in range(20_000)), reverse=True)
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= 1.02 * math.ceil(sum(sizes) / 1024)


def test_pack_round_trip(documents, plain, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_TASK", 40)  # several rounds
    rows = packing.pack(documents, RANKS, TOKENS).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == plain.keys()
    for doc, pieces in by.items():
        ids = np.array([*tokenizer.encode(plain[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    full = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 1024 and len(full) <= 1.05 * math.ceil(sum(r.length for r in rows) / 1024) + 1


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_of_counts_is_that_of_the_items(sizes):
    sizes = sorted(sizes, reverse=True)
    counts = {f: sizes.count(f) for f in set(sizes)}
    bins = {}
    for fill, low, high, per, first, place in packing.best_fit_of_counts(counts, 64):
        for rank in range(low, high):
            bins.setdefault(first + (rank - low) // per, []).append((place + (rank - low) % per, fill))
    assert all(sorted(p for p, _ in b) == list(range(len(b))) and sum(f for _, f in b) <= 64 for b in bins.values())
    assert sorted((f for b in bins.values() for _, f in b), reverse=True) == sizes
    want = sorted(tuple(sorted(sizes[i] for i in b)) for b in packing.best_fit(sizes, 64))
    assert sorted(tuple(sorted(f for _, f in b)) for b in bins.values()) == want


@pytest.mark.parametrize("small", [False, True])
def test_every_bin_with_room_goes_up(spark, monkeypatch, small):
    """Items that fit nowhere in their own task, in eight tasks and more; with small ones besides
    them, which fill what they leave."""
    monkeypatch.setattr(packing, "ITEMS_A_TASK", 400)
    monkeypatch.setattr(packing, "CHUNK", 150)
    r = random.Random(2)
    sizes = [r.randint(520, 1000) for _ in range(3_600)] + [r.randint(1, 200) for _ in range(9_000 * small)]
    record = lambda i, n: np.array([(i, 1, 0, 0, n, 0)], packing._RECORD).tobytes()
    table = spark.createDataFrame([(n, record(i, n), False) for i, n in enumerate(sizes)], "fill int, members binary, done boolean").cache()
    rows = packing.lay_out(packing.pack_bins(table)).collect()
    assert sorted((x.doc_id, x.length) for x in rows) == list(enumerate(sizes))
    ends = {}
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    bound = max(math.ceil(sum(sizes) / 1024), sum(n > 512 for n in sizes))
    assert max(ends.values()) <= 1024 and len(ends) <= 1.01 * bound


# --- SimHash


def slow_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def union(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("group", [2, 32])
def test_links_join_what_chains_of_two_bits_join(spark, group):
    r = random.Random(group)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains and crowds around the first ones
        x = r.choice(fps[:8] + fps[-40:])
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    table = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    place = {simhash._signed(x): i for i, x in enumerate(fps)}
    got = union(len(fps), [(place[e.a], place[e.b]) for e in simhash.links(table, crowd=group).collect()])
    assert got == want


def test_distances_to_references(spark):
    r = random.Random(6)
    fps = [r.getrandbits(64) for _ in range(400)]
    fps += [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in fps[:100]]
    fps = list(dict.fromkeys(fps))
    table = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for row in simhash.pivot_table(table).limit(50).collect():
        assert list(row.p) == [bin((row.fp & (1 << 64) - 1) ^ x).count("1") for x in simhash.references()]
    told = simhash.steps(table)
    assert told["all"] == len(fps) * (len(fps) - 1) // 2 > told["cells"] >= told["furthest"] >= told["verified"]
    assert told["verified"] == sum(bin(a ^ b).count("1") <= 2 for i, a in enumerate(fps) for b in fps[:i]) >= 90


def test_one_of_each_component_stays(spark):
    prose = lambda seed, n=80: " ".join(random.Random(seed).choices("stone river cloud garden tree window letter bridge market ocean".split(), k=n))
    rows = [(1, prose(1), "a"), (1, prose(2), "b"), (2, prose(1), "c"), (3, prose(3), "d"), (3, prose(3), "e"), (None, prose(3), "f"), (None, prose(4), "g"), (None, prose(4), "h"), (None, prose(5), "i"), (4, None, "j"), (5, "", "k")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted(
        [(False, 1, prose(1)), (False, 1, prose(2)), (False, 3, prose(3)), (True, 0, prose(4)), (True, 0, prose(5)), (False, 4, "")]
    )


def test_simhash_components(documents, plain):
    fps = {d: slow_fingerprint(t) for d, t in plain.items()}
    ids = sorted(fps)
    want = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(fps[ids[i]] ^ fps[ids[j]]).count("1") <= 2])
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    assert all(got[d].fp & (1 << 64) - 1 == fps[d] and got[d].component_id == ids[want[i]] for i, d in enumerate(ids))
    kept = {r.doc_id for r in simhash.keep_one(documents).collect()}
    assert kept == {ids[i] for i in set(want)}


def test_components_of_long_chains(spark):
    r = random.Random(3)
    names = r.sample(range(10_000), 90)
    links = [(names[i], names[i + 1]) for i in range(59)] + [(names[70], names[i]) for i in range(71, 90)]
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == min(names[:60]) for n in names[:60]) and all(got[n] == min(names[70:]) for n in names[70:])


# --- secrets


def slow_base(text):
    word = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rule = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


PARTS = ["token", "Secret", "apikey", "api_key", "PASSWORD", "=", ":", " ", "'", '"', "abc", "abcdef0123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "ſecret", "\n", "=token"]


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=20))
def test_base_spans(parts):
    text = "".join(parts)
    assert [s for s in secrets.scan(text) if s[1] < 3] == slow_base(text)


@settings(max_examples=200, deadline=None)
@given(run=st.text("abcdef0123456789XYZ", min_size=1, max_size=70))
def test_incremental_entropy(run):
    width = min(20, len(run))
    windows = [run[i : i + width] for i in range(len(run) - width + 1)]
    entropy = lambda w: -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w))
    assert list(secrets.entropies(run, width)) == pytest.approx(list(map(entropy, windows)), abs=1e-9)


def test_entropy_and_allow_list():
    found = lambda t: [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.scan(t)]
    key = "9fK2xQ7vLm3Zp8RtW5yB1c"
    assert found(f"key {key}") == [("entropy", key)]
    assert found(f"EXAMPLE_KEY={key}") == [("entropy", key)] and found(f"a/b={key}") == [("entropy", key)]
    assert found(f"dummy/{key}{key}")[0][1].endswith(key)
    assert found(f"words{'written' * 5}{key}{'together' * 5}")[0][1] not in (key, "") and key in found(f"{'written' * 5}{key}")[0][1]
    clean = (
        "id 123e4567-e89b-12d3-a456-426614174000", "12345678901234567890123", "/usr/local/lib/python3/site-packages/pandas", "abcdefghijklmnopqrstuvwxyz0123456789",
        "docs/2024/annual-report/overview", "2024-05-13T10-22-31_backup_final", "Donaudampfschifffahrtsgesellschaft", "ArrayIndexOutOfBoundsException", "A" * 60,
        "getUserAccountByIdentifier2", "internationalization_of_the_2024_release", "-" * 80, "https://www.example.org/en/Some-Title-Of-2021/index",
    )
    assert [t for t in clean if found(t)] == []
    assert secrets.mask("a token = abcdef1 b") == "a [SECRET] b" and secrets.mask("clean") == "clean"


def test_recall_on_random_keys_and_precision_on_names():
    r = random.Random(9)
    alphabets = {"hex": "0123456789ABCDEF", "one case": string.ascii_lowercase + string.digits, "alphanumeric": string.ascii_letters + string.digits,
                 "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "letters": string.ascii_letters}
    for name, alphabet in alphabets.items():
        for length, least in ((24, 0.9), (32, 0.96), (48, 0.99)):
            keys = ["".join(r.choices(alphabet, k=length)) for _ in range(400)]
            least = least if name != "letters" else least - 0.06  # words written together look like them
            whole = sum(any(s <= 4 and e >= 4 + length for s, _, e in secrets.scan(f"key {k} here")) for k in keys)
            assert whole >= least * len(keys), (name, length, whole)
    folder = sysconfig.get_paths()["stdlib"]
    names = [os.path.join(place, f) for place, _, files in os.walk(folder) for f in files if "__pycache__" not in place][:20_000]
    assert len(names) > 500 and sum(bool(secrets.scan(n)) for n in names) <= 0.02 * len(names)
    begun = time.monotonic()
    for text in ("A" * 200_000, "Ab" * 100_000, "aB3/" * 50_000, "AAAb1" * 40_000):
        secrets.scan(text)
    assert time.monotonic() - begun < 20


def test_entropy_spans_of_clean_documents(plain):
    """Outside of what the patterns find, prose has no random strings."""
    for text in plain.values():
        spans = secrets.scan(text)
        assert all(any(s <= a and b <= e for s, k, e in spans if k < 3) for a, kind, b in spans if kind == 3)


# --- spot signatures


def test_edited_texts(documents, plain):
    ids = sorted(plain)
    got = {r.doc_id: r for r in spotsigs.fingerprint(documents).collect()}
    for i, d in enumerate(ids):
        text, after = plain[d] or "", plain[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        assert got[d].edited == text[: len(text) - half] + after[:half] and got[d].n_chars == len(text)
        a, b = set(got[d].sigs), set(got[d].edited_sigs)
        assert got[d].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        c = set(got[ids[(i + 1) % len(ids)]].sigs)
        assert got[d].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)


def slow_signatures(text):
    """Chains by plain loops: each anchor with the next three words that are no anchors."""
    t = re.sub(r"[.!?\n。！？]+(?=\s|$)|\n|[。！？]", " \x02 ", (text or "").lower())
    t = re.sub("([\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", t)
    words = ["\x02", *"".join(c if c.isalpha() or c.isnumeric() or c == "\x02" else " " for c in t).split()]
    sign = lambda w: "\u3040" <= w <= "\u9fff"
    anchor = lambda w: w in spotsigs.ANCHORS or len(w) <= 2 and not sign(w)
    out = set()
    for i, w in enumerate(words):
        if anchor(w):
            chain = [x for x in words[i + 1 :] if not anchor(x)][:3]
            if chain:
                out.add((w, *chain))
    return out


def test_signatures_are_chains_behind_anchors(spark, plain):
    texts = [*list(plain.values())[:120], "Не знаю, что это. Большая река течёт на юг, а город стоит.", "東京は大きい都市です。私は毎日電車に乗る。", "One. Two! Three?", "no the of", "x" * 5_000,
             "Completely unrelated words, starting alike", "a|b the table|row stands\nhere now", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: len(r.sigs) for r in table.select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    assert got == {i: len(slow_signatures(t)) for i, t in enumerate(texts)}
    hashed = table.sparkSession.createDataFrame([(i, f"\x01{' '.join(s)}") for i, t in enumerate(texts) for s in slow_signatures(t)], "doc_id long, s string")
    want = {r.doc_id: r.h for r in hashed.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.xxhash64("s"))).alias("h")).collect()}
    assert all(list(r.sigs) == want.get(r.doc_id, []) for r in table.select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect())
    assert min(got[i] for i in (120, 121)) >= 3


def test_order_of_rows_without_ids(spark):
    rows = [(None, f"text {i % 30}") for i in range(60)] + [(i // 2, f"other {i}") for i in range(40)] + [(None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.text, r.next_text) for r in spotsigs.in_order(table, 7).collect()]
    assert sorted((r[0] is not None, r[0] or 0, r[1]) for r in got) == sorted((d is not None, d or 0, t or "") for d, t in rows)
    one = [(r.doc_id, r.text, r.next_text) for r in spotsigs.in_order(table, 10_000).collect()]
    assert sorted(map(str, got)) == sorted(map(str, one))
    assert sorted(r[2] for r in got) == sorted(r[1] for r in got)  # each row is the next of one


def test_order_over_ranges(documents):
    one = spotsigs.in_order(documents, 10_000).select("doc_id", "next_text")
    many = spotsigs.in_order(documents, 7).select("doc_id", "next_text")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_signature_classes(documents):
    sets = {r.doc_id: set(r.sigs) for r in documents.select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    ids = sorted(sets)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if like(sets[ids[i]], sets[ids[j]]) >= 0.8])
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(documents).collect()}
    assert all(got[d] == ids[want[i]] for i, d in enumerate(ids))


# --- pages


def test_articles_of_the_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_what_is_no_article():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a>menu</a></nav>
    <div class="cookie-notice">we use cookies</div><div id=content><h1>Head</h1><p>First, long paragraph of the text; it has marks.
    <p>Second <b>bold</b>&amp; more, and so on, with words enough.<ul><li>a point, too, in it.</ul></div>
    <aside>side</aside><form><label>name</label></form><div class="comments"><p>nice, read this comment, it is long enough to count.</p></div>
    <script>var a = "<p>no</p>"</script><footer>end</footer>"""
    assert html_text.extract(page) == "Head First, long paragraph of the text; it has marks. Second bold& more, and so on, with words enough. a point, too, in it."
    assert html_text.extract("<p>a<br>b <!-- c --> d") == "a b d"
    assert html_text.extract("<article></article><div class=ad>buy</div>") == ""
    for odd in ("<", "<p", "<!--", "</", "&", "<script>", "a<b", "<p class='x"):
        assert isinstance(html_text.extract(odd * 3), str)


STORY = [f"Paragraph {i} of the story, which is long enough, has several marks; it goes on, and on, until its very end, as stories do." for i in range(4)]


def test_teaser_articles_are_not_the_text():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    cards = "".join(f'<article class="card"><h3>Teaser {i}</h3><p>Short one.</p></article>' for i in range(4))
    want = " ".join(["Title", *STORY])
    for page in (
        f"<body><div id=story><h1>Title</h1>{story}</div><div>{cards}</div></body>",
        f"<body><div id=story><h1>Title</h1>{story}</div>{cards}</body>",
        f"<body>{cards}<main><h1>Title</h1>{story}</main></body>",
        f"<body><article><h1>Title</h1>{story}</article>{cards}</body>",
        f"<body><article><h1>Title</h1>{story}<div>{cards}</div></article></body>",
        f"<body><main><article><h1>Title</h1><div>{story}</div></article>{cards}</main></body>",
    ):
        assert html_text.extract(page) == want, page


def test_articles_of_a_page_all_stay():
    both = [f"<article><h2>Head {k}</h2><p>{STORY[k]}</p><p>{STORY[k + 1]}</p></article>" for k in (0, 2)]
    assert html_text.extract(f"<body>{both[0]}{both[1]}</body>") == f"Head 0 {STORY[0]} {STORY[1]} Head 2 {STORY[2]} {STORY[3]}"
    parts = f"<body><div><p>{STORY[0]}</p></div><div><p>{STORY[1]}</p><p>{STORY[2]}</p><p>{STORY[3]}</p></div></body>"
    assert html_text.extract(parts) == " ".join(STORY)


def test_lists_of_links_in_an_article_go():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    links = "".join(f'<li><a href="/{i}">Another story number {i}</a></li>' for i in range(5))
    row = "".join(f'<a href="/t{i}">tag {i}</a> ' for i in range(5))
    points = "<ul><li>A point.</li><li>One <a href=x>more</a>, too.</li></ul>"
    page = f"<article><h1><a href=/>Title</a></h1>{story}{points}<ul>{links}</ul><div>{row}</div><p>The end.</p></article>"
    assert html_text.extract(page) == " ".join(["Title", *STORY, "A point. One more, too. The end."])


class Paths(HTMLParser):
    """Texts of well-formed pages by path, as the standard library reads them."""

    def __init__(self):
        super().__init__()
        self.at, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.at.append(tag)

    def handle_endtag(self, tag):
        self.at.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append((tuple(self.at), data.strip()))


def test_ratios_of_paths():
    r = random.Random(4)
    for _ in range(30):
        blocks = lambda depth: "".join(
            f"<{t}>{blocks(depth - 1)}</{t}>" if depth and r.random() < 0.6 else f"<{t}>{r.choice(STORY)[: r.randint(5, 90)]}</{t}>"
            for t in r.choices(["div", "section", "center", "blockquote"], k=3)
        )
        page = f"<body>{blocks(4)}</body>"
        plain = Paths()
        plain.feed(page)
        sums = {}
        for path, text in plain.found:
            sums.setdefault(path, []).append((len(text), sum(c in ".,;:!?" for c in text)))
        want = {}
        for path, found in sums.items():
            chars, marks, n = sum(c for c, _ in found), sum(m for _, m in found), len(found)
            want[path] = math.sqrt((chars / n) * (1 + marks / n)) * math.log(1 + chars)
        told = html_text.read(page)
        names = {0: ()}
        for (above, tag), number in told.steps.items():
            names[number] = (*names[above], tag)
        got = {names[p]: v for p, v in html_text.path_ratios(told, told.texts, [1.0] * len(told.texts)).items()}
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)


def test_the_threshold_chooses_texts():
    story = "".join(f"<p>{x}</p>" for x in STORY)
    lines = [f"Line {i}" for i in range(5)]
    told = html_text.read(f"<body>{''.join(f'<div>{x}</div>' for x in lines)}{story}<p>So it ends.</p></body>")
    all_texts, some, few = (html_text.select(told, t) for t in (0.0, html_text.THRESHOLD, 2.0))
    assert all_texts == [*lines, *STORY, "So it ends."]
    assert some == [*STORY, "So it ends."]  # its path's ratio and its neighbours keep the short one
    assert few == STORY


def test_harmless_class_names_and_broken_markup():
    story, want = "".join(f"<p>{x}</p>" for x in STORY), " ".join(STORY)
    for name in ("content no-sidebar", "elementor-widget", "post has-header", "layout-sidebar-right", "without-banner", "shared"):
        assert html_text.extract(f'<body><div class="{name}">{story}</div><div class="ad">Buy now, it is cheap.</div></body>') == want, name
    assert html_text.extract(f"<body><div class=comments>{story}</div><article><p>Short.</p></article></body>") == "Short."
    assert html_text.extract('<p>text</p><a href="x') == "text"
    assert html_text.extract('<p>one <a href="x>two</a> three</p><p>four</p>') == "one two three four"
    assert html_text.extract('<p title="a > b">text</p>') == "text"
    assert html_text.extract("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"


def test_time_is_linear():
    begun = time.monotonic()
    for page in ('<a "' * 250_000, "<div>" * 20_000 + "text " + "</div>" * 20_000, '<a ">' * 100_000, "<b>" * 50_000, "<p><table>" * 20_000, "<" * 500_000):
        html_text.extract(page)
    assert time.monotonic() - begun < 20


# --- licences


def slow_lines(text):
    t = (text or "").lower()
    for pattern, plain in [*((c, " ") for c in licenses.COPYRIGHT), *licenses.SPELLINGS]:
        t = re.sub(pattern, plain.replace("$1", r"\\1"), t)
    t = "".join(c if c.isalpha() or c.isnumeric() or c == "\n" else " " for c in t)
    return [" ".join(line.split()) for line in t.split("\n") if line.strip()]


def slow_scan(texts, known):
    names = {}
    for name, text in known:
        names.setdefault(" ".join(slow_lines(text)), name)
    for doc, text in texts:
        lines = slow_lines(text)
        whole = " ".join(lines)
        found = [names[x] for x in lines if x in names]
        yield doc, hashlib.sha256(whole.encode()).hexdigest(), names.get(whole) if whole else None, ",".join(sorted(set(found))), len(found)


def licensed_texts():
    by = dict(reversed(licenses.registry()))
    out = []
    for name, text in licenses.registry():
        flat = " ".join(text.replace("Copyright (c) <year>", "\nCopyright 2019-2021, J. Q. Smith & Sons Ltd.\n").split("\n"))
        out += [(name, text), (name, text.upper().replace("LICENSE", "LICENCE")), (name, flat)]
    mit = by["MIT"] if "Permission" in by["MIT"] else next(t for n, t in licenses.registry() if n == "MIT")
    out.append(("MIT", mit.replace("<year> <copyright holders>", "2020 J. Smith").replace("\n", " ")))
    out.append(("MIT", "\n".join(x for x in mit.split("\n") if "Copyright (c)" not in x)))
    return out


def test_licences_by_whole_text_and_line(spark, documents, plain):
    rows = [(i, t) for i, (_, t) in enumerate(licensed_texts())]
    rows += [(-1, "Some prose.\n  Released under the MIT LICENCE!\nMore of it. © 2020 Somebody\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (-1, None), (None, "© 2020 Somebody"), (None, "x" * 100_000)]
    rows += [(-9, rows[-4][1])] * 2
    got = sorted(map(str, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    want = list(slow_scan(rows, licenses.registry()))
    columns = ("doc_id", "digest", "license", "notices", "n_notices")
    assert got == sorted(str(Row(**dict(zip(columns, w, strict=True)))) for w in want)
    found = {d: name for d, _, name, *_ in want}
    same = {"GPL-3.0-only", "LGPL-3.0-only"}
    assert not [(i, name, found[i]) for i, (name, _) in enumerate(licensed_texts()) if found[i] != name and name not in same]
    got = {r.doc_id: tuple(r) for r in licenses.scan(documents).collect()}
    assert got == {w[0]: w for w in slow_scan(plain.items(), licenses.registry())}
    assert any(r[4] for r in got.values())


def test_equivalent_spellings(spark):
    pairs = [
        ("See https://www.x.org/l", "see http://x.org/l"),
        ("The licence of the organisation", "the LICENSE of the organization"),
        ("Copyright (c) 2020 A. B. Smith\nThe text.", "The text"),
        ("Other text. (c) 2021 Someone, Inc. All rights reserved.", "Other text."),
        ("Copyright 1999 X Permission is granted", "permission is granted"),
        ("50 per cent & more", "50% and more"),
        ("© 2020 " + "Name " * 40 + ". The rest is text.", "the rest is text"),
    ]
    table = spark.createDataFrame([(i, t) for i, p in enumerate(pairs) for t in p], "doc_id int, text string")
    found = {}
    for r in licenses.scan(table).collect():
        found.setdefault(r.doc_id, set()).add(r.digest)
    assert all(len(d) == 1 for d in found.values()), found
    assert len(set(map(frozenset, found.values()))) == len(pairs)


# --- repeated passages


def test_repeated_passages_go_and_others_stay(documents, plain):
    got = {r.doc_id: r for r in sentence_dedup.deduplicate(documents).collect()}
    ids = sorted(plain)
    first, runs, gone = {}, {d: sentence_dedup.runs(plain[d]) for d in ids}, {}
    for d in ids:
        for h, p, _ in runs[d]:
            first.setdefault(h, (d, p))
    for d in ids:
        gone[d] = {s for h, p, n in runs[d] if first[h] != (d, p) for s in range(p, p + n)}
        parts = sentence_dedup.sentences(plain[d])
        assert "".join(parts) == plain[d]
        assert got[d].text == "".join(s for i, s in enumerate(parts) if i not in gone[d]) and got[d].n_removed == len(gone[d])
    lines = {}
    for d in ids:
        for line in plain[d].split("\n"):
            if len(line.split()) >= 50:
                lines.setdefault(line, []).append(d)
    assert all(line not in got[d].text for line, found in lines.items() for d in dict.fromkeys(found[1:]) if d != found[0])


def test_repeated_passages_go_to_their_ends(spark):
    r = random.Random(9)
    pool = [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + ". " for n in [16, 5, 7, 1, 2, 3, 9, 12, 16, 4, 8, 6, 1, 11, 2, 16]]
    made = lambda n: [" ".join(f"v{r.randrange(10**6)}" for _ in range(r.randint(1, 16))) + ". " for _ in range(n)]
    docs = [pool, [*made(1), *pool[:3], *made(2)], [*made(2), *pool[:3]]]
    for _ in range(60):
        doc = []
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(pool))
            doc += pool[at : at + r.randint(1, 7)] + made(r.randint(0, 2))
        docs.append(doc)
    docs.append(["\n", *docs[1]])
    first, spans = {}, []
    for d, doc in enumerate(docs):
        assert sentence_dedup.sentences("".join(doc)) == doc
        for p in range(len(doc)):
            for e in range(p + 2, len(doc) + 1):  # every run
                name = " ".join("".join(doc[p:e]).split())
                if name.count(" ") >= 19 and doc[p].strip():
                    first.setdefault(name, (d, p))
                    spans.append((d, p, e, name))
    gone = {(d, s) for d, p, e, name in spans if first[name] != (d, p) for s in range(p, e)}
    table = spark.createDataFrame([(d, "".join(doc)) for d, doc in enumerate(docs)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in sentence_dedup.deduplicate(table).collect()}
    for d, doc in enumerate(docs):
        assert got[d] == "".join(s for i, s in enumerate(doc) if (d, i) not in gone)
    assert got[1] == "".join(docs[1][:1] + docs[1][4:]) and got[2] == "".join(docs[2][:2])


def test_passages_inside_longer_sentences_go(spark):
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**6)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, f"Opening words here. {p}") for i, p in enumerate(passages)]
    rows += [(100 + i, " ".join(word() for _ in range(1 + i % 15)) + " " + p + " " + " ".join(word() for _ in range(i % 9))) for i, p in enumerate(passages)]
    got = {x.doc_id: x for x in sentence_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = [1 - sum(w in got[100 + i].text.split() for w in p.split()) / 60 for i, p in enumerate(passages)]
    assert sum(x > 0 for x in shares) >= 38 and sum(shares) / len(shares) > 0.65
    assert all(got[i].n_removed == 0 for i in range(40))


def test_scripts_without_spaces_and_rows_without_ids(spark):
    sign = lambda seed, n: "".join(chr(0x4E00 + random.Random(seed).randrange(5000) + i % 7) for i in range(n))
    passage = "。".join("".join(random.Random(i).choices([chr(c) for c in range(0x4E00, 0x5E00)], k=12)) for i in range(5)) + "。"
    english = " ".join(f"Sentence number {i} of a passage that is repeated here." for i in range(4))
    rows = [(1, f"{sign(1, 8)}。{passage}"), (2, f"{sign(2, 9)}。{passage}{sign(3, 5)}。"), (None, english), (None, english), (None, f"Another. {english}"), (None, None), (5, None)]
    got = sentence_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {x.doc_id: x for x in got if x.doc_id}
    assert by[1].n_removed == 0 and by[2].text == f"{sign(2, 9)}。{sign(3, 5)}。" and by[5].text is None
    assert sorted(len(x.text) for x in got if x.doc_id is None and x.text is not None)[:2] in ([0, 9], [0, 0]) and sum(x.n_removed > 0 for x in got) == 3


@settings(max_examples=100, deadline=None)
@given(text=st.text("ab ,.;!?\n。、漢字 ", max_size=300))
def test_sentences_lose_nothing(text):
    assert "".join(sentence_dedup.sentences(text)) == text


# --- proximity to the benchmark


def slow_near(text, item, slop, share=0.8):
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    doc, bench, span = words(text), words(item), 10 + 2 * slop
    spans = [set(doc[i : i + span]) for i in range(max(len(doc) - span, 0) + 1)]
    wins = [set(bench[i : i + 10]) for i in range(max(len(bench) - 10, 0) + 1)]
    return any(len(s & w) >= math.ceil(len(w) * share) for w in wins for s in spans)


def test_near_matches_whichever_words_are_missing(spark):
    r = random.Random(4)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(pool, k=n))) for i, n in enumerate((10, 12, 25, 3, 40))]
    texts = [" ".join(r.choices(pool, k=80)) for _ in range(10)]
    for gone in range(10):  # each word of the first item replaced, and each two by one that is nowhere else
        w = items[0][1].split()
        texts.append(" ".join(["x"] * gone + w[:gone] + ["y"] + w[gone + 1 :]))
        texts.append(" ".join(["x"] * gone + ["z" if i in (gone, (gone + 3) % 10) else t for i, t in enumerate(w)] + ["x"] * 9))
        texts.append(" ".join(["z" if i in (gone, (gone + 3) % 10, (gone + 5) % 10) else t for i, t in enumerate(w)]))
    for _ in range(60):
        w = r.choice(items)[1].split()
        at = r.randrange(len(w))
        w = [t for t in w[at : at + r.randint(8, 14)] if r.random() > 0.12]
        for _ in range(r.randint(0, 4)):
            i, j = r.randrange(len(w) or 1), r.randrange(len(w) or 1)
            w[i:i] = w[j : j + 1] if r.random() < 0.5 else ["x"] * r.randint(1, 3)
        texts.append(" ".join(r.choices(pool, k=r.randint(0, 20)) + w + r.choices(pool, k=r.randint(0, 20))))
    docs = spark.createDataFrame([*enumerate(texts), (None, items[2][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.decontaminate(docs, bench, slop=3).collect()}
    assert len(got) == len(texts) + 1 and "2" in got[None]["items"] and "2" in got[None].near_items
    for d, text in enumerate(texts):
        assert got[d].near_items == [str(i) for i, item in items if slow_near(text, item, 3)], text
    exact = {x.doc_id: (x.n_hit, x["items"]) for x in decontam.decontaminate(docs, bench).collect()}
    assert exact == {d: (x.n_hit, x["items"]) for d, x in got.items()}


def test_registered_near_matches(spark, data, documents, plain):
    bench = {x.item_id: x.text for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {x.doc_id: x for x in queries.QUERIES["op10_near_matches"](spark, data).collect()}
    assert got.keys() == plain.keys() and all(set(x["items"]) <= set(x.near_items) for x in got.values())
    for d in sorted(plain)[:40] + [d for d, x in got.items() if x.near_items][:20]:
        if plain[d] and plain[d].isascii() and len(plain[d]) < 5000:
            assert [i for i in got[d].near_items if bench[int(i)].isascii()] == sorted(str(i) for i, t in bench.items() if t.isascii() and slow_near(plain[d], t, 3))


# --- quality


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.classify(docs).join(labels, "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1


def test_labellers_accuracies_are_found():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9]
    votes = ["".join("0" if r.random() < 0.3 else "-+"[int(t == (r.random() < a))] for a in right) for t in truth]
    patterns = {}
    for v in votes:
        patterns[v] = patterns.get(v, 0) + 1
    posterior, given_ = quality.estimate(patterns)
    assert np.abs(given_[1] - right).max() < 0.03 and np.abs(1 - given_[0] - right).max() < 0.05
    assert np.mean([(posterior[v] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93


def slow_estimate(patterns, rounds):
    """Expectation and maximisation vote by vote."""
    names = sorted(patterns)
    good = {p: 0.2 if "-" in p else 0.9 for p in names}
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = min(0.99, max(0.01, sum(patterns[p] * good[p] for p in names) / total))
        given_ = [[], []]
        for c in (0, 1):
            for k in range(len(names[0])):
                share = lambda p: good[p] if c else 1 - good[p]  # noqa: B023, E731
                plus = sum(patterns[p] * share(p) for p in names if p[k] == "+")
                voted = sum(patterns[p] * share(p) for p in names if p[k] != "0")
                given_[c].append((plus + 1) / (voted + 2))
        for p in names:
            odds = [1 - prior, prior]
            for c in (0, 1):
                for k, v in enumerate(p):
                    odds[c] *= 1 if v == "0" else given_[c][k] if v == "+" else 1 - given_[c][k]
            good[p] = odds[1] / sum(odds)
    return good, given_


def test_estimation_against_plain_loops():
    r = random.Random(3)
    patterns = {"".join(r.choices("+-0", [5, 2, 3], k=len(quality.LABELLERS))): r.randint(1, 50) for _ in range(30)}
    good, given_ = quality.estimate(patterns, 10)
    want, want_given = slow_estimate(patterns, 10)
    assert all(math.isclose(good[p], want[p], rel_tol=1e-6, abs_tol=1e-9) for p in patterns)
    assert np.allclose(given_, want_given)


def test_training_against_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "DIMENSIONS", 6)
    r = random.Random(4)
    rows = []
    for _ in range(40):
        at = sorted(r.sample(range(6), r.randint(0, 4)))
        rows.append((at, [r.random() for _ in at], r.random()))
    weights, intercept = quality.train(rows, steps=25)
    dense = [[dict(zip(at, v, strict=True)).get(i, 0.0) for i in range(6)] + [1.0] for at, v, _ in rows]
    rate = 4 / max(sum(x * x for x in row) for row in dense)
    w, speed = [0.0] * 7, [0.0] * 7
    for k in range(25):
        ahead = [a + k / (k + 3) * b for a, b in zip(w, speed, strict=True)]
        gaps = [1 / (1 + math.exp(-sum(a * x for a, x in zip(ahead, row, strict=True)))) - y for row, (*_, y) in zip(dense, rows, strict=True)]
        after = [a - rate * (sum(g * row[i] for g, row in zip(gaps, dense, strict=True)) / len(rows) + 1e-4 * a) for i, a in enumerate(ahead)]
        speed, w = [a - b for a, b in zip(after, w, strict=True)], after
    assert np.allclose([*weights, intercept], w, atol=1e-3)


def test_labellers_on_other_scripts_and_long_texts(plain):
    russian = "Большая река течёт на юг через поля и леса, а старый город стоит на её берегу. Люди живут здесь давно, и они любят этот тихий край. "
    chinese = "东京是一个很大的城市，每天有很多人坐电车去工作。春天的时候公园里开满了花，孩子们在树下玩，老人在旁边喝茶。"
    for text in (russian, russian * 3, chinese, chinese * 2, "GDP 与 GNP 不同，" + chinese):
        assert "-" not in quality.vote(quality.measures(text)), text
    words = [w for t in plain.values() if t for w in t.split()]
    assert quality.sameness(["a"] * 1000) == 0.99 and quality.sameness([str(i) for i in range(1000)]) == 0
    assert abs(quality.sameness(words[:2000]) - quality.sameness(words[:40_000])) < 0.1  # not by length


# --- urls


def slow_judge(url, rules, blocked):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[3], max(fit)[2]) if fit else (None, "block" if host + path in blocked else "allow"))


@pytest.mark.parametrize("part", [7, 2_000_000])
def test_rules_and_blocked_urls(spark, monkeypatch, part):
    monkeypatch.setattr(url_filter, "PART_ROWS", part)  # several parts, and one
    urls = [None, "", "no scheme", "http://A.org", "http://x.A.org/p/q?z", "https://b.com/p", "b.com/p", "ftp://xa.org/p/", "http://a.org/pq#f", "http://c.net/bad?x=1", "HTTP://a.org/p/q/r"]
    rules = [("a.org", "/", "allow"), ("a.org", "/p", "block"), ("x.a.org", "/p/q", "allow"), ("b.com", "", "block"), ("a.org", "/p/q/", "allow"), ("a.org", "/p/q/", "block")]
    r = random.Random(8)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "m.x.") for b in ("alpha", "beta", "gam") for c in ("org", "com")]
    urls += [f"http://{r.choice(hosts)}/{r.choice('abc')}/{r.choice('abc')}?q" for _ in range(300)] + ["http://long.net/" + "y" * 50_000]
    rules += [(r.choice(hosts), f"/{r.choice('abc')}/"[: r.randint(0, 3)], r.choice(["allow", "block"])) for _ in range(20)]
    blocked = ["c.net/bad", *{f"{h}/{a}/{b}" for h in hosts for a in "abc" for b in "ab"}, "long.net/" + "y" * 50_000]
    held = {}
    for h, p, v in rules:
        held[h, p] = "block" if "block" in (v, held.get((h, p))) else "allow"
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: tuple(x)[1:] for x in url_filter.judge(pages, rules, blocked).collect()}
    assert got == {i: slow_judge(u, [(*k, v) for k, v in held.items()], set(blocked)) for i, u in enumerate(urls)}
    assert {url_filter.ALLOW, url_filter.BLOCK} == {x[3] for x in got.values() if x[2] is None}
    assert {x[3] for x in url_filter.judge(pages, []).collect()} == {None}


def test_colliding_digests_do_not_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s, *_: len(s))
    path = str(tmp_path / "a.bin")
    url_filter.DigestArray.write(path, [b"aa", b"bb", b"c"])
    array = url_filter.DigestArray(path)
    found = array.find([b"bb", b"cc", b"c", b"ddd"])
    assert [None if i < 0 else array.string(i) for i in found] == [b"bb", None, b"c", None]
