"""Operators on single texts: token counts, shards, media, HTML, toxicity, quality."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import html_text, logistic, media, quality, sstable, token_counts, toxicity
from gridloom.llm.common import held_out, label_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, score double, h1 long"
LONG = "word and more words, " * 40_000
ODD = [(1, "Hello world", "en", "a", 1, 0, 0, 0.0, 0), (2, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 0, 0, 0.0, 0), (None, "No id here", "en", "a", 1, 0, 0, 0.0, 0), (1, "Hello world", "en", "a", 1, 0, 0, 0.0, 0), (4, LONG, "en", "b", 1, 0, 0, 0.0, 0), (1, "another text of the same id", "en", "a", 1, 0, 0, 0.0, 0), (5, "漢字 ñ \t\n x", "zh", "b", 1, 0, 0, 0.0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bytes_():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def mixes(parts, n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, most))) for _ in range(n)]


HARD = [*"abc the'sSTRE’İI0129½ \t\n\x0b\x1c\x85\xa0!?%<|>ñé漢ไ👍", "Σ", "ß", "'ll", "'RE", "tion", "<|endoftext|>", "<|startoftext|>", "  ", " \n", "\n "]


def test_token_counts_match_the_library(words):
    c = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    for t in mixes(HARD, 1500, 30, 1):
        assert c.count(t) == len(words.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_chunk_maps_compose(monkeypatch, size):
    c = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    texts = mixes([*"abc de\n.,"], 60, 40, 2)
    whole = [c.count(t) for t in texts]
    monkeypatch.setattr(token_counts, "CHUNK", size)
    assert [c.count(t) for t in texts] == whole


def test_token_count_query(odd, none, words):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(odd, path, limit=5).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((str(d[0]), len((d[1] or "").encode()), n := len(words.encode(d[1] or "", add_special_tokens=False).ids), n > 5) for d in ODD)
    assert token_counts.count_tokens(none, path).count() == 0


def test_encoder_matches_the_library(bytes_):
    e = sstable.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = mixes(HARD, 3000, 20, 3)
    want = [np.array(x.ids, "<u4").tobytes() for x in bytes_.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want
    assert e.count(texts) == [len(w) // 4 for w in want]


def test_counts_match_the_library_on_words(bytes_, spark):
    e = sstable.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(11)
    parts = ["th", "er", "ing", "'s", "'ll", "ñ", "é", "ß", "12", "007", ",", "...", "!?", "\n", "\t", "  ", " ", "A", "Z", "q", "x", "\xa0", "\xad", "ª", "²", "µ", "漢", "ſ", "<", "|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(6000)] + [d["text"] or "" for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert e.count(texts) == [len(x.ids) for x in bytes_.encode_batch(texts, add_special_tokens=False)]
    assert e.ranked
    spec = dict(e.spec, model=dict(e.spec["model"], merges=[*e.spec["model"]["merges"], ["t", "he"]]))
    assert e._ranked(spec) is None and sstable.Encoder(public_tokenizers.path("word_bpe_49k.json"))._ranked(spec) is None


def test_counts_with_and_without_neighbouring_blanks(bytes_):
    e = sstable.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    blanks = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\x1c", "\x1f", "\xad"]
    texts = [f"{a}{x}{b}{y}{c}" for x in blanks for y in ["", *blanks] for a in ("", "a", "7", "!", "'s") for b in ("", "é", "'ll") for c in ("", "zone", ".")]
    assert e.count(texts) == [len(x.ids) for x in bytes_.encode_batch(texts, add_special_tokens=False)]
    e.ranked[1] = None  # texts without two in a row don't need the pattern that looks ahead
    assert e.count(["a b\nc\xa0d ", "é\x1c\x1f ñ", ""]) == [len(x.ids) for x in bytes_.encode_batch(["a b\nc\xa0d ", "é\x1c\x1f ñ", ""], add_special_tokens=False)]
    with pytest.raises(AttributeError):
        e.count(["a  b"])


def test_shards_round_trip(odd, none, spark, bytes_, tmp_path):
    path = "file://" + str(tmp_path)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    files = sstable.write_shards(odd, path, vocabulary, 2)
    got = sstable.read_shards(spark, path, files).orderBy("start").collect()
    start, want = 0, []
    for doc, text in sorted(((d[0], d[1]) for d in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*bytes_.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    found = [ids for name, _, _ in files for ids in sstable.Reader(f"{path}/{name}").get(5)]
    assert len(found) == 1 and found[0].tolist() == [*bytes_.encode(ODD[7][1], add_special_tokens=False).ids, 2]
    assert sum(len(sstable.Reader(f"{path}/{n}").get(1)) for n, _, _ in files) == 3
    assert not [1 for n, _, _ in files for _ in sstable.Reader(f"{path}/{n}").get(77)]
    assert sstable.read_shards(spark, path, sstable.write_shards(none, path, vocabulary, 2)).count() == 0


def test_shard_blocks_and_bloom(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    monkeypatch.setattr(sstable, "BLOCK", 200)
    w = sstable.Writer(pafs.LocalFileSystem(), str(tmp_path / "x"), 4)
    for k in range(0, 1000, 2):
        w.add(sstable.make_key(k - 500), np.arange(k % 7, dtype=np.uint32) + 70_000)
    with pytest.raises(ValueError):
        w.add(sstable.make_key(-600), np.zeros(1, np.uint32))
    narrow = sstable.Writer(pafs.LocalFileSystem(), str(tmp_path / "n"), 2)
    narrow.add(sstable.make_key(1), np.array([65_535], np.uint32))
    with pytest.raises(ValueError):
        narrow.add(sstable.make_key(2), np.array([1, 70_000], np.uint32))
    w.close()
    r = sstable.Reader(str(tmp_path / "x"))
    assert len(r.blocks) > 20 and r.docs == 500
    assert [sstable.split_key(k)[0] for k, _ in r] == list(range(-500, 500, 2))
    for k in range(-502, 502):
        assert [x.tolist() for x in r.get(k)] == ([(np.arange((k + 500) % 7) + 70_000).tolist()] if k % 2 == 0 and -500 <= k < 500 else [])
    raw = bytearray((tmp_path / "x").read_bytes())
    raw[10] ^= 1
    (tmp_path / "y").write_bytes(raw)
    with pytest.raises(ValueError):
        list(sstable.Reader(str(tmp_path / "y")))


def test_media_round_trip(odd, none, spark, tmp_path):
    path = "file://" + str(tmp_path / "m")
    media.write_media(odd, path, archiveBytes="300000")
    got = media.media_features(media.read_media(spark, path, rangeBytes="100000")).collect()
    want = []
    for d in ODD:
        b = (d[1] or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((str(d[0]), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    same = [r for r in got if r["n_bytes"] == 11]
    assert len({tuple(r) for r in same}) == 1 and len(same) == 2
    media.write_media(odd.where("doc_id = 5"), path)
    ids = lambda: sorted(str(r["doc_id"]) for r in media.read_media(spark, path).select("doc_id").collect())
    assert ids() == sorted([*(str(d[0]) for d in ODD), "5"])
    media.write_media(odd.where("doc_id in (2, 3)"), path, mode="overwrite")
    assert ids() == ["2", "3"] and len(list((tmp_path / "m").glob("*.zip"))) <= 2
    media.write_media(none, path)
    media.write_media(odd.where("doc_id = 4"), path)
    assert ids() == ["2", "3", "4"]
    lost = media.read_media(spark, path).withColumn("media", F.when(F.col("doc_id") != 3, F.col("media")))
    rows = {r["doc_id"]: r for r in media.media_features(lost).collect()}
    assert rows[3]["n_bytes"] is None and rows[3]["feature"] is None and rows[2]["n_bytes"] == 0
    media.write_media(none, "file://" + str(tmp_path / "n"))
    assert media.read_media(spark, "file://" + str(tmp_path / "n")).count() == 0


def test_archives_are_zip_files(tmp_path):
    import io
    import zipfile

    import pyarrow.fs as pafs

    w = media.ArchiveWriter(pafs.LocalFileSystem(), str(tmp_path / "a.zip"))
    for k in range(5):
        w.add(f"{k:05d}-{k}.png", media.to_png(b"x" * (k * 50)))
    w.close()
    z = zipfile.ZipFile(io.BytesIO((tmp_path / "a.zip").read_bytes()))
    assert z.testzip() is None and len(z.namelist()) == 5
    samples, n = media.from_png(z.read("00003-3.png"))
    assert n == 150 and samples.tobytes()[:150] == b"x" * 150 and samples.size == 192


def test_members_are_retried_on_their_own(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    w = media.ArchiveWriter(pafs.LocalFileSystem(), str(tmp_path / "a.zip"))
    for k in range(4):
        w.add(f"{k:05d}-{k}.png", media.to_png(bytes([k]) * 100))
    w.close()
    fails, opened = {2: 2}, []

    class Flaky:
        def __init__(self, f):
            self.f, self.n = f, 0
            opened.append(1)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n=None):
            data = self.f.read(n) if n is not None else self.f.read()
            if data[:4] == b"PK\3\4":
                self.n += 1
                if b"" == data or fails.get(2) and len(opened) <= 2 and self.n == 3 - 2 * (len(opened) > 1):
                    raise OSError("lost")
            return data

    class Fs(pafs.LocalFileSystem):
        pass

    fs = pafs.LocalFileSystem()
    monkeypatch.setattr(media, "_open", lambda p: (type("X", (), {"open_input_file": lambda self, q: Flaky(fs.open_input_file(q)), "get_file_info": lambda self, q: fs.get_file_info(q)})(), p))
    r = media.ArchiveReader({"path": str(tmp_path)})
    rows = [x for b in r.read(media.Range("a.zip", 0, 1 << 30)) for x in b.to_pylist()]
    assert [x["doc_id"] for x in rows] == [0, 1, 2, 3] and len(opened) == 3
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.find(b"PNG", 300)] ^= 1
    (tmp_path / "a.zip").write_bytes(raw)
    monkeypatch.undo()
    with pytest.raises(OSError):
        list(media.ArchiveReader({"path": str(tmp_path)}).read(media.Range("a.zip", 0, 1 << 30)))
    rows = [x for b in media.ArchiveReader({"path": str(tmp_path), "onError": "row"}).read(media.Range("a.zip", 0, 1 << 30)) for x in b.to_pylist()]
    assert len(rows) == 4 and sum(x["error"] is not None for x in rows) == 1


def test_token_counts_of_letters_newer_than_pythons_tables():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    c, library = token_counts.Counter(path), Tokenizer.from_file(path)
    for k in [0xA7CB, 0xA7DC, 0x130, 0x3A3, 0x1E9E, 0x1F88, 0x10A0, 0x13A0, 0x1C89, 0x10570, *range(0x370, 0x400), *range(0xA7C0, 0xA800)]:
        text = f"a {chr(k)}b1{chr(k)}1 É{chr(k)}"
        assert c.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(k)


def test_token_counts_keep_words_by_size():
    """Texts without white space aren't kept; others are, up to a number of characters."""
    c = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(3):
        c.count(f"{k}x" * 200_000)
    assert sum(map(len, c.words)) == c.held == 0
    c.held = token_counts.MAX_HELD_CHARS + 1
    c.count("some words")
    assert c.held == sum(map(len, c.words)) <= 9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><div class="logo">Site name</div><nav><a href=1>Home</a> <a href=2>News</a></nav></header>
<div id="cookie-banner"><p>We use cookies to make this site better for everybody who reads it.</p></div>
{open}<h1>The headline</h1><p>First paragraph, with a <a href=x>link</a> &amp; an entity&hellip;</p>
<div class="ad">Buy now, the best offer of the year for all of you</div>
<p>Second
   paragraph<br>goes on.<p>Short.<ul><li>one<li>two</ul><blockquote>Said so.</blockquote>{close}
<form><label>Your name</label><input><button>Send</button></form>
<aside class="sidebar"><p>Most read stories of the week are listed here for you.</p></aside>
<div class="comments"><h3>Comments</h3><p>A reader says that this is a long and thoughtful comment.</p></div>
<footer>&copy; Site, all rights reserved, terms and conditions</footer></body></html>"""
MAIN = ["The headline", "First paragraph, with a link & an entity…", "Second paragraph goes on.", "Short.", "one", "two", "Said so."]


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("", "")])
def test_html_main_text(start, end):
    assert html_text.main_text(PAGE.replace("{open}", start).replace("{close}", end)) == "\n\n".join(MAIN)


STORY = ["The story starts with a paragraph of plain words that nobody else has.", "It goes on with a second one, which is just as long as the first was."] * 4


@pytest.mark.parametrize("box", ["comments", "related"])
def test_html_article_elements_in_boilerplate(box):
    story = "".join(f"<p>{x}</p>" for x in STORY)
    page = f"<body><div>{story}</div><div class={box}><article><p>Someone says something here.</p></article><article><p>So do I.</p></article></div></body>"
    assert html_text.main_text(page) == "\n\n".join(STORY)
    teasers = "<article><h2><a href=x>Another story</a></h2></article>" * 3
    assert html_text.main_text(f"<body><div>{story}</div>{teasers}</body>") == "\n\n".join(STORY)


@pytest.mark.parametrize("tag", ["div", "article"])
def test_html_keeps_short_ends_of_an_article(tag):
    body = "<h2><a href=x>A linked headline</a></h2>" + "".join(f"<p>{x * 8}</p>" for x in STORY) + "<div class=ad>Buy now</div><p>A short closing paragraph.</p><p><a href=y>Read on</a></p>"
    want = ["A linked headline", *(x * 8 for x in STORY), "A short closing paragraph.", "Read on"]
    assert html_text.main_text(f"<body><nav><a>Home</a></nav><{tag}>{body}</{tag}><footer>All rights</footer></body>") == "\n\n".join(want)


def test_html_markup_that_names_a_subject_or_stands_in_a_sentence():
    rest = "".join(f"<p>{x}</p>" for x in STORY)
    for start, want in (
        ('<h2 id="search-algorithms">Search</h2>', ["Search"]),
        ('<p class="legal-history">A history of law.</p>', ["A history of law."]),
        ('<p class="ad">Buy this now.</p>', []),
        ('<div class="site-search">Find</div>', []),
        ("<p title=it's>One's own.</p>", ["One's own."]),
        ("<p title = 'a>b' x=\">\">Quoted.</p>", ["Quoted."]),
        ('<p>A drawing <svg width="1"/> in a line.</p>', ["A drawing in a line."]),
        ('<p>Another <svg><text>no</text></svg>one.</p>', ["Another one."]),
        ("<p>With <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x</annotation></math> in it.</p>", ["With x=1 in it."]),
        ("<script src=x /></script><p>After it.</p>", ["After it."]),
    ):
        for tag in ("div", "article"):
            assert html_text.main_text(f"<body><{tag}>{start}{rest}</{tag}></body>") == "\n\n".join([*want, *STORY]), start


STATES = ['div class="content-area has-sidebar"', 'div class="wrap no-sidebar"', 'div class="hentry comments-open"', 'section class="legal-news"', 'div data-class="promo"', 'div data-hidden="x"', 'div title="hidden class=promo"', 'div class="menu-open post"']
NAMES = ['div class="sidebar-left"', 'div class="main-nav"', 'div class="x comment-list y"', 'div id="cookie_banner"', 'div class="legal"', 'div class=promo', "div class='related-posts'", 'div hidden', 'div class="share-buttons no-print"']


@pytest.mark.parametrize("start", STATES + NAMES)
def test_html_states_and_names(start):
    """What a container has or allows, or what other attributes say, doesn't take its text away; what it is called does."""
    story = "".join(f"<p>{s}</p>" for s in STORY)
    tag = start.split()[0]
    want = "\n\n".join(STORY) if start in STATES else ""
    assert html_text.main_text(f"<body><{start}>{story}</{tag}></body>") == want


def test_html_text_beside_an_article_stays_whatever_its_size():
    story = "".join(f"<p>{s}</p>" for s in STORY * 20)
    page = f"<body><article>{story}</article><div><p>A short note of the editor after all of it.</p></div></body>"
    assert html_text.main_text(page).endswith("\n\nA short note of the editor after all of it.")


def test_html_work_is_linear():
    for page in ("<span>" * 80_000 + "</b>" * 80_000 + "end", "<div>" * 40_000 + "<p>x</p>" * 40_000, "<b><p>x" * 40_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 1.5


def test_html_odd_pages(spark):
    for page, want in ((None, ""), ("", ""), ("plain text", "plain text"), ("<nav><a>x</a></nav>", ""), ("<p>cut off <b>here", "cut off here"), ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<p>x</p><script>never closed <p>no</p>", "x"), ("<p>a</p><p attr='>'>b</p><p att", "a\n\nb"), ("<article></article>", ""), ("<p>1 < 2 &lt; 3 &#8364; &notanentity;</p>", html.unescape("1 < 2 &lt; 3 &#8364; &notanentity;"))):
        assert html_text.main_text(page) == want
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (1, "u", "<p>y</p>"), (3, "u", "<p>" + "long words here " * 100_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert len(got) == 5 and {r["n_chars"] for r in got} == {0, 1, 1_599_999}
    assert html_text.extract(df.where("false")).count() == 0


def test_html_tables_against_a_plain_reading(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1].replace("<b>", "").replace("</b>", "")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r["html"]) == "\n\n".join(p for p in parts if p)


def edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def weights_by_hand(w, terms, strict=()):
    """(exact, near) of a word by plain edit distances to every entry and, for beginnings, from every prefix."""
    takes = lambda t: 0 if t in strict or len(t.rstrip("$")) < 5 else 2 if len(t) >= 10 and t.endswith("$") else 1
    exact = max([x for t, x in terms.items() if w and (w == t[:-1] if t.endswith("$") else w.startswith(t))], default=0.0)
    close = [x for t, x in terms.items() if w and takes(t) and min(edits(p, t.rstrip("$")) for p in ([w] if t.endswith("$") else [w[:k] for k in range(1, len(w) + 1)])) <= takes(t)]
    return exact, 0.0 if exact else max(close, default=0.0)


def test_automaton_against_edit_distance():
    terms = {"badger$": 3.0, "villainous$": 5.0, "cat$": 2.0, "horri": 4.0, "bad": 1.0, "laggard$": 2.5}
    for strict in (frozenset(), frozenset({"laggard$", "horri"})):
        a = toxicity.Automaton(terms, strict)
        assert strict or all(a.read(w)[1] for w in ("adger", "vadger", "abdger", "horible", "hoorible", "orrible", "illainos"))
        r = random.Random(5)
        for _ in range(3000):
            w = list(r.choice(["badger", "villainous", "cat", "horrid", "horri", "bade", "laggard"]))
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(w) + 1)
                w[i : i + r.randint(0, 1)] = r.choice(["", "x", "a", "r", "l"])
            w = "".join(w)
            assert a.read(w) == weights_by_hand(w, terms, strict), w


def test_automaton_forgets_without_changing(monkeypatch):
    terms = {"badger$": 3.0, "villainous$": 5.0, "horri": 4.0}
    whole = toxicity.Automaton(terms)
    monkeypatch.setattr(toxicity, "MAX_POSITIONS", 200)
    monkeypatch.setattr(toxicity, "MAX_MOVES", 50)
    small, r = toxicity.Automaton(terms), random.Random(8)
    for _ in range(2000):
        w = "".join(r.choice("badgervilnoush") for _ in range(r.randint(1, 9)))
        assert small.read(w) == whole.read(w)
        assert len(small.moves) <= 50 + 9


def counts_by_hand(text, terms):
    """The weighted counts of a whole text, word by word."""
    pieces, span = (text or "").split(), toxicity.SPAN
    hits, quoted = [], 0.0
    for i, p in enumerate(pieces):
        exact, near = weights_by_hand(toxicity.bare(p), terms)
        if not exact and not near:
            continue
        window = range(max(0, i - span), min(len(pieces), i + span + 1))
        begins = [j for j in window if j <= i and pieces[j][0] in toxicity.OPEN]
        closes = [j for j in window if (q := pieces[j].rstrip(".,;:!?")) and q[-1] in toxicity.CLOSE]
        if begins and not any(j < i and pieces[j][0] not in toxicity.OPEN for j in closes) and any(j >= i for j in closes):
            quoted += exact or near
        else:
            hits.append((i, exact, near, max(exact, 0.7 * near)))
    spoken, near = sum(h[1] for h in hits), sum(h[2] for h in hits)
    strongest = max([h[3] for h in hits], default=0.0)
    total = spoken + 0.7 * near
    fullest = max([sum(h[3] for h in hits if abs(h[0] - g[0]) <= span) for g in hits], default=0.0)
    stems = {toxicity.bare(pieces[h[0]]) for h in hits}
    log = np.log1p
    return [strongest, log(total), float(strongest >= 4), log(quoted), log(fullest), log(len(stems)), min(1.0, 5 * total / (len(pieces) + 20)) if pieces else 0.0, log(spoken), max([h[2] for h in hits], default=0.0), log(len(pieces))]


def test_whole_text_counts_by_hand():
    terms, r = {"badger$": 5.0, "villainous$": 3.0, "horri": 2.0, "cat$": 1.0}, random.Random(9)
    s, vocab = toxicity.Scorer(terms), ["badger", "Badgre,", "vadger!", "villainos", "horrible", "hoorible.", "cat", "cats", "plain", "words", "of", "a", "text", '"', '"so', 'said."', "“well", "done”", "it's", "..."]
    for n in [0, 1, 2, *range(3, 300, 7)]:
        text = " ".join(r.choice(vocab if r.random() < 0.5 else vocab[8:13]) for _ in range(n))
        assert np.allclose(s.counts(text), counts_by_hand(text, terms)), text
    long = "plain words of a text " * 20_000 + "badgre"
    assert s.counts(long)[8] == 5.0


def test_lexicon_takes_errors_where_misspellings_are_no_words(spark):
    rows = [(f"you badger number{i} of lantern", 1) for i in range(40)] + [(f"some other text{i} with a cadger and a lantern", 0) for i in range(60)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame([*rows, (None, 0), ("", 1)], "text string, y int"))
    takes = {t: lax for t, _, lax in lexicon}
    assert takes["badger$"] is False and not any(t.startswith("lant") for t in takes)
    clean = toxicity.learn_lexicon(spark.createDataFrame([(t.replace("cadger", "hedge"), y) for t, y in rows], "text string, y int"))
    assert {t: lax for t, _, lax in clean}["badger$"] is True
    score = toxicity.Scorer({t: w for t, w, _ in clean}).counts("you vadger")
    assert score[8] > 0


def test_toxicity_context_and_odd_rows(odd, none, spark):
    s = toxicity.Scorer({"badger$": 5.0})
    loud, quoted = s.counts("you badger what a badger"), s.counts('he said "you badger" to them')
    assert loud[1] > 0 and quoted[1] == 0 and quoted[3] > 0
    assert s.counts('he said "well ... badger" to them')[3] > 0 and s.counts('"quote" ends, you badger')[1] > 0
    assert s.counts("you badgre")[1] > 0 and s.counts(None) == s.counts("") == [0.0] * toxicity.N_COUNTS
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, 0), (4, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    terms, model = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, terms, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    terms, model = toxicity.fit_toxicity(none, labels.where("false"))
    assert toxicity.score_toxicity(none, terms, model).count() == 0
    assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(odd, terms, model).collect())


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op3_quality_pu", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    from gridloom.llm.queries import QUERIES

    path = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, path)
    rows = got.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    assert got.count() == spark.read.parquet(f"{path}/documents.parquet").count()


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, 0), (4, None)], "doc_id long, quality int")
    model, prior = quality.fit_quality(quality.measured(odd), labels)
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and 0 < prior <= 1
    assert quality.keep_quality(odd, model, 0.0).count() == len(ODD)
    model, _ = quality.fit_quality(quality.measured(none), labels.where("false"))
    assert quality.score_quality(none, model).count() == 0 and quality.keep_quality(none, model).columns == none.columns


def test_pu_learning_finds_the_prior():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, (2000, 3)), rng.normal(-2, 1, (600, 3))
    unl = np.vstack([rng.normal(2, 1, (1400, 3)), neg])
    model, prior = logistic.fit_nnpu(pos, unl)
    assert abs(prior - 0.7) < 0.06
    first = logistic.fit_logistic(np.vstack([pos, unl]), np.r_[np.ones(2000), np.zeros(2000)])
    edges = np.arange(-200, 201) * 0.05
    counts = np.histogram(np.clip(first.margin(unl), -10, 10 - 1e-9), [*edges[:-1], 99])[0]
    assert abs(logistic.binned_prior(first.margin(pos), edges[:-1], counts) - 0.7) < 0.06
    assert logistic.binned_prior(first.margin(pos), edges[:-1], counts * 0) == logistic.binned_prior(np.zeros(0), edges[:-1], counts) == 1.0
    assert (model.score(pos) > 0.5).mean() > 0.97 and (model.score(neg) < 0.5).mean() > 0.97


def test_held_out_and_samples(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)] + [(None, True)], "doc_id long, q boolean").withColumn("q", F.col("q").cast("int"))
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", held_out("doc_id").alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())
    s = label_sample(df, "q", 20).collect()
    assert len(s) == 40 and not any(got[r["doc_id"]] for r in s)
