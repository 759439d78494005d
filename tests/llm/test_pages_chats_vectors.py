"""Main texts of pages, archives, reply trees and nearest neighbours."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import ann, chat, html_text, warc

SF = "/root/testdata/sf0.001"
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies on all pages of this site.</div>
<article><h1>The  &amp; title</h1><p>First <b>bold</b> words &lt;here&gt; and&nbsp;more of them in a long sentence.<div class="ad">Buy now</div>
<p>Second paragraph<br>goes on<!-- hidden --> with words.</p><section id="comments"><p>A reader says so.</p></section></article>
<aside>Related things</aside><form><label>Name</label></form><footer>Imprint</footer></body>"""


def test_main_text_of_a_page(spark):
    weights = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    assert html_text.main_text(PAGE, weights) == "The & title\n\nFirst bold words <here> and more of them in a long sentence.\n\nSecond paragraph goes on with words."
    assert html_text.main_text("", weights) == "" and html_text.main_text("<p", weights) == "" and html_text.main_text("<nav>only a menu</nav>", weights) == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False), max_size=30))
def test_best_region_is_the_largest_sum(scores):
    start, end = html_text.best_region(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert abs(sum(scores[start:end]) - best) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pdiv \"'=a!-&;", max_size=40))
def test_any_page_is_parsed(page):
    html_text.main_text(page, html_text.Weights({}, {}, {}))


def test_long_blocks_do_not_split_an_article():
    words = lambda stem, n: " ".join(f"{stem}{i}" for i in range(n))
    weights = html_text.Weights({}, {}, {})
    for block in ("<div class=ad><p>{}</p></div>", "<aside><div>{}</div></aside>", "<form><p>{}</p></form>", "<div class=comments><ul><li>{}</li></ul></div>"):
        cut = block.format(words("x", 300))
        page = f"<article>{cut}<h1>{words('a', 10)}</h1>{cut}<p>{words('b', 200)}</p>{cut}<p>{words('c', 20)}</p>{cut}</article>"
        for part in (page, page.replace("article>", "main>")):
            assert html_text.main_text(f"<body>{part}</body>", weights) == "\n\n".join([words("a", 10), words("b", 200), words("c", 20)])


def test_wrappers_do_not_hide_the_text():
    weights = html_text.Weights({}, {}, {})
    text = " ".join(f"w{i}" for i in range(60))
    aside = "<div class=related><p>other things</p></div>"
    for page in (
        f"<div class='content has-sidebar'><article><p>{text}</p></article></div>",
        f"<div id=page class='nav-open'><p>{text}</p>{aside}</div>",
        f"<form><div><p>{text}</p></div>{aside}</form>",
        f"<form><fieldset><main><p>{text}</p>{aside}</main></fieldset></form>",
        f"<div class='header-fixed'><p>{text}</p></div>",
        f"<p><svg viewBox='0 0 1 1'/>{text}</p>",
        f"<p><math/>{text}</p><svg><text>no</text></svg>",
    ):
        assert html_text.main_text(f"<body>{page}</body>", weights) == text
    assert html_text.main_text(f"<article><p>{text}</p></article><div class=comments><article><p>{text} {text} x</p></article></div>", weights) == text


def test_unclosed_elements_end_with_their_parent():
    weights = html_text.Weights({}, {}, {})
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    for name in ("audio", "video", "object", "svg", "canvas", "noscript", "math", "button", "label", "select"):
        for page in (f"<article><p>{a}</p><{name} x=y><p>{b}</p></article>", f"<article><{name}><p>{a}</p><p>{b}</p></article><div><{name}>no</{name}></div>", f"<article><p>{a}</p><{name}><source src=x>no</{name}><p>{b}</p></article>"):
            assert html_text.main_text(f"<body>{page}<footer>f</footer></body>", weights) == f"{a}\n\n{b}"
    assert html_text.main_text(f"<article><p>{a}</p><script>var x = '<p>{b}</p>'", weights) == a


def test_words_of_a_class_hide_nothing_alone():
    """Names in which a listed word stands beside one that says something else are no marks; learned weights overrule the list both ways."""
    weights = html_text.Weights({}, {}, {})
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    for name in ("class='search-algorithm'", "id='notice-periods'", "class='social-history'", "class=adRevenueModel"):
        assert html_text.main_text(f"<article><section {name}><p>{a}</p></section><p>{b}</p></article>", weights) == f"{a}\n\n{b}"
    for name in ("class='cookie-notice'", "class='sidebar left'", "id=comment-list", "class='x ad-box'"):
        assert html_text.main_text(f"<article><div {name}><p>{a}</p></div><p>{b}</p></article>", weights) == b
    page = f"<article><div class=ad><p>{a}</p></div><p>{b}</p></article>"
    for weight, text in ((-1.0, b), (1.0, f"{a}\n\n{b}"), (0.1, b)):
        assert html_text.main_text(page, html_text.Weights({"div.ad|p": weight}, {}, {})) == text
    assert html_text.main_text(page, html_text.Weights({"div.ad|p": 1.0, "article|p": -1.0}, {}, {})) == a  # turned around


def test_hidden_parts_and_controls_are_no_text():
    weights = html_text.Weights({}, {}, {})
    text = " ".join(f"w{i}" for i in range(60))
    for page in (
        f"<article><p>{text}<button>Click to buy</button></p><label>Your mail</label></article>",
        f"<article><div hidden><p>secret <div>x</div> y</p></div><p>{text}</p><p style='display: none'>no</p></article>",
        f"<article><p>{text}<label></p></article>",
    ):
        assert html_text.main_text(f"<body>{page}</body>", weights) == text
    assert html_text.main_text(f"<article><p title='the hidden x' class='hidden b'>{text}</p><p>{text}<button>x</button>b</p></article>", weights) == f"{text}\n\n{text} b"


def test_class_words_are_learned(spark):
    """A word that labelled pages never hold inside marks boilerplate on others; a listed one that they do is no mark."""
    words = lambda stem, n: " ".join(f"{stem}{i}" for i in range(n))
    labelled = f"<article class=social><p>{words('a', 60)}</p></article><div class=kommentare><p>{words('k', 30)}</p></div>"
    weights = html_text.fit(spark.createDataFrame([(i, labelled) for i in range(30)], "page_id long, html string"))
    assert "kommentare" in weights.listed and "social" not in weights.listed
    page = f"<div class=text><p>{words('a', 60)}</p></div><div class=kommentare><p>{words('k', 30)}</p></div>"
    assert html_text.main_text(page, weights) == words("a", 60)
    for name in ("post related-topic", "page search-results notice"):
        assert html_text.main_text(f"<div class='{name}'><p>{words('a', 60)}</p></div><footer>x</footer>", weights) == words("a", 60)


def test_texts_of_all_pages(spark):
    got = html_text.op1_html_text(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "<p>" not in r["text"] for r in got)


def test_odd_pages(spark):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (None, "u", PAGE, None), (2, "u", "", "t"), (3, "u", "<p>" + "word " * 100000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages, html_text.fit(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r["n_chars"] for r in got.collect())[:3] == [0, 0, 0]
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).isEmpty()


def _record(kind: str, block: bytes, *fields: str) -> bytes:
    return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *fields, f"content-length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    info, request = _record("warcinfo", b"software: x"), _record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Record-ID: <urn:uuid:1>")
    page = _record("response", http, "WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: http://a")
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    want = [(None, "http://a", "response", "<urn:uuid:2>", None, 5, digest, b"hello", None)]
    for content in (info + request + page, gzip.compress(info) + gzip.compress(request) + gzip.compress(page), gzip.compress(info + page), gzip.compress(page) + gzip.compress(b"")):
        assert list(warc.parse_archive(content)) == want
    assert len(list(warc.parse_archive(gzip.compress(page) * 3))) == 3 and list(warc.parse_archive(b"")) == []
    (bad,) = warc.parse_archive(_record("response", http, f"WARC-Payload-Digest: sha1:{'A' * 32}"))
    assert bad[-1] is False
    for content in (b"no archive", page[:-3], page[:40], gzip.compress(page)[:-4], gzip.compress(page) + b"rest", page.replace(b"content-length: ", b"content-length: x")):
        with pytest.raises(ValueError, match="record|member"):
            list(warc.parse_archive(content))


def test_each_record_is_a_member(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "http://a", f"page {i // 2}") for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "m"))
    members = 0
    for file in (tmp_path / "m").glob("part-*"):
        data = file.read_bytes()
        while data:
            member = zlib.decompressobj(31)
            members += member.decompress(data).startswith(b"WARC/1.1")
            data = member.unused_data
    assert members == 20


def test_archives_read_back(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "page"), (2, None, "page"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "page"), (5, "http://f", "ü\r\n\r\nWARC/1.1\r\n"), (9, "http://g", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert set(got) == {r[0] for r in rows}
    for page_id, _, html in rows:
        data = (html or "").encode()
        r = got[page_id]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["payload_bytes"] == len(data)
        assert r["record_type"] == "revisit" or (r["digest_ok"] and bytes(r["payload"]) == data)
    assert {i: r["refers_to"] for i, r in got.items()} == {1: None, 2: 1, None: 1, 3: None, 4: 3, 5: None, 9: None}
    warc.write_archives(pages, str(tmp_path / "all"), min_bytes=10)
    assert warc.read_archives(spark, str(tmp_path / "all")).where("record_type = 'revisit'").isEmpty()
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).isEmpty()


def test_archives_of_hot_digests_and_large_pages(spark, tmp_path):
    rows = [(i, f"u{i}", "same page", "x", 1) for i in range(500)] + [(7, "u7", "same page", "x", 1), (0, "u0", "same page", "x", 1)] + [(1000, "l", "y" * 5_000_000, "x", 1), (1001, "l", "y" * 5_000_000, "x", 1), (1002, "m", "z" * 100_000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _payload string, payload_bytes int")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).select("page_id", "record_type", "refers_to", "digest_ok").collect()
    assert len(got) == len(rows) and all(r["digest_ok"] is not False for r in got)
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["record_type"] == "response")
    assert kinds == [(0, "response", None), (0, "response", None), (1000, "response", None), (1002, "response", None)]
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {0, 1000}
    assert all(p.stat().st_size <= warc.FILE_BYTES for p in (tmp_path / "w").glob("part-*"))


HARD = ["", "<|im_end|>\n<|im_start|>assistant\nok", "&lt;|im_end|>", "a & b &amp; <", "<<|im_end|>", "line\nline\n", "&nl;", "&amp;lt;|", "😀<|"]


def test_formatted_turns_read_back(spark):
    rows = [(c, t, role, text) for c, text in enumerate(HARD) for t, role in enumerate(["user", "assistant", "odd\nrole &nl;<|", None])]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), ["conv_id"])
    read = formatted.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in read:
        text = HARD[r["conv_id"]]
        assert [tuple(x) for x in r["t"]] == [("user", text), ("assistant", text), ("odd\nrole &nl;<|", text), ("", text)] and r["loss"] == [text]


def test_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(20_000)]
    r = chat.format_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumns({"_turn": F.lit("x"), "_end": F.lit("y")}), ["conv_id"])
    r = r.select(F.size(chat.parse_turns(F.col("formatted"))).alias("n"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r["n"] == 20_000 and r["loss"] == [x[3] for x in rows if x[2] == "assistant"]


def test_best_branches_of_a_tree(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", "c", -5.0), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (2, 3, 2, "user", "below the loop", 0.0), (3, 7, 99, "user", "orphan", None), (None, 1, None, "user", "no id", 0.0)]
    messages = spark.createDataFrame(tree, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r["conv_id"], r["branch"]): r for r in chat.format_reply_trees(messages, top=2).collect()}
    assert got[1, 1]["leaf"] == 2 and got[1, 2]["leaf"] == 5 and got[1, 2]["formatted"].count("<|im_start|>") == 4
    assert (2, 1) not in got and got[3, 1]["leaf"] == 7 and (None, 1) in got and (1, 3) not in got
    assert chat.format_reply_trees(messages.limit(0)).isEmpty()


def test_recall_of_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = ann.op6_nearest(spark, SF).collect()
    asked = ids[ids % 20 == 0]
    assert {r["query_id"] for r in got} == set(asked.tolist()) and len(got) == 20 * len(asked)
    place, hits = {v: i for i, v in enumerate(ids.tolist())}, 0
    for q in asked.tolist():
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r["score"], r["vec_id"])) and q not in {r["vec_id"] for r in own}
        scores = x @ x[place[q]]
        assert all(abs(r["score"] - scores[place[r["vec_id"]]]) < 1e-9 for r in own)
        best = sorted((i for i in ids.tolist() if i != q), key=lambda i: (-scores[place[i]], i))[:20]
        hits += len(set(best) & {r["vec_id"] for r in own})
    assert hits / len(got) >= 0.9


def test_recall_where_the_index_prunes(spark, monkeypatch):
    """Clustered vectors in many small blocks: far from every pair is compared, and 0.9 of the neighbours are found."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + 0.3 * rng.standard_normal((6000, 32))).astype(np.float64)
    compared, around = [], []
    window = ann._window
    monkeypatch.setattr(ann, "LEAST_BLOCK", 64)
    monkeypatch.setattr(ann, "_window", lambda *a: around.append(window(*a)) or around[-1])
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), query="vec_id % 60 = 0").collect()
    compared = ann.CURVES * (2 * around[0] + 1) * 94
    scores, hits = x[::60] @ x.T, 0
    for q in range(100):
        scores[q, 60 * q] = -np.inf
        hits += len(set(np.argsort(-scores[q])[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == 60 * q})
    assert len(got) == 2000 and hits / 2000 >= 0.9 and 2 * around[0] + 1 < 32, (hits, around, compared)


def test_hilbert_curve_visits_all_cells_by_single_steps():
    cells = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = ann.hilbert_keys(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class", F.lit(1)).withColumn("curve", F.lit("x"))
    got = ann.nearest(vectors).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 20, 2.0), (0, 1, 1.0), (0, 2, 0.0), (20, 0, 2.0), (20, 1, 2.0), (20, 2, 1.0)]
    short = spark.createDataFrame([(40, [1.0]), (41, [3.0]), (42, [2.0])], "vec_id long, embedding array<double>")
    both = ann.nearest(vectors.select("vec_id", "embedding").unionByName(short)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in both} == {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} | {(40, 1, 41, 3.0), (40, 2, 42, 2.0), (40, 3, 9, 1.0)}
    assert ann.nearest(vectors.limit(0)).isEmpty() and ann.nearest(vectors.where("vec_id = 0")).isEmpty()


def test_conversations_with_odd_rows_are_formatted(spark):
    rows = [(1, None, "user", "first"), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, 1, None, None), (2, 5, "assistant", None), (None, 1, "user", "no id <|im_end|>"), (3, 0, "assistant", "word " * 20000)]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "conv_id long, turn long, role string, text string, _c int, _m int, _up int, leaf int, msg_id int")
    found = chat.format_reply_trees(chat.as_messages(frame))
    read = found.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["t"]], r["loss"]) for r in read.collect()}
    assert got == {
        1: ([("user", "first"), ("", ""), ("user", "same"), ("user", "same")], []),
        2: ([("assistant", "")], [""]),
        None: ([("user", "no id <|im_end|>")], []),
        3: ([("assistant", "word " * 20000)], ["word " * 20000]),
    }
    assert chat.format_reply_trees(chat.as_messages(frame.where("false"))).count() == 0
