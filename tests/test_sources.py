"""Readers, connectors and collections on small inputs made here."""

import bz2
import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators.embedding import hashed_embedding
from lexmill.sources import collections, connectors, dumps, markup, uploads

HTML = (
    "<html><head><title> A  page </title><style>p{}</style></head><body><nav><li>no</li></nav><p>intro <b>bold</b><p>second</p>"
    "<h2>Part</h2><ul><li>one<ul><li>inner</li></ul></li><li>two</ul><h3>Deep</h3><table><tr><th>k<td>v</table><h2>Part</h2><p>again &amp; on</p><script>x</script></body></html>"
)
WIKI = (
    "Intro '''bold''' [[Target|label]] and [[Plain]].<!-- no --><ref>r</ref>\n__TOC__\n== One ==\n{{box|{{inner}}|x}}Text [https://x.org site]\n"
    "=== Sub ===\n{|\n|+ Cap\n! a !! b\n|-\n| 1 || 2\n|}\n== Two ==\n\n== Three ==\nend&nbsp;here {{open"
)
PAGE = "<page><title>{t}</title><ns>0</ns><id>{i}</id>{r}<revision><id>{i}0</id><timestamp>2020-01-01T00:00:00Z</timestamp><text>{x}</text></revision></page>"


def test_html():
    blocks, _ = markup.read_html(HTML)
    assert blocks == [
        ("p", "intro bold"), ("p", "second"), ("h2", "Part"), ("li", "one inner"), ("li", "inner"), ("li", "two"), ("h3", "Deep"), ("th", "k"), ("td", "v"), ("h2", "Part"), ("p", "again & on"),
    ]
    sections = markup.html_sections_of(HTML, "A")
    assert sections == [(["A"], "intro bold second"), (["A", "Part"], "one inner inner two"), (["A", "Part", "Deep"], "k v"), (["A", "Part", "Part"], "again & on")]
    assert markup.html_sections_of("<div>only text</div>", "B") == [(["B"], "only text")] and markup.html_sections_of(None, "B") == []
    assert markup.connector_text_of("<h1>T</h1><td>c</td><p>x") == "# T\n\n| c |\n\nx"


def test_wiki():
    assert markup.wiki_sections_of(WIKI, "W") == [
        (["W"], "Intro bold label and Plain."), (["W", "One"], "Text site"), (["W", "One", "Sub"], "Cap\na | b\n1 | 2"), (["W", "Three"], "end here {{open"),
    ]
    assert markup.wiki_sections_of(None, "W") == []


def test_links_titles_redirects(spark):
    html = '<a href="/a">1</a><A class="x" href=\'b?c\'>2</A><a href="https://o.org/z">3</a><a href="#f">4</a><a href="/a">5</a><a href="//p.org/q">6</a>'
    p = spark.createDataFrame([(1, "http://h.org/d/e", html), (2, "http://h.org", None)], "id long, url string, html string")
    assert {r["link"] for r in markup.links(p, "id", "url", "html").collect()} == {"http://h.org/a", "http://h.org/d/b?c", "https://o.org/z", "http://p.org/q"}
    t = spark.createDataFrame([(HTML,), ("<h2>only <i>this</i></h2>",), ("",)], "h string").select(markup.html_title(F.col("h")).alias("t"))
    assert [r["t"] for r in t.collect()] == ["A page", "only this", ""]
    r = spark.createDataFrame([(" #redirect [[There]] x",), ("text",), (None,)], "t string").select(markup.redirect_target(F.col("t")).alias("r"))
    assert [x["r"] for x in r.collect()] == ["There", None, None]


def test_dump(spark, tmp_path):
    pages = [[PAGE.format(t="A", i=1, r="", x="alpha"), PAGE.format(t="B", i=2, r='<redirect title="A" />', x="")], [PAGE.format(t="C", i=3, r="", x="#REDIRECT [[A]]"), "<page><title>D</title><ns>0</ns><id>4</id></page>"]]
    members, lines, at = [], [], 0
    for group in pages:
        member = bz2.compress("\n".join(group).encode())
        lines += [f"{at}:{p.split('<id>')[1].split('<')[0]}:T:{at}" for p in group]
        members.append(member)
        at += len(member)
    (tmp_path / "dump.bz2").write_bytes(b"".join(members))
    (tmp_path / "index.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    entries = dumps.index_entries(spark, str(tmp_path / "index.bz2"))
    assert [r["title"] for r in entries.orderBy("page_id").collect()] == ["T:0", "T:0", f"T:{len(members[0])}", f"T:{len(members[0])}"]
    assert dumps.index_report(entries).first().asDict() == {"entries": 4, "streams": 2, "first_offset": 0, "last_offset": len(members[0]), "backward": 0}
    got = dumps.read_streams(dumps.streams(entries), f"file://{tmp_path}/dump.bz2").orderBy("page_id").collect()
    assert [(r["page_id"], r["title"], r["redirect"], r["text"]) for r in got] == [(1, "A", None, "alpha"), (2, "B", "A", ""), (3, "C", "A", "#REDIRECT [[A]]")]
    (tmp_path / "all.xml").write_text("<mediawiki>" + "\n".join(sum(pages, [])) + "</mediawiki>")
    whole = dumps.read_pages(spark, str(tmp_path / "all.xml"))
    assert [tuple(r) for r in whole.orderBy("page_id").select("page_id", "title", "redirect", "text").collect()] == [(r["page_id"], r["title"], r["redirect"], r["text"]) for r in got]
    assert dumps.aliases(whole).first().asDict() == {"title": "A", "aliases": ["B", "C"]}
    assert dumps.streams(entries, 1).count() == 1 and dumps.streams(entries, 3).count() == 2
    with pytest.raises(Exception, match="not an index line"):
        dumps.index_columns(spark.createDataFrame([("x:1:t",)], "value string")).collect()


def test_index_report_finds_backward_offsets(spark):
    e = spark.createDataFrame([(5, 1, "", 0, 0), (3, 2, "", 0, 1), (1, 3, "", 9, 2), (7, 4, "", 9, 3)], "offset long, page_id long, title string, split long, line long")
    assert dumps.index_report(e).first()["backward"] == 2


def test_source_url(spark):
    x = spark.createDataFrame([("http://h/", "A b/ü:@~*.html")], "b string, p string").select(dumps.source_url(F.col("b"), F.col("p")).alias("u"))
    assert x.first()["u"] == "http://h/A%20b/%C3%BC:@~%2A.html"


def test_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    contents = {"t.csv": 'a, b\n"x, y",2\n\n', "t.tsv": "a\tb\n", "o.json": '{"b": 1, "a": [2]}', "l.jsonl": '{"b":1}\n\n{"a":2}\n', "sub/n.md": "# N", "z.bin": "no"}
    for name, text in contents.items():
        (tmp_path / name).write_text(text)
    got = {r["name"]: r for r in uploads.read_uploads(uploads.files(spark, str(tmp_path))).collect()}
    assert set(got) == {"t.csv", "t.tsv", "o.json", "l.jsonl", "n.md"}
    assert got["t.csv"]["text"] == "a | b\nx, y | 2" and got["t.csv"]["rows"] == [["a", "b"], ["x, y", "2"]] and got["t.csv"]["title"] == "t"
    assert got["o.json"]["text"] == json.dumps({"a": [2], "b": 1}, indent=2) and got["l.jsonl"]["text"] == '{"b": 1}\n{"a": 2}' and got["n.md"]["rows"] is None
    docs = {r["external_id"]: r for r in connectors.folder(spark, str(tmp_path)).collect()}
    assert set(docs) == {"t.csv", "o.json", "sub/n.md"} and docs["sub/n.md"]["version"] == hashlib.sha256(b"# N").hexdigest()


def test_upload_failures(spark):
    files = [("a.json", b'{"a": [[1]]}'), ("b.json", b"{"), ("c.jsonl", b"1\n[[[[2]]]]\n"), ("d.txt", b"\xff"), ("e.PDF", b"%PDF-1"), ("f.docx", b"PK\x03\x04"), ("g", b"x"), ("h.html", b"<img SRC = 'http://x'>"), ("i.txt", b"")]
    u = spark.createDataFrame(files, "name string, data binary").withColumn("size", F.octet_length("data"))
    got = {r["name"]: r["f"] for r in u.select("name", uploads.failure(F.col("name"), F.col("data"), F.col("size"), F.sha2("data", 256), depth=3).alias("f")).collect()}
    assert got == {
        "a.json": None, "b.json": "INVALID_JSON", "c.jsonl": "JSON_TOO_DEEP", "d.txt": "SIGNATURE_MISMATCH", "e.PDF": None, "f.docx": None, "g": "UNSUPPORTED_EXTENSION", "h.html": "REMOTE_HTML_RESOURCE", "i.txt": "ZERO_BYTE",
    }


def test_markdown_blocks(spark):
    text = "lead\nmore\n\n# Doc\n## One\ntext a\n### Deep ###\nb\r\n\r\nc\n<h2>Two</h2>\nd\n# Other\ne"
    rows = uploads.markdown_blocks(spark.createDataFrame([(1, "doc", text), (2, "doc", None), (3, "doc", " \n ")], "id long, title string, text string"), "id", "text", "title").orderBy("id", "block").collect()
    assert [(r["level"], r["text"], r["path"]) for r in rows] == [
        (None, "lead more", ["doc"]), (1, "Doc", ["doc"]), (2, "One", ["doc", "One"]), (None, "text a", ["doc", "One"]), (3, "Deep", ["doc", "One", "Deep"]), (None, "b", ["doc", "One", "Deep"]),
        (None, "c", ["doc", "One", "Deep"]), (2, "Two", ["doc", "Two"]), (None, "d", ["doc", "Two"]), (1, "Other", ["doc", "Other"]), (None, "e", ["doc", "Other"]),
    ]


def test_exports_and_crawl(spark):
    i = spark.createDataFrame([("K-1", "Sum", "Open", "Body", ["c1", "c2"], "2020", "u"), ("K-2", "S", None, None, None, None, None)], "key string, summary string, status string, description string, comments array<string>, updated string, url string")
    assert [r["text"] for r in connectors.issues(i).orderBy("external_id").collect()] == ["K-1: Sum\n\nStatus: Open\n\nBody\n\nComment: c1\n\nComment: c2", "K-2: S"]
    w = spark.createDataFrame([(7, "T", 3, "u", "<p>x")], "id long, title string, version long, url string, body string")
    assert tuple(connectors.wiki_pages(w).first()) == ("7", "T", "x", "3", "u")
    g = spark.createDataFrame([("docs/a.md", "b1", "x", "u"), ("src/a.md", "b2", "x", "u"), ("docs/a.py", "b3", "x", "u")], "path string, blob_id string, content string, url string")
    assert [r["external_id"] for r in connectors.repository_files(g, ("docs/",)).collect()] == ["docs/a.md"]
    link = lambda *t: "".join(f'<a href="{x}">l</a>' for x in t)
    p = spark.createDataFrame([("http://h/0", link("/1", "/2", "http://o/9", "/0")), ("http://h/1", link("/3")), ("http://h/2", link("/3", "/1")), ("http://h/3", link("/4")), ("http://h/4", ""), ("http://o/9", "")], "url string, html string")
    reached = connectors.crawl(p, p.where("url = 'http://h/0'"), ["H"], 2)
    assert sorted(tuple(r) for r in reached.collect()) == [("http://h/0", 0), ("http://h/1", 1), ("http://h/2", 1), ("http://h/3", 2)]
    assert sorted(r["url"] for r in connectors.crawl(p, p.where("url = 'http://h/0'"), ["h"], 3, "/2$", 3).collect()) == ["http://h/0", "http://h/1", "http://h/3"]
    assert connectors.crawled(p, reached).count() == 4
    known, seen = spark.createDataFrame([("a",), ("b",)], "external_id string"), spark.createDataFrame([("a",)], "external_id string")
    assert [r[0] for r in connectors.tombstones(known, seen, True).collect()] == ["b"] and connectors.tombstones(known, seen, False).isEmpty()


def test_collections(spark, tmp_path):
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.write('{"docid": "d1", "title": "t", "text": "x y"}\n')
    c = collections.corpus(spark, str(tmp_path / "c.json.gz"))
    assert tuple(c.first()) == ("d1", "t", "x y")
    for bad, read in (("1 2", collections.judgements), ("only", collections.topics)):
        with pytest.raises(Exception, match="columns"):
            read(spark.createDataFrame([(bad,)], "value string")).collect()
    collections.append_results(c, str(tmp_path / "r"))
    collections.append_results(c, str(tmp_path / "r"))
    assert collections.read_results(spark, str(tmp_path / "r"), "docid string, text string").count() == 2
    p = collections.write_postings(c.select(F.col("docid").alias("chunk_id"), F.col("text").alias("content")), str(tmp_path / "p"))
    assert {r["term"] for r in p.collect()} == {"x", "y"}


def test_hashed_embedding_model(spark):
    texts = {1: "Straße straße Haus", 2: "", 3: None, 4: "a b c d e f g a"}
    got = {r["id"]: r["embedding"] for r in hashed_embedding(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", 16).collect()}
    for i, text in texts.items():
        v = np.zeros(16)
        for token in (text or "").casefold().split():
            d = hashlib.blake2b(token.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "big") % 16] += 1 - 2 * (d[4] % 2)
        n = np.linalg.norm(v)
        assert got[i] == pytest.approx(np.round(v / n, 6) if n else v)
