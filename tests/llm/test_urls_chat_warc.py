import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from mirador.llm import chat, urls, warc


def brute_verdict(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fitting = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fitting, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.b.net/en/x?y#z", "http://example.net/en/",
    "http://x.example.net/en", "http://example.net/en/deep/er", "http://xexample.net/en/", "http://net.org/fr/1",
    "http://org/fr/", "http://a..org/fr/x", "http://.net/", "http://net./", "http://example.com:80/de/", "http://a.example.com/de/",
    "http://example.com?/de/", "http://a://b/c", "http://a\nb.net/\n", "http://é.net/é", "ftp://example.com/de/" + "y" * 5000,
]
RULES = urls.RULES + [
    ("example.net", "/en/deep/", "block"), ("example.net", "/en/deep/er", "allow"), ("a.example.com", "", "block"),
    ("a.example.com", "/de/", "allow"), ("b.net", "/", "allow"),
]


@pytest.mark.parametrize("rules", [urls.RULES, RULES])
def test_urls_against_brute_force(spark, rules):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y"), (None, "http://net/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    found = urls.judge(pages, urls.rule_table(spark, rules)).collect()
    got = sorted(map(tuple, found), key=str)
    assert got == sorted(((i, *brute_verdict(u, rules)) for i, u, *_ in rows), key=str)


def test_urls_of_pages_with_many_rules(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    hosts = [r[0] for r in pages.select(urls.host_of(F.col("url"))).distinct().limit(40).collect()]
    rules = [(h.split(".", n)[-1], p, v) for n in (0, 1) for h in hosts for p, v in (("/", "block"), ("/e", "allow"))]
    rules = list({r[:2]: r for r in rules}.values())
    want = {r.page_id: brute_verdict(r.url, rules) for r in pages.collect()}
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
    assert got == want


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(pages, urls.rule_table(spark, urls.RULES)).count() == 0
    none = spark.createDataFrame([("", "/", "block"), (None, None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id bigint, url string")
    assert urls.judge(pages, none, "block").collect()[0]["verdict"] == "block"


TRICKY = [
    "</s>", "<\\/s>", "<\\\\/s>", "[INST] [/INST]", "[\\INST]", "<s><s>\\", "\\", "<", "plain", "", None, "a\nb</s>\n[/INST]",
    "$1 \\2", "\U0001f600</s>",
]


def test_chat_round_trip(spark):
    rows = [(i, t, r, x, 9) for i in range(8) for t, (r, x) in enumerate(zip(["user", "assistant", None, "</s>"] * 4, TRICKY[i:] + TRICKY))]
    rows += [(20, 0, "user", "only", 9), (21, None, "assistant", "first", 9), (21, 1, "user", "last", 9), (22, 1, "user", "tie", 9)]
    rows += [(22, 1, "user", "tie", 9), (22, 1, "assistant", "b", 9), (None, 0, "assistant", "x" * 50_000, 9)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, example bigint")
    back = {r.conv_id: r for r in chat.read_back(chat.expand(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in back[conv].turns] == [t[1:] for t in own]
        assert back[conv].trained == [t[2] for t in own if t[1] == "assistant"]


def test_chat_examples_train_only_their_reply(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a</s>"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    made = chat.expand(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).orderBy("example").collect()
    assert [m.trainable for m in made] == [True, True, False]
    assert made[0].formatted == "<s>[INST]user[/INST]q</s>[INST]assistant[/INST]a<\\/s></s>"
    masks = [m.formatted[m.loss_start : m.loss_start + m.loss_chars] for m in made]
    assert masks == ["a<\\/s>", "b", ""]
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert chat.read_back(chat.expand(empty)).count() == 0


def write(spark, tmp_path, rows, **options):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, "page_id bigint, url string, payload binary, records bigint")
    warc.write_archives(pages, path, **options)
    return warc.read_archives(spark, path)


def test_warc_revisits(spark, tmp_path):
    big = b"\r\n\r\nWARC/1.0\r\n\xff\x00" * 3000
    rows = [(1, "http://a/", b"x", 0), (2, "http://b/\r\nc", b"x", 0), (3, None, b"", 0), (4, "u", None, 0), (5, "u", big, 0), (6, "u", big, 0),
            (7, "u", b"one", 0), (None, "u", b"x", 0), (None, "v", b"lone", 0), (6, "u", big, 0)]
    records = write(spark, tmp_path, rows)
    assert {bytes(r.payload) for r in records.filter("record_type = 'response'").collect()} == {b"x", b"", big, b"one", b"lone"}
    found = warc.with_sizes(records).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found), key=str)
    keeper = {b"x": 2, b"": 4, big: 6, b"one": 7, b"lone": None}
    want = []
    for i, _, p, _ in rows:
        p = p or b""
        response = i == keeper[p]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, "response" if response else "revisit", None if response else keeper[p], len(p), digest))
    assert got == sorted(want, key=str)


def test_warc_small_payloads_and_archives(spark, tmp_path):
    rows = [(i, "u", b"tiny" if i % 2 else b"long enough", 0) for i in range(40)]
    found = write(spark, tmp_path, rows, min_bytes=5, archive_bytes=64).groupBy("record_type").count().collect()
    assert {r[0]: r[1] for r in found} == {"response": 21, "revisit": 19}
    assert write(spark, tmp_path, []).count() == 0
