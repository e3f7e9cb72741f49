"""Archives, their index and the registered queries."""

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from jobtide.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    hot = "<p>same\r\n\r\nWARC/1.1</p>"
    rows = [(i, f"https://User@www.Example.com:8080/p/{i % 7}?q={i}#f", hot if i % 3 == 0 else f"<p>é {i}</p>" * i, "x") for i in range(120)]
    return [*rows, (500, None, "null url", "x"), (501, "odd\r\nurl%0A\t\\", None, "x"), (502, "http://e.org", "", "x"), (None, "http://e.org", "no page", "x"), (7, rows[7][1], rows[7][2], "x")]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip_with_revisits_and_odd_rows(spark):
    rows = pages(spark)
    last: dict = {}
    for page, _, html, _ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    got = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = []
    for page, url, html, _ in rows:
        data, stored = (html or "").encode(), last[html or ""]
        stays = page is None or page == stored
        expected.append((page, url, len(data), digest(data), "response" if stays else "revisit", None if stays else stored, data if stays else None))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(None if v is None else bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got), key=key) == sorted(expected, key=key)


def test_small_payloads_are_stored_in_full(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "v", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(df, min_revisit=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_gzip_members_and_lookups_find_only_what_is_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    df = spark.createDataFrame([(i, f"http://h{i % 4}.de/x", f"body {i}") for i in range(60)], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/a")
    text = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/a/part*")))
    assert text.count(b"WARC/1.1\r\n") == 60
    warc.build_index(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/i", block_lines=5)
    blocks = spark.read.parquet(f"file://{tmp_path}/i")
    assert blocks.count() >= 12
    wanted = spark.createDataFrame([(3, "http://h3.de/x"), (3, "http://h3.de/x"), (3, "http://h2.de/x"), (99, "http://h3.de/x"), (0, "http://a.de/")], "page_id long, url string")
    got = warc.read_records(warc.lookup(spark, f"file://{tmp_path}/i", wanted)).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(3, b"body 3")]


@pytest.mark.parametrize("url,key", [("http://www.E.com/A?b=c#d", "com,e,www)/A?b=c"), ("https://u:p@h.de:80", "de,h:80)/"), ("x", "x)/"), (None, ")/"), ("http://h.de?q=http://z/", "de,h)/?q=http://z/")])
def test_sort_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.surt(F.col("u"))).first()[0] == key


def test_native_digest(spark):
    texts = ["", "a", "é" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_of_hex(F.sha1(F.col("t").cast("binary"))).alias("d")).collect()
    assert all(r["d"] == digest(r["t"].encode()) for r in got)


COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_jaccard_join": "doc_id n_shingles component_id",
    "op5_lattice_near_dedup": "vec_id n_links component_id kept",
    "op6_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries_cover_their_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    out = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    table, key = {"op5_lattice_near_dedup": ("embeddings", "vec_id"), "op6_warc": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    whole = spark.read.parquet(f"{folder}/{table}.parquet")
    assert out.select(key).distinct().count() == whole.count()
