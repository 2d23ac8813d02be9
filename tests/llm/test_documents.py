"""Document operators against brute force on small, awkward inputs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from marketspark.llm import contamination, html_text, licenses, line_dedup, mixing, near_duplicates, quality, secrets, toxicity, warc
from marketspark.llm.shingles import shingle_set

BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w30", "changed")), (4, None), (5, ""), (6, "two words"), (7, "two words"),
    (8, " ".join(f"v{i}" for i in range(9000))), (9, BASE + "\n" + "x " * 40), (10, "password = abcdefgh12\nReleased under the MIT License."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 3}", len(t or ""), "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates_match_all_pairs(docs, none):
    sets = {i: set(shingle_set(t)) for i, t in TEXTS}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(near_duplicates.query(docs))
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert near_duplicates.query(none).count() == 0


def test_rows_without_an_id_stay(spark, docs):
    """They are neither dropped nor a reason to drop; documents with ids are judged as without them."""
    line = "one two three four five six seven eight nine"
    rows = [(None, BASE), (None, f"{line}\n{line}"), (1, BASE), (2, BASE), (3, line), (4, f"{line}\nown words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_duplicates.keep_one(d).collect()) == sorted((i or 0, t) for i, t in rows if i != 2)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup(d).collect())
    assert got == sorted([(0, BASE), (0, f"{line}\n{line}"), (1, BASE), (3, line), (4, "own words")])


def test_decontamination_finds_planted_and_short_items(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(20, 40))), (2, "two words"), (3, None), (4, "w1 w3")], "item_id long, text string")
    got = by_id(contamination.query(docs, bench))
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (20, 1, True)
    assert (got[6]["n_hit"], got[6]["contaminated"]) == (2, True)
    assert (got[3]["n_hit"], got[4]["n_words"], got[5]["contaminated"]) == (0, 0, False)
    assert got[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    left = {r["doc_id"] for r in contamination.decontaminate(docs, bench).collect()}
    assert left == {i for i, r in got.items() if not r["contaminated"]}
    assert contamination.query(none, bench).count() == 0


def test_mix_reaches_targets(spark, docs, none):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 10).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    per = mixing.query(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) < 0.05 * r["g"] for r in per)
    assert mixing.query(docs).where("taken > 2 * size").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.query(docs).count() == len(TEXTS)


def test_line_dedup_keeps_earliest(spark, none):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\nshort line"), (2, line.replace("five", "FIVE")), (3, line + " ten\nnew " + line[::-1]), (4, None), (5, "short line")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(d).collect()}
    assert got == {1: rows[0][1], 3: "new " + line[::-1], 4: None}
    assert line_dedup.dedup(none).count() == 0


def test_secrets_scan_each_blob_once(spark, docs):
    found, ledger = secrets.scan_with_ledger(docs.select(F.col("doc_id").alias("path"), "text"))
    assert ledger.count() == len({t or "" for _, t in TEXTS})
    assert secrets.scan_with_ledger(docs.select(F.col("doc_id").alias("path"), "text"), ledger)[1].count() == 0
    row = by_id(secrets.query(docs))[10]
    assert row["n_assign"] == 1 and row["base_sha256"] == hashlib.sha256(b"assign:0:21").hexdigest()
    assert by_id(secrets.query(docs))[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_quality_statistics_by_brute_force(spark, docs):
    def plain(t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    for t in ("", "a b c a b c", "a\na\n\nb", "x y x y x y", "# é z | a", "a\x0bb\x0cc"):
        assert quality.statistics(t)[:5] == plain(t)
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    got = by_id(quality.query(docs, labels))
    assert got[4]["base_failed"] and not got[4]["kept"] and len(got) == len(TEXTS)


def test_main_text(spark):
    run = "please read our terms before you use this site"
    rows = [
        (1, "http://h/a", "<nav>menu</nav><article><h1>T &amp; x</h1><p>one<br>two  <b>b</b></p></article><footer>f</footer>"),
        (2, "http://h/b", f"<p>{run}</p><p>own words here</p>"), (3, "http://h/c", f"<div>{run}</div><p>other</p>"), (4, None, None), (5, "http://[", ""),
    ]
    got = {r["page_id"]: r["text"] for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x\none\ntwo b", 2: "own words here", 3: "other", 4: "", 5: ""}


def test_revisits(spark):
    rows = [
        (1, "http://www.h/x/", 10, "response", {"etag": "a", "date": "1"}, 5), (2, "https://h/x", 9000, "revisit", {"etag": "W/a", "date": "2"}, 0),
        (3, "https://h/x#f", 9001, "revisit", {"etag": "b"}, 0), (4, "http://other/", 5, "revisit", {"etag": "a"}, 0), (5, None, None, None, None, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, body_chars long")).collect()}
    assert [got[i]["state"] for i in range(1, 6)] == ["full", "resolved", "mismatch", "orphan", "unusable"]
    assert got[2]["resolved_id"] == 1 and got[2]["headers"] == {"etag": "W/a", "date": "2"} and got[2]["body_chars"] == 5


def test_license_lines(docs, none):
    assert [(r["doc_id"], r["license"], r["dice"]) for r in licenses.query(docs).collect()] == [(10, "MIT", 1.0)]
    assert licenses.query(none).count() == 0


def test_toxicity_learns_held_out(spark):
    bad = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words number "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, F.lit(" horrid")).otherwise("")).alias("text"))
    labels = bad.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.query(bad, labels).where("held_out").collect()
    assert got and sum((r["doc_id"] % 3 == 0) == r["predicted"] for r in got) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in toxicity.query(bad.withColumn("text", F.lit(None).cast("string")), labels).collect())
    assert toxicity.query(bad.where("doc_id < 0"), labels).count() == 0
