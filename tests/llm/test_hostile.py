"""Unclean pages and texts, null ids and repeated rows."""

import hashlib
import random
import re
import time

import pytest

from marketspark.llm import contamination, html_text, line_dedup, mixing, near_duplicates, secrets

MB = 1 << 20


@pytest.mark.parametrize(
    "page", ["<div>" * 100_000 + "</p>" * 130_000, "<a " * (MB // 3), "<!--" * (MB // 4), "<" * MB, "<a x='" * (MB // 6), "<script>" * (MB // 8), "&" * MB, "<p " + "x=" * (MB // 2), "<div>" * 90_000 + "</div>" * 90_000]
)
def test_pages_are_read_in_linear_time(page):
    start = time.process_time()
    html_text.blocks_of(page)
    assert time.process_time() - start < 10


def test_unclean_pages():
    text = lambda page: [t for _, t in html_text.blocks_of(page)]
    assert text("<p>x</p><![foo[y]]>z") == ["x", "z"]
    assert text("<p>a<!-- <p>gone</p> -->b<!-->c<!--->d<?php e>f</?g>h") == ["abcdfh"]
    assert text("a < b <b <p>d") == ["a < b d"]
    assert text("<P CLASS='ad' class='x'>gone</P>kept</nope><br/>next &lt;x&gt; &amp;amp; &nbsp;") == ["kept", "next <x> &amp;"]
    assert text("<p>one<script>if (a<b) '</p>'</script>two</p><style><p></style><div hidden>no</div>") == ["one", "two"]
    assert text("<p>before<!-- never ends <p>after") == ["before"]
    assert text("<article>in<div></article>out") == ["in"]


def test_long_runs_are_scanned_in_linear_time():
    for run in ("eyJ", "eyJaaaaaaaa.", "AKIA", "password", "password = ", "-----BEGIN ", "0123456789abcdef"):
        start = time.process_time()
        secrets.spans_of(run * (MB // len(run)))
        assert time.process_time() - start < 10


def plain_spans(text):
    """Base kinds, place by place."""
    found = []
    for kind, pattern, least in (
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        ("access", "(AKIA[A-Z0-9]+)", 16), ("hex", "([0-9a-f]+)", 32),
    ):
        at = 0
        while at < len(text):
            m = re.compile(pattern).match(text, at)
            if m and len(m.group(1) if kind == "assign" else m.group()) >= least:
                found.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
            at = m.end() if m else at + 1
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_secrets_by_brute_force_and_in_two_batches(spark):
    rng = random.Random(12)
    parts = ["password", "api_key", "ToKeN", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "abc", "é", "\n", "x.y-z", "12345678"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["base_sha256"]) for r in secrets.query(docs).collect()}
    assert got == {(i, hashlib.sha256(",".join(plain_spans(t or "")).encode()).hexdigest()) for i, t in rows}
    assert secrets.query(docs).count() == len(rows) and secrets.query(docs.where("doc_id < 0")).count() == 0
    versions = docs.selectExpr("doc_id as path", "text")
    whole, _ = secrets.scan_with_ledger(versions)
    _, first = secrets.scan_with_ledger(versions.where("path < 70"))
    second, new = secrets.scan_with_ledger(versions, first)
    show = lambda df: sorted(map(str, df.select("path", "blob", "starts", "ends", "kinds").collect()))
    assert show(second) == show(whole)
    old = {r["blob"] for r in first.collect()}
    assert old and not old & {r["blob"] for r in new.collect()}
    assert secrets.scan_with_ledger(versions, first, "2")[1].count() == len({t or "" for _, t in rows})


def plain_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    ws, hit, found = words(text), set(), set()
    for key, t in items:
        iw = words(t)
        n = min(13, len(iw))
        windows = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(("id", str(key)) if key is not None else ("text", t))
    ids = sorted(k for of, k in found if of == "id")
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def test_contamination_by_brute_force(spark):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(6)] + ["é", "Ü"]
    long = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(14, 40))) for _ in range(8)]
    items = [(i, t) for i, t in enumerate(long)] + [(None, long[0] + " end"), (None, "lonely pair"), (20, "w0 w1 w2"), (20, "w0, W1! w2"), (21, "..."), (22, None)]
    texts = [None, "", "!!", "lonely\tPAIR", "w0 w1 w2", "w1 w0"]
    for _ in range(60):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))
        texts.append(own + " | " + rng.choice(long)[rng.randrange(10) :] + " " + own[: rng.randrange(1 + len(own))])
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8]), (900, texts[9])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bits string, mark int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, row int")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = sorted(((r["doc_id"], *(r[c] for c in names)) for r in contamination.query(docs, bench).collect()), key=str)
    assert got == sorted(((i, *plain_contamination(t, items)) for i, t in rows), key=str)
    clean = contamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in clean.collect()) == sorted((-1 if i is None else i or -1) for i, t in rows if not plain_contamination(t, items)[-1])
    assert {r["n_hit"] for r in contamination.query(docs, bench.where("item_id < 0")).collect()} == {0}


def test_columns_named_like_working_ones(spark):
    names = ["of_rate", "of_source", "copy", "cut_id", "Cut_Lines", "new_text", "gone_id", "row", "bits", "at", "key", "near"]
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, body + "\nsame", "s", 9), (2, body + "\nsame", "s", 9), (3, "same", "s", 9), (None, None, None, 9)]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"k{r[0]}"] * len(names)) for r in rows], schema)
    bench = spark.createDataFrame([(1, body)], "item_id long, text string")
    kept = lambda df: {r[n] for r in df.collect() for n in names}
    assert mixing.mix(docs).columns == [*docs.columns, "copy_no"]
    assert kept(mixing.mix(docs)) <= {"k1", "k2", "k3"}
    assert kept(line_dedup.dedup(docs)) == {"k1", "kNone"}
    assert kept(near_duplicates.keep_one(docs)) == {"k1", "k3", "kNone"}
    assert kept(contamination.decontaminate(docs, bench)) == {"k3", "kNone"}
