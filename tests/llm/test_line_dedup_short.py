"""Equal lines of every length, against a plain Python version."""

import re

import corpus_pipeline
from marketspark.llm import line_dedup

LINE = "one two three four five six seven eight nine"
ROWS = [
    (1, f"{LINE}\nshort line\nHome"), (2, "Home\n Home \nshort  line\nShort line"), (3, LINE.replace("five", "FIVE") + "\nshort line too"),
    (4, None), (5, "short line"), (None, "short line\nHome"), (6, "\n\nown"), (7, "a b c d e f g"), (8, "a b c d e f g h"),
]


def _plain(rows):
    """Earlier lines drop a line that equals one, or is within one word of one if both have eight."""
    def near(a, b):
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        return any(a[:i] == b[:i] and (a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]) for i in range(max(len(a), len(b)) + 1))

    earlier, out = [], {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            ws = line.split()
            if not ws or not any(ws == e or near(ws, e) for e in earlier):
                kept.append(line)
            if ws:
                earlier.append(ws)
        out[i] = kept
    return out


def test_equal_short_lines_drop(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    plain = _plain(ROWS)
    rows = line_dedup.query(d).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["n_lines"] - r["n_dropped"] for r in rows} == {i: len(x) for i, x in plain.items()}
    got = {r["doc_id"] or 0: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, d, "").collect()}
    assert got == {0: "short line\nHome", 4: None, 6: "\n\nown"} | {i: "\n".join(x) for i, x in plain.items() if any(y.split() for y in x) and i not in (4, 6)}
    assert got[1] == ROWS[0][1] and got[2] == "Short line" and 5 not in got


def test_few_lines_reach_the_joins(spark, monkeypatch):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, f"{own(k)}\nshort {k}") for k in range(1, 3001)] + [(5000 + k, own(k).replace(f"w{k}x7", "other")) for k in range(1, 21)]
    tables = {}
    keep = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *more: tables.setdefault(name, keep(df, name, *more)))
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 13)  # a full bitmap lets more pass and loses nothing
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.query(d).where("n_dropped > 0").collect()} == {5000 + k for k in range(1, 21)}
    assert tables["line-members"].count() < 100  # of 520 keys of 40 lines
    passed = line_dedup._likely(d, line_dedup.F.col("doc_id"), spark.createDataFrame([(7,), (None,), (-1,)], "mark long"), "bits")
    assert 7 in {r["doc_id"] for r in passed.collect()} and passed.count() < 300 and passed.columns == d.columns


def _tables(monkeypatch):
    tables = {}
    keep = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *more: tables.setdefault(name, (df, keep(df, name, *more)))[1])
    return tables


def test_words_of_odd_white_space(spark):
    lines = ["a b", " a b", "a b ", "a  b", "a\tb", "\ta b", "a\x0bb\x0c", "a b\r", "", " ", "\t\r", "a", "a\xa0b c", "a b  é", "\U0001f600 x"]
    rows = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    ws = [[w for w in re.split(r"[\x20\x09-\x0D]+", x) if w] for x in lines]
    assert [(r["plain"], r["n"]) for r in line_dedup.lines_of(rows).orderBy("line_no").collect()] == [(" ".join(w), len(w)) for w in ws]


def test_only_lines_that_went_on_are_taken_apart(spark, monkeypatch):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, own(k)) for k in range(1, 101)] + [(5000 + k, own(k).replace(f"w{k}x7", "other ")) for k in range(1, 11)]
    tables = _tables(monkeypatch)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.query(d).where("n_dropped > 0").collect()} == {5000 + k for k in range(1, 11)}
    plan = tables["line-texts"][0]._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("Join", 1)[1].splitlines() if "Filter" in x]
    assert not any(rx in x for x in filters for rx in ("split(", "regexp"))


def test_whole_texts_pass_no_join_with_cuts(spark):
    rows = [(k, f"text {k} of its own\nsecond {k}") for k in range(1, 2001)] + [(5000 + k, f"text {k} of its own\nthird {k}") for k in range(1, 21)] + [(None, "text 1 of its own"), (7000, None), (7001, "text 2 of its own")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    rest = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup.dedup(d)
        got = {(r["doc_id"], r["text"]) for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", rest)
    assert got == {(i, t) if i is None or t is None or i < 5000 else (i, t.split("\n")[1]) for i, t in rows if i != 7001}
    sent = [n for columns, n in _exchanges(plan._jdf.queryExecution().executedPlan()) if "text" in columns]
    assert sent and max(sent) < 200  # of 2023 texts


def _exchanges(node):
    """``(columns, rows written)`` of each shuffle that has run under ``node``."""
    name, out = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return _exchanges(node.executedPlan())
    if name.endswith("QueryStage"):
        return _exchanges(node.plan())
    if name == "Exchange":
        out.append((node.output().mkString(","), node.metrics().apply("shuffleRecordsWritten").value()))
    children = node.children()
    return out + [x for i in range(children.size()) for x in _exchanges(children.apply(i))]
