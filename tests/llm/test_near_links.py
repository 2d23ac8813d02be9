"""Links per document against all pairs."""

from marketspark.llm import near_duplicates
from marketspark.llm.shingles import shingle_set

BASE = [f"w{i}" for i in range(60)]


def test_links_match_all_pairs(spark):
    texts = [" ".join(BASE[:-1] + [f"end{k}"]) for k in range(12)]  # linked all with all
    texts += [texts[0], " ".join(BASE[: 50 + 2]), " ".join(f"start{i}" for i in range(9)) + " " + " ".join(BASE), "few words", "few words", "", None]
    rows = list(enumerate(texts, 1))
    sets = {i: frozenset(shingle_set(t).tolist()) for i, t in rows}
    linked = lambda x, y: x != y and 100 * len(x & y) >= 80 * len(x | y)
    links = {i: sum(linked(s, o) for o in set(sets.values())) for i, s in sets.items()}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates.linked_classes(d).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == links and links[1] >= 11 and links[13] == links[1]
    classes = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.query(d).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == classes


def test_large_group_repeated_ids_and_missing_ids(spark):
    """1,000 near copies all linked; an id with two texts and rows without an id are judged by their own text."""
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(base[:-1] + [f"tail{i}"])) for i in range(1, 1001)]
    rows += [(5, " ".join(f"z{i}" for i in range(40))), (2000, " ".join(f"z{i}" for i in range(39)) + " y"), (None, rows[0][1]), (None, "alone here"), (3000, rows[7][1]), (3000, rows[7][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_duplicates.linked_classes(d).collect()]
    assert len(got) == len(rows)
    of = {i: {r[1:] for r in got if r[0] == i} for i in {r[0] for r in got}}
    assert all(of[i] == {(196, 1, 999)} for i in range(1, 1001) if i != 5)
    assert of[3000] == {(196, 1, 999)} and (196, 1, 999) in of[None] and (1, None, None) in of[None]
    assert {r[1:] for r in [tuple(x) for x in near_duplicates.query(d).collect()] if r[0] == 2000} == {(36, 1)}
