"""Exact join of documents whose word n-gram sets have a Jaccard similarity at or over a bound."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import components, fresh
from marketspark.llm.shingles import bitmap, low_end, shingle_set
from marketspark.sources.snapshot import materialize, written

PERCENT = 80


def _names(docs: DataFrame) -> DataFrame:
    """``doc_id``, the size ``n`` of its set, a digest ``sig`` and ``low``, the hashes in the low end of the hash range."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n": [len(s) for s in sets],
                "sig": [hashlib.md5(s.tobytes()).digest() for s in sets], "low": [low_end(s) for s in sets],
            })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, sig binary, low array<long>")


def _values(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sig``, the sorted hashes of its set and their bitmap."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "sig": [hashlib.md5(s.tobytes()).digest() for s in sets],
                "hashes": sets, "bits": [bitmap(s) for s in sets],
            })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, sig binary, hashes array<long>, bits array<long>")


def _slack(n: Column, percent: int) -> Column:
    """So many hashes of a set of ``n`` may be missing in a linked set."""
    return n - F.ceil(percent * n / 100)


def _similar(overlap: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (F.col("na") + F.col("nb") - overlap)


def _sets(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's set by digest, the least id of each distinct set, and the sets that may have a link.

    A hash no other set has is missing in every linked set. Those in the low end of the hash range
    are counted for all sets; a set with more of them than a link allows is out. ``part`` numbers the
    sets of one id, should its rows have several texts.
    """
    first = materialize(_names(docs), "near-first")
    reps = first.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")).where("id is not null")
    reps = materialize(reps.withColumn("part", F.row_number().over(Window.partitionBy("id").orderBy("sig"))), "near-reps")
    mine = [F.col("doc_id").eqNullSafe(F.col("id")), first["sig"] == reps["sig"]]
    low = first.join(reps.drop("n"), mine).select("id", "part", F.explode("low").alias("token"))
    # A set repeated in full under one id counts once: least and greatest owner of a token are compared.
    owner = F.struct("id", "part")
    alone = low.groupBy("token").agg(F.min(owner).alias("owner"), F.max(owner).alias("last")).where("owner = last")
    alone = alone.groupBy("owner.id", "owner.part").agg(F.count("*").alias("alone"))
    likely = reps.join(alone, ["id", "part"], "left").where(F.coalesce("alone", F.lit(0)) <= _slack(F.col("n"), percent))
    likely = materialize(likely.select("id", "part", "sig", "n"), "near-likely")
    values = _values(docs.join(likely.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi"))
    match = [F.col("doc_id") == F.col("id"), values["sig"] == likely["sig"]]
    sets = values.join(likely, match).select("id", "part", "n", "hashes", "bits").dropDuplicates(["id", "part"])
    return first, reps, materialize(sets, "near-sets")


def _tiles(sets: DataFrame, percent: int) -> DataFrame:
    """Members ``(token, band, id, n, pos, guest)`` of all tiles with two members or more.

    Hashes are ordered by the number of sets that have them, rarest first, then by value. Linked sets
    share a hash among the first of each, so that neither has passed more hashes before it than the
    overlap of a link leaves over. Hashes of one set alone come first and need no row. A tile is a
    hash and a size band; the bound on sizes is one band wide, so a set is at home in its own band
    and a guest in the next one.
    """
    tokens = sets.select("id", "part", "n", F.explode("hashes").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    n = F.col("n")
    shared = (
        tokens.join(counts, "token").groupBy("id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("have"))
        .withColumn("passed", n - F.size("have"))
        .where(F.col("passed") <= _slack(n, percent))
        .withColumn("first", F.slice("have", 1, (_slack(n, percent) + 1 - F.col("passed")).cast("int")))
    )
    entries = shared.select("id", "n", "passed", F.posexplode("first").alias("place", "entry"))
    band = F.floor(F.ln("n") / math.log(100 / percent)) if percent < 100 else n
    # The smaller set of a pair may have passed less, so it is a guest with fewer of its hashes.
    as_smaller = F.col("pos") <= n - F.ceil(2 * percent * n / (100 + percent))
    at = F.when(as_smaller & F.lit(percent < 100), F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))
    members = (
        entries.select("id", "n", (F.col("passed") + F.col("place")).alias("pos"), F.col("entry.token").alias("token"), band.cast("int").alias("home"))
        .withColumn("band", F.explode(at)).withColumn("guest", F.col("band") != F.col("home")).drop("home")
    )
    members = materialize(members, "near-entries")
    full = members.groupBy("token", "band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("guest").alias("guests"))
    full = full.where("low < high and not guests").select("token", "band")
    return materialize(members.join(full, ["token", "band"]), "near-tiles")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Sizes and places of two members of a tile leave room for the overlap of a link."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return sizes & ((100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs ``(a, b)`` that are links.

    Bits of one bitmap missing in the other bound the overlap from above; what is left meets its
    sorted sets, which are merged. Sizes within the bound give bitmaps of one width, or one twice the
    other (``percent`` of 50 or more), which is then folded.
    """
    end = lambda x, what, as_: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col(what).alias(f"{as_}{x}"))
    wide = lambda x: (F.size(x) / 2).cast("int")
    half = lambda x: F.zip_with(F.slice(x, 1, wide(x)), F.slice(x, wide(x) + 1, wide(x)), lambda p, q: p.bitwiseOR(q))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x))
    miss = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    bound = F.least(F.col("na") - miss("fa", "fb"), F.col("nb") - miss("fb", "fa"))
    left = materialize(
        pairs.join(end("a", "bits", "b"), "a").join(end("b", "bits", "b"), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .withColumns({"fa": fit("ba", "bb"), "fb": fit("bb", "ba")}).where(_similar(bound, percent))
        .select("a", "b").distinct(),
        f"{name}-left",
    )

    def merged(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch["va"], batch["vb"]):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[linked, ["a", "b"]]

    both = left.join(end("a", "hashes", "v"), "a").join(end("b", "hashes", "v"), "b").select("a", "b", "va", "vb")
    return materialize(both.mapInPandas(merged, "a long, b long").distinct(), f"{name}-links")


def _placed(tiles: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``tiles`` with each member's ``root``, without tiles whose members are in one component."""
    roots = components(links, f"{name}-roots").withColumnRenamed("node", "id")
    placed = tiles.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("token", "band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return materialize(placed.join(mixed.select("token", "band"), ["token", "band"]), name)


def _leaders(tiles: DataFrame) -> DataFrame:
    """Each tile's leader: of those at home the one with the fewest rarer hashes, as the text others vary has."""
    lead = F.min_by(F.struct(*tiles.columns), F.when(~F.col("guest"), F.struct("pos", "id")))
    return tiles.groupBy("token", "band").agg(lead.alias("lead")).where("lead is not null").select("lead.*")


def _tile(x: DataFrame, y: DataFrame, where: Column) -> DataFrame:
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
    return x.alias("x").join(y.alias("y"), same & where)


def near_duplicate_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Each row is judged by its own text. Null, empty and wordless texts have the empty set and are
    alone. Equal sets collapse to the least id first, so a group of copies of any size is one set
    here; an id that names several sets links them. A set that only rows without an id have is not
    compared. Members of a tile first meet its leader, one leader each; where a tile still holds
    several components, its leader meets the others and is done there; only those of the rest that
    are in different components meet each other. Empty tables give no rows, very long texts are sets
    like others, and columns other than ``doc_id`` and ``text`` are not read.
    """
    first, reps, sets = _sets(docs, percent)
    tiles = _tiles(sets, percent)
    other = F.col("x.id") != F.col("y.id")
    meet = _tile(_leaders(tiles), tiles, other & _may_link("x", "y", percent)).select(F.col("x.id").alias("lead"), F.col("y.id").alias("id"))
    best = meet.groupBy("id", "lead").agg(F.count("*").alias("tiles")).groupBy("id").agg(F.max_by("lead", F.struct("tiles", "lead")).alias("lead"))
    links = _verified(best.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), sets, percent, "near-star")
    apart = F.col("x.root") != F.col("y.root")

    placed = _placed(tiles, links, "near-apart")
    lead = materialize(_leaders(placed), "near-leaders")
    links = links.union(_verified(_pairs(_tile(lead, placed, apart & _may_link("x", "y", percent))), sets, percent, "near-led"))
    rest = placed.drop("root").join(lead.select("token", "band", "id"), ["token", "band", "id"], "left_anti")

    placed = _placed(rest, links, "near-rest")
    once = (F.col("x.id") < F.col("y.id")) & ~(F.col("x.guest") & F.col("y.guest"))
    links = links.union(_verified(_pairs(_tile(placed, placed, once & apart & _may_link("x", "y", percent))), sets, percent, "near-last"))
    root = components(links, "near-roots")
    ids = reps.join(root, F.col("id") == F.col("node"), "left").select("sig", F.coalesce("root", "id").alias("component_id"))
    return _by_row(first, ids).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


query = near_duplicate_classes


def _by_row(first: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with what ``ids`` says of their set; rows with the empty set are not sent to one key."""
    found = first.where("n > 0").join(ids, "sig", "left")
    return found.unionByName(first.where("n = 0"), allowMissingColumns=True)


def linked_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``near_duplicate_classes`` and ``n_links``: how many other sets are linked to the row's set.

    All links are verified, not only those that make the components: every pair of a tile that sizes
    and places allow is a candidate once. Copies with equal sets are one. A set that only rows
    without an id have is not compared.
    """
    first, reps, sets = _sets(docs, percent)
    tiles = _tiles(sets, percent)
    once = (F.col("x.id") < F.col("y.id")) & ~(F.col("x.guest") & F.col("y.guest"))
    links = _verified(_pairs(_tile(tiles, tiles, once & _may_link("x", "y", percent))), sets, percent, "near-all")
    ends = links.select(F.col("a").alias("end")).union(links.select("b")).groupBy("end").agg(F.count("*").alias("links"))
    root = components(links, "near-all-roots")
    ids = reps.join(root, F.col("id") == F.col("node"), "left").join(ends, F.col("id") == F.col("end"), "left")
    ids = ids.select("sig", F.coalesce("root", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return _by_row(first, ids).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.when(F.col("n") == 0, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose class is named by another id.

    A repeated row stays as often as it is there, and so do rows without an id, as nothing names
    them. What is joined are the ids that go.
    """
    name = fresh(docs, "gone_id")

    def named_by_others() -> DataFrame:
        classes = near_duplicate_classes(docs).where("doc_id is not null")
        return classes.groupBy("doc_id").agg(F.max("component_id").alias("root")).where("root < doc_id").select(F.col("doc_id").alias(name))

    gone = written(docs.sparkSession, named_by_others, "near-gone")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on l.a = r.b)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from w left join n on n.doc_id = w.doc_id join (select a as doc_id, min(b) as component_id from r group by a) c on c.doc_id = w.doc_id
"""
