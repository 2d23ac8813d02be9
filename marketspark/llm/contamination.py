"""Benchmark decontamination by winnowing: fingerprints, a join, and extension along diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import let, lower_ascii, text_of
from marketspark.sources.snapshot import materialize, written

WINDOW = 13
GRAM = 5
BITS = 1 << 20  # bits of the bitmap; fuller ones let more texts pass to the exact join
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def _grams(ws: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(size)]))


def marks_of(ws: Column) -> Column:
    """The least hash of each run of WINDOW - GRAM + 1 grams, once per value.

    Any WINDOW words that two texts share hold such a run in both, so both keep its least hash.
    Texts shorter than WINDOW have no marks.
    """
    run = WINDOW - GRAM + 1
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - run), lambda i: F.least(*[F.get(g, i + j) for j in range(run)]))
    return let(ws, lambda w: F.when(F.size(w) >= WINDOW, F.array_distinct(let(_grams(w, GRAM), least))))


def bitmap_of(marks: DataFrame) -> DataFrame:
    """One row ``bits`` of BITS bits, in longs, with a bit for each ``mark``."""
    slot = F.pmod(F.shiftright("mark", 6), F.lit(BITS // 64))
    own = marks.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bits"))
    all_ = marks.sparkSession.range(BITS // 64).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"))
    words = own.union(all_).groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("slot", "bits")))["bits"].alias("bits"))


def _in_bitmap(marks: Column) -> Column:
    """Whether any of ``marks`` has its bit in the column ``bits``."""
    word = lambda m: F.get("bits", F.pmod(F.shiftright(m, 6), F.lit(BITS // 64)).cast("int"))
    return F.exists(marks, lambda m: F.call_function("shiftright", word(m), m.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(row, doc_id, n_words, n_hit, n_items, items)`` per row of ``docs``.

    ``items`` are the ids with an occurring window; items of one id are one, items without an id
    count by their text and have none to list. Null, empty and wordless texts have no hits, and
    items without words none either. Equal rows give equal results, an empty benchmark no hits.
    Windows of items shorter than WINDOW are looked up by their exact length, at most WINDOW - 1
    lengths. Texts of any length are read whole.

    In one pass over the texts, each meets a bitmap of the benchmark's marks, of BITS bits whatever
    the benchmark; a text without a mark in it holds no window and is neither shuffled nor read
    again. The texts that have one, by chance too, are written once and go on with exact keys.
    """
    named = F.coalesce(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.concat(F.lit("t"), F.md5(text_of())))
    items = materialize(benchmark.select(named.alias("item"), plain_words(text_of()).alias("iw")).where("size(iw) > 0"), "bench-items")
    marks = items.select("item", F.explode(marks_of(F.col("iw"))).alias("mark")).distinct()
    lengths = [r.n for r in items.select(F.size("iw").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]
    for n in sorted(lengths):
        marks = marks.union(items.where(F.size("iw") == n).select("item", F.xxhash64(*[F.col("iw")[j] for j in range(n)]).alias("mark")))
    marks = materialize(marks, "bench-marks")
    bits = materialize(bitmap_of(marks), "bench-bitmap")

    def keys(ws: Column) -> Column:
        """Marks of the text, and its windows of the lengths of short items."""
        none = F.array().cast("array<bigint>")
        short = [F.when(F.size(ws) >= n, _grams(ws, n)).otherwise(none) for n in sorted(lengths)]
        return F.concat(F.coalesce(marks_of(ws), none), *short)

    texts = docs.select("doc_id", F.md5(text_of()).alias("row"), plain_words(text_of()).alias("ws"))
    met = texts.crossJoin(F.broadcast(bits)).where(let(F.col("ws"), lambda w: _in_bitmap(keys(w))))  # one row of BITS / 8 bytes
    chosen = materialize(met.select("row", "ws"), "bench-met").dropDuplicates(["row"])
    chosen = materialize(chosen, "bench-texts")
    pairs = materialize(
        chosen.select("row", F.explode(F.array_distinct(keys(F.col("ws")))).alias("mark")).join(marks, "mark").select("row", "item").distinct(), "bench-pairs"
    )

    # Each candidate text with its words placed: the window at i meets the windows of the items.
    spans = materialize(
        items.withColumn("n", F.least(F.size("iw"), F.lit(WINDOW)))
        .select("item", "n", F.posexplode(F.expr("transform(sequence(0, size(iw) - n), i -> slice(iw, i + 1, n))")).alias("j", "span"))
        .select("item", "n", F.xxhash64("span").alias("h"), "span").dropDuplicates(["item", "h", "span"]),
        "bench-spans",
    )
    sized = pairs.join(items.select("item", F.least(F.size("iw"), F.lit(WINDOW)).alias("n")), "item").select("row", "n").distinct()
    placed = (
        chosen.join(sized, "row").where("size(ws) >= n")
        .select("row", "n", F.posexplode(F.expr("transform(sequence(0, size(ws) - n), i -> slice(ws, i + 1, n))")).alias("i", "span"))
        .withColumn("h", F.xxhash64("span"))
    )
    hits = materialize(placed.join(spans, ["n", "h", "span"]).select("row", "item", "i", "n"), "bench-hits")
    until = F.max(F.col("i") + F.col("n")).over(Window.partitionBy("row").orderBy("i", "n").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("i") + F.col("n") - F.greatest(F.col("i"), F.coalesce(until, F.lit(0))))
    covered = hits.select("row", "i", "n").distinct().withColumn("new", new).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    named = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = materialize(covered.join(named, "row"), "bench-result")
    counted = texts.select("doc_id", "row", F.size("ws").cast("long").alias("n_words"))
    listed = F.array_sort(F.transform(F.filter("items", lambda x: x.startswith("i")), lambda x: F.substring(x, 2, 1 << 30)))
    return counted.join(result, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(listed, F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated_words(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, null texts included in what stays."""
    found = lambda: contaminated_words(docs, benchmark).where(is_contaminated()).select("row").distinct()
    bad = written(docs.sparkSession, found, "bench-bad")
    return docs.join(bad, F.md5(text_of()) == bad["row"], "left_anti")


SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(lower_a, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
           from (select doc_id, translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_a from documents)),
b as (select coalesce('i' || cast(item_id as varchar), 't' || md5(coalesce(text, ''))) as item_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as iw from benchmark),
s as (select distinct item_id, n, unnest(list_transform(range(1, len(iw) - n + 2), lambda j: array_to_string(iw[j:j + n - 1], ' '))) as span
      from (select item_id, iw, least(len(iw), 13) as n from b where len(iw) > 0)),
w as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) as i, unnest(list_transform(range(1, len(ws) - n + 2), lambda j: array_to_string(ws[j:j + n - 1], ' '))) as span
      from d, (select distinct n from s) where len(ws) >= n),
h as (select w.doc_id, s.item_id, w.i, w.n from w join s on w.n = s.n and w.span = s.span),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
k as (select doc_id, count(*) as n_items, string_agg(item[2:], ',' order by item) filter (where item[1] = 'i') as items from (select distinct doc_id, item_id as item from h) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join c on c.doc_id = d.doc_id left join k on k.doc_id = d.doc_id
"""
