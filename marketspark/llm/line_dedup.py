"""Drop lines that repeat an earlier line up to one word, by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import SPACE, fresh, text_of, words
from marketspark.sources.snapshot import materialize, written

LEAST_WORDS = 8  # shorter lines drop only if equal: one edit would make most of them alike
MOST_BITS = 1 << 27  # of a bitmap before a join; a fuller one lets more rows pass to the exact join


def _same_ends(a: str, b: str) -> Column:
    """Word edit distance of the arrays is at most 1: their common ends cover all but one word."""
    ahead = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    back = F.array_position(F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x.eqNullSafe(y)), False)
    longest = F.greatest(F.size(a), F.size(b))
    return (ahead == 0) | (ahead - 1 + back - 1 >= longest - 1)


def _plain(line: Column) -> Column:
    """The words of a line joined by a space. A line that is so already is only searched, not taken apart."""
    odd = line.startswith(" ") | line.endswith(" ")
    for found in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(found)
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def _count() -> Column:
    """The words of ``plain``."""
    spaces = F.octet_length("plain") - F.octet_length(F.replace(F.col("plain"), F.lit(" "), F.lit("")))
    return F.when(F.col("plain") == "", 0).otherwise(spaces + 1)


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, plain, n)`` of every line: its words joined by a space, and how many.

    Null text has one empty line. ``plain`` is made inside the generator, so once per line; ``n``
    counts its spaces where a query asks for it.
    """
    split = docs.select("doc_id", F.posexplode(F.transform(F.split(text_of(), "\n"), _plain)).alias("line_no", "plain"))
    return split.select("doc_id", "line_no", "plain", _count().alias("n"))


def _key() -> Column:
    return F.unhex(F.md5("plain"))


def _likely(rows: DataFrame, mark: Column, marks: DataFrame, name: str) -> DataFrame:
    """``rows`` without those whose ``mark`` has no bit in a bitmap of the column ``mark`` of ``marks``."""
    return _parted(rows, mark, marks, name)[0]


def _parted(rows: DataFrame, mark: Column, marks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``mark`` has a bit in a bitmap of the column ``mark`` of ``marks``, and the others.

    For an exact join of a large table with a small one that need not fit a broadcast: what cannot
    match is not shuffled. The bitmap has 32 bits a mark, MOST_BITS at most, in pieces of 1 KB.
    """
    bits = min(MOST_BITS, 1 << max(13, (32 * marks.count() - 1).bit_length()))
    slot, word, words_ = (fresh(rows, c) for c in ("bit_slot", "bit_word", "bit_words"))
    at = F.pmod(F.xxhash64("mark"), F.lit(bits))
    own = marks.select(at.alias("bit")).groupBy(F.expr("bit div 8192").alias(slot), F.expr("cast(bit div 64 % 128 as int)").alias(word))
    own = own.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set"))
    pieces = own.groupBy(slot).agg(F.map_from_entries(F.collect_list(F.struct(word, "set"))).alias("set"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.element_at("set", i), F.lit(0).cast("long")))
    pieces = materialize(pieces.select(F.col(slot).alias(slot), dense.alias(words_)), name)
    bit = fresh(rows, "bit")
    placed = rows.withColumn(bit, F.pmod(F.xxhash64(mark), F.lit(bits)))
    set_ = F.expr(f"shiftright(get({words_}, cast({bit} div 64 % 128 as int)), cast({bit} % 64 as int)) & 1L = 1L")
    kind = lambda how: placed.join(F.broadcast(pieces), (F.expr(f"{bit} div 8192") == F.col(slot)) & set_, how).select(*rows.columns)
    return kind("left_semi"), kind("left_anti")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``(key, at, near)`` of each distinct line that stands twice or is near an earlier line.

    ``at`` is the earliest place and names the line from then on; ``near`` says whether an earlier
    line is within one word of it. Lines are compared as word sequences. Equal lines meet first, by
    a grouped minimum. One edit between a line of N words and one of N or N - 1 leaves the first
    N div 2 words or the remaining ones as they are, so only distinct lines that share such a part,
    for the same N, go on; for those, each deletion of one word, and the line itself, is a key, and
    lines with an equal key have their distance verified. Before each join with the few rows that
    went on, a bitmap of them keeps most of the others out of the shuffle. Lines of fewer than LEAST_WORDS words have
    no parts: they end at the grouped minimum. Lines without a word are no lines here.
    """
    lines = lines_of(docs).where((F.col("plain") != "") & F.col("doc_id").isNotNull())
    end = lambda m: F.call_function("substring_index", F.col("plain"), F.lit(" "), m)
    ahead = lambda longer: F.floor(longer / 2).cast("int")
    parts = lambda longer: (F.xxhash64(longer, end(ahead(longer))), F.xxhash64(-longer, end(ahead(longer) - longer)))
    first = materialize(
        lines.select(_key().alias("key"), "doc_id", "line_no", F.when(F.col("n") >= LEAST_WORDS, F.array(*parts(F.col("n")), *parts(F.col("n") + 1))).alias("parts"))
        .groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("times"), F.max("parts").alias("parts")),
        "line-first",
    )
    halves = first.select("at", F.explode("parts").alias("part"))
    shared = materialize(halves.groupBy("part").count().where("count > 1").select("part"), "line-shared")
    both = _likely(halves, F.col("part"), shared.select(F.col("part").alias("mark")), "line-shared-bits").join(shared, "part")
    chosen = materialize(both.select("at.doc_id", "at.line_no").distinct(), "line-chosen")
    place = F.xxhash64("doc_id", "line_no")
    raw = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line"))
    found = _likely(raw, place, chosen.select(place.alias("mark")), "line-chosen-bits").join(chosen, ["doc_id", "line_no"])
    # The floor is a value of the aggregate: as a filter it would go below the join, to every line.
    long_ = found.select("doc_id", "line_no", _plain(F.col("line")).alias("plain")).withColumn("n", _count())
    long_ = long_.groupBy("doc_id", "line_no").agg(F.max(F.when(F.col("n") >= LEAST_WORDS, F.col("plain"))).alias("plain"))
    texts = materialize(long_.where("plain is not null").select(F.struct("doc_id", "line_no").alias("at"), F.split("plain", " ").alias("ws")), "line-texts")
    # Dealt out by line once: the windows and the set of keys of a line need no further shuffle.
    word = texts.repartition("at").select("at", F.posexplode("ws").alias("i", "w")).select("at", "i", F.xxhash64("w", "i").alias("here"), F.xxhash64("w", F.col("i") - 1).alias("moved"))
    whole = Window.partitionBy("at")
    upto = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    all_ = F.expr("bit_xor(here)").over(whole)
    less = F.expr("bit_xor(here)").over(upto).bitwiseXOR(F.col("here")).bitwiseXOR(F.expr("bit_xor(moved)").over(whole)).bitwiseXOR(F.expr("bit_xor(moved)").over(upto))
    variants = word.select("at", less.alias("v"), F.when(F.col("i") == 0, all_).alias("all")).groupBy("at").agg(F.collect_set("v").alias("vs"), F.max("all").alias("all"))
    variants = materialize(variants.select("at", F.array_union("vs", F.array("all")).alias("vs")), "line-variants")
    # Per variant the earliest line meets the rest, then each line that this leaves open the earlier ones.
    there = variants.select("at", F.explode("vs").alias("v"))
    lead = materialize(there.groupBy("v").agg(F.min("at").alias("lead"), F.count("*").alias("k")).where("k > 1").select("v", "lead"), "line-leads")
    there = materialize(_likely(there, F.col("v"), lead.select(F.col("v").alias("mark")), "line-lead-bits"), "line-members")
    met = materialize(there.join(lead, "v").where("at > lead"), "line-met")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(texts.select("at", F.col("ws").alias("wa")), "at").join(texts.select(F.col("at").alias("other"), F.col("ws").alias("wb")), "other")
        return materialize(both.where(_same_ends("wa", "wb")).select("at").distinct(), name)

    near = verified(met.select("at", F.col("lead").alias("other")).distinct(), "line-near")
    open_ = met.join(near, "at", "left_anti").select("v", "at")
    more = open_.join(there.select("v", F.col("at").alias("other")), "v").where("other < at").select("at", "other").distinct()
    near = near.union(verified(more, "line-more")).withColumn("near", F.lit(True))
    found = first.select("key", "at", "times").join(near, "at", "left").select("key", "at", "times", F.coalesce("near", F.lit(False)).alias("near"))
    return found.where((F.col("times") > 1) | F.col("near")).select("key", "at", "near")


def line_decisions(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, n, kept)`` per line: dropped if an earlier line (by document id, then
    line number) equals it or differs in one word. Equal lines drop whatever
    their length, one edit counts from LEAST_WORDS words on; lines without a word stay. The lines of rows without an id stay; they have no place
    in that order and stand for no other line."""
    found = materialize(repeated_lines(docs), "line-found")
    lines = lines_of(docs).select("doc_id", "line_no", "n", F.when((F.col("plain") != "") & F.col("doc_id").isNotNull(), _key()).alias("key"))
    joined = lines.join(found.select(F.col("key").alias("k"), "at", "near"), F.col("key") == F.col("k"), "left")
    earliest = (F.col("at.doc_id") == F.col("doc_id")) & (F.col("at.line_no") == F.col("line_no"))
    return joined.select("doc_id", "line_no", "n", (F.col("k").isNull() | (earliest & ~F.col("near"))).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with dropped lines cut from ``text`` and ``n_chars`` set anew.

    A document without dropped lines stays as it is, null and empty ones too. One that loses lines
    and has no word left goes: every line of it stands elsewhere.
    """
    of, gone, text = (fresh(docs, name) for name in ("cut_id", "cut_lines", "new_text"))

    def cuts() -> DataFrame:
        dropped = line_decisions(docs).where(~F.col("kept"))
        return dropped.groupBy(F.col("doc_id").alias(of)).agg(F.array_sort(F.collect_set("line_no")).alias(gone))

    def shown(rows: DataFrame, now: Column) -> DataFrame:
        return rows.select(*(now.alias("text") if c == "text" else F.length(now).cast("long").alias("n_chars") if c == "n_chars" else rows[c] for c in docs.columns))

    cut = written(docs.sparkSession, cuts, "line-cuts")
    # Most texts without a dropped line are told by a bitmap of the cut ids and not shuffled.
    some, whole = _parted(docs, F.col("doc_id"), cut.select(F.col(of).alias("mark")), "line-cut-bits")
    new = F.array_join(F.filter(F.split(text_of(), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    joined = some.join(cut, some["doc_id"] == cut[of], "left").withColumn(text, F.when(F.col(gone).isNull(), F.col("text")).otherwise(new))
    left = joined.where(F.col(gone).isNull() | (F.col(text).rlike(r"[^\x20\x09-\x0D]")))
    return shown(left, F.col(text)).unionByName(shown(whole, F.col("text")))


def query(docs: DataFrame) -> DataFrame:
    """Per document: its lines, how many of them are dropped and kept."""
    return line_decisions(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.when(F.col("kept"), 0).otherwise(1)).cast("long").alias("n_dropped"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).cast("long").alias("n_words_kept")
    )


SQL = r"""
with l as (select doc_id, unnest(range(len(s))) as line_no, unnest(s) as line from (select doc_id, string_split(coalesce(text,''), chr(10)) as s from documents)),
w as (select doc_id, line_no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from l),
k as (select *, len(ws) as n, array_to_string(ws, ' ') as key from w),
f as (select key, any_value(ws) as ws, any_value(n) as n, min((doc_id, line_no)) as first_at from k where n > 0 group by key),
v as (select key, first_at, ws, n, 0 as i, key as var from f where n >= 8 union all
      select key, first_at, ws, n, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') from (select *, unnest(range(1, n + 1)) as i from f where n >= 8)),
p as (select distinct a.key, a.ws as wa, b.ws as wb, a.n as na, b.n as nb from v a join v b on a.var = b.var and b.first_at < a.first_at),
e as (select distinct key from p where list_aggregate(list_transform(range(0, greatest(na, nb) + 1), lambda i: case when
        i <= least(na, nb) and wa[1:i] = wb[1:i] and (wa[i + 2:] = wb[i + 2:] or wa[i + 1:] = wb[i + 2:] or wa[i + 2:] = wb[i + 1:]) then 1 else 0 end), 'max') = 1)
select k.doc_id, count(*) as n_lines,
       cast(sum(case when k.n = 0 or (f.first_at = (k.doc_id, k.line_no) and e.key is null) then 0 else 1 end) as bigint) as n_dropped,
       cast(sum(case when k.n = 0 or (f.first_at = (k.doc_id, k.line_no) and e.key is null) then k.n else 0 end) as bigint) as n_words_kept
from k left join f on f.key = k.key left join e on e.key = k.key group by k.doc_id
"""
