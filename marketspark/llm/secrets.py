"""Secret scan over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketspark.llm.common import text_of
from marketspark.sources.snapshot import materialize

VERSION = "1"
KINDS = ("assign", "access", "hex")
# The patterns of the base kinds.
PATTERNS = {
    "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    # Further kinds of this scanner.
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # Begins at a border and never gives back what it has read, so long runs are read a few times at most.
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32, "pem": 0, "jwt": 0}


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all findings, by start, then kind, in time in proportion to the text."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def scan(blobs: DataFrame) -> DataFrame:
    """``(blob, starts, ends, kinds)`` of each ``(blob, text)``."""

    def run(batches):
        for batch in batches:
            found = [spans_of(t) for t in batch["text"]]
            yield pd.DataFrame({"blob": batch["blob"], "starts": [[x[0] for x in f] for f in found], "ends": [[x[1] for x in f] for f in found], "kinds": [[x[2] for x in f] for f in found]})

    return blobs.select("blob", "text").mapInPandas(run, "blob string, starts array<long>, ends array<long>, kinds array<string>")


def scan_with_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings per row of ``versions(path, text)`` and the new ledger rows.

    A blob is the SHA-256 of a text; null counts as empty. The ledger has a row
    ``(blob, rules, starts, ends, kinds)`` for each scanned pair, also those without findings. Only
    pairs not in it are scanned, each once, however many paths hold the blob: its least path stands
    for it, so texts move once and a hot blob never gathers in one task. Repeated rows each have
    their findings, an empty table has none, texts are read whole; a null path stays.
    """
    named = versions.select("path", F.sha2(text_of(), 256).alias("blob"))
    ids = named.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        ids = ids.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    ids = materialize(ids, "unseen-blobs").select("blob", F.col("path").alias("least_path"))
    texts = versions.select("path", text_of().alias("text")).withColumn("own", F.sha2("text", 256))
    unseen = texts.join(ids.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("least_path")) & (F.col("own") == F.col("blob")))
    new = materialize(scan(unseen).dropDuplicates(["blob"]).withColumn("rules", F.lit(rules)), "ledger-new")
    whole = new if ledger is None else ledger.where(F.col("rules") == rules).select(*new.columns).union(new)
    found = whole.where(F.size("starts") > 0).select("blob", "starts", "ends", "kinds")
    return named.join(found, "blob", "left").select("path", "blob", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("starts", "array<long>"), ("ends", "array<long>"), ("kinds", "array<string>"))]), new


def query(docs: DataFrame) -> DataFrame:
    found, _ = scan_with_ledger(docs.select(F.col("doc_id").alias("path"), "text"))
    label = lambda keep: F.array_join(F.filter(F.transform(F.arrays_zip("starts", "ends", "kinds"), lambda x: F.when(keep(x["kinds"]), F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")))), lambda x: x.isNotNull()), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(label(lambda k: k.isin(*KINDS)), 256).alias("base_sha256"), label(lambda k: F.lit(True)).alias("spans")
    )
