"""Token counts: huge texts are encoded in overlapping chunks that are spliced where both agree.

A byte-level tokenizer scans a text from left to right into pieces and merges inside each piece, and
the scan keeps no state: what follows a piece border depends on the characters after it alone. So

* a border of a chunk that starts at a true border is true, unless the chunk ends too soon after it
  for the scan to have seen the run to its end or a special string that begins there;
* where such a border is also a border of the next chunk, the two scans are one from there on.

``spliced`` counts tokens up to the first common border of each overlap, goes on in the next chunk,
and encodes twice as much from the last proven border on where an overlap has no common border (one
run of letters or spaces longer than the overlap). Memory is bounded by a few chunks' encodings.

Null text counts as empty, an empty text has no tokens. Repeated rows, repeated or null ids and
further columns stay as they are; an empty table gives no rows. No row leaves its task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketspark.llm.common import text_of

TOKENIZER = "byte_bpe_50k.json"
CHUNK = 32_768  # characters a chunk moves on; a text of up to CHUNK + OVERLAP is encoded at once
OVERLAP = 512
AT_ONCE = 16  # chunks encoded at once
REMEMBERED = 500_000  # counts of words a worker remembers at most
LIMIT = 512

_before_space = re.compile(r"\s ")
_loaded: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """Counts of one vocabulary file, as its library gives them without begin, end or padding."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap, self.known = chunk, overlap, {}
        self.stateless, self.margin = False, 0
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(pieces.encode(text, num_threads=1))
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        scan, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.stateless = (
            not spec.get("normalizer")
            and scan.get("type") == "ByteLevel"
            and scan.get("use_regex", True)
            and not scan.get("add_prefix_space")
            and not any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip"))
            and not any(re.search(r"\s", t["content"]) for t in added)
        )
        self.margin = 2 + max((len(t["content"]) for t in added), default=0)
        self.whole = lambda text: len(self.library.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        if not self.stateless:
            return self.whole(text)
        if len(text) > self.chunk + self.overlap:
            return self.spliced(text)
        return self.by_words(text)

    def by_words(self, text: str) -> int:
        """Between a character that is no white space and a space there always is a border."""
        words = text.split(" ")
        if len(words) < 8 or _before_space.search(text):
            return self.whole(text)
        inner = words[1:-1]
        known = self.known
        new = [w for w in set(inner) if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(inner))
            joined = self.library.encode(" " + " ".join(new), add_special_tokens=False)
            at, begun, last = 0, 0, len(joined)
            for word, after in zip(new, [*new[1:], None]):
                at += 1 + len(word)
                end = last if after is None else joined.char_to_token(at)
                known[word], begun = end - begun, end
        return self.whole(words[0]) + sum(map(known.__getitem__, inner)) + self.whole(" " + words[-1])

    def spliced(self, text: str) -> int:
        total, left = 0, None
        for right in self.chunks(text):
            if left is None:
                left, at = right, 0
                continue
            if right.end <= left.end:
                continue  # a widened chunk holds it
            if (common := left.common(right, max(at, right.start), left.end - self.margin)) is None:
                left = self.view(text, at, min(len(text), at + 2 * (right.end - at)))
                continue
            total += left.before(common) - left.before(at)
            left, at = right, common
        return total + len(left.encoded) - left.before(at)

    def chunks(self, text: str) -> Iterator["View"]:
        starts = range(0, len(text), self.chunk)
        for first in range(0, len(starts), AT_ONCE):
            spans = [(s, min(len(text), s + self.chunk + self.overlap)) for s in starts[first : first + AT_ONCE]]
            for (s, e), encoded in zip(spans, self.library.encode_batch([text[s:e] for s, e in spans], add_special_tokens=False)):
                yield View(s, e, encoded)

    def view(self, text: str, start: int, end: int) -> "View":
        return View(start, end, self.library.encode(text[start:end], add_special_tokens=False))


class View:
    """The encoding of the characters ``start`` to ``end`` of a text; positions are the text's."""

    def __init__(self, start: int, end: int, encoded):
        self.start, self.end, self.encoded = start, end, encoded

    def border(self, position: int) -> int | None:
        """Tokens before ``position`` if a piece begins there."""
        token = self.encoded.char_to_token(position - self.start)
        if token is None:
            return None
        word = self.encoded.token_to_word(token)
        begins = self.encoded.word_to_chars(word)[0] + self.start == position
        return self.encoded.word_to_tokens(word)[0] if begins else None

    def before(self, border: int) -> int:
        return len(self.encoded) if border == self.end else self.border(border)

    def common(self, other: "View", low: int, high: int) -> int | None:
        """The first border from ``low`` to ``high`` of both."""
        position = low
        while position <= high:
            token = self.encoded.char_to_token(position - self.start)
            if token is None:
                return None
            begin, end = self.encoded.word_to_chars(self.encoded.token_to_word(token))
            if begin + self.start == position and other.border(position) is not None:
                return position
            position = end + self.start
        return None


def counter(name: str) -> TokenCounter:
    """One counter per worker and file; a name without a folder is one of the public files."""
    if name not in _loaded:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _loaded[name] = TokenCounter(path)
    return _loaded[name]


def counted(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text as ``into``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        counts = counter(tokenizer)
        for batch in batches:
            yield pd.Series([counts.count(t) for t in batch], dtype="int64")

    return docs.withColumn(into, count(text_of(text)))


def query(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "text")
    return counted(sized).select(
        "doc_id",
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
