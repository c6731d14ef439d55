"""Token counts by the whole-token shortcut.

For a byte-level BPE vocabulary it is proved once, on the driver, which vocabulary strings encode alone as one
token: the library's own merges give back that single token. A text is cut into pre-tokens; those that are such
strings count 1 by one dictionary lookup, and only the rest are merged by the library, each distinct one once for as
long as it stays in a bounded cache. Pre-tokens never share a merge, so the sum equals the library's count.

Special strings are one token each, as by the library's default, and cut the text around them. A text with a
character that Python's Unicode tables don't assign goes to the library whole, since the pattern's character
classes could differ there.

Defined cases: null texts are empty: 0 bytes, 0 tokens. Repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import common

# Fixed value: the pattern by which byte-level BPE vocabularies of this kind cut a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512
CACHE = 400_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}


def unassigned() -> re.Pattern:
    """Matches a character outside ASCII that this Python's Unicode tables don't assign."""
    spans: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class TokenCounter:
    """Counts of one vocabulary; holds the whole tokens and a bounded cache of merged pre-tokens."""

    def __init__(self, vocabulary: str, whole: list[str] | None = None):
        self.library = Tokenizer.from_str(vocabulary)
        described = json.loads(vocabulary)
        kind = described.get("pre_tokenizer") or {}
        self.direct = described["model"]["type"] == "BPE" and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and described.get("normalizer") is None and described.get("post_processor") is None
        added = [t for t in described["added_tokens"]]
        self.direct &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.cut, self.doubtful = regex.compile(PATTERN), unassigned()
        self.signs = byte_characters()
        model = self.library.model
        merge, signs = model.tokenize, self.signs

        class Counts(dict):
            def __missing__(self, word):
                n = self[word] = len(merge(word.encode().decode("latin-1").translate(signs)))
                return n

        if whole is None:
            whole = self.whole_tokens(described) if self.direct else []
        self.whole = whole
        self.base = dict.fromkeys(whole, 1)
        self.counts = Counts(self.base)

    def whole_tokens(self, described: dict) -> list[str]:
        """The vocabulary strings, as text, that the merges leave as one token."""
        back = {s: b for b, s in self.signs.items()}
        out = []
        for token in described["model"]["vocab"]:
            if not all(s in back for s in token):
                continue
            try:
                text = bytes(back[s] for s in token).decode()
            except UnicodeDecodeError:
                continue  # part of a character: no text is this token alone
            merged = self.library.model.tokenize(token)
            if len(merged) == 1 and merged[0].value == token:
                out.append(text)
        return out

    def count(self, text: str) -> int:
        if not self.direct or not text.isascii() and self.doubtful.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return sum(map(self.counts.__getitem__, self.cut.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.cut.findall(p))) for p in parts)

    def count_all(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            out[i] = self.count(t)
            if len(self.counts) > CACHE + len(self.base):
                self.counts.clear()
                self.counts.update(self.base)
        return out


_counters: dict[int, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the vocabulary file at path (read on the driver only)."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    shared = spark.sparkContext.broadcast((hash(vocabulary), vocabulary, TokenCounter(vocabulary).whole))  # the size of one vocabulary

    def run(batches):
        name, text, whole = shared.value
        counter = _counters.get(name) or _counters.setdefault(name, TokenCounter(text, whole))
        for batch in batches:
            d = dict(zip(batch.schema.names, batch.columns, strict=True))
            n = counter.count_all(d["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([d["doc_id"], d["n_bytes"], pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
