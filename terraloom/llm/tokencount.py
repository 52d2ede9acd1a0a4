"""Token counts under a byte-level BPE vocabulary, with a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone by the vocabulary's own
library. Those that come out as one token are proven: wherever such a string is a whole
pre-token it counts one, with no merging. Only the other pre-tokens are merged, once each as long
as they stay in a task's table of known counts.

A text is cut at the vocabulary's added special strings first (each counts one token, as the
library does by default), then into pre-tokens by the pattern of the vocabulary file's
pre-tokenizer. No begin, end or added tokens, no truncation, no padding.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by
one; an empty table gives no rows; other input columns are ignored. A text is processed whole at
any length; the table of known counts starts anew when it holds ``KNOWN_MAX`` strings, which bounds
a task's memory and changes no count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraloom.llm.common import utf8

#: Fixed value: the split of byte-level pre-tokenizers, white space being Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
KNOWN_MAX = 400_000
LAZY = 1 << 20  # characters from which pre-tokens are taken one at a time instead of as a list


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def proven(path: str) -> frozenset[str]:
    """Strings of the vocabulary that the library encodes, alone, as exactly one token."""
    tok = Tokenizer.from_file(path)
    back = {chr(c): b for b, c in byte_letters().items()}
    texts = []
    for piece in tok.get_vocab(with_added_tokens=False):
        if all(c in back for c in piece):
            try:
                texts.append(bytes(back[c] for c in piece).decode())
            except UnicodeDecodeError:  # a part of a character is never a whole pre-token
                continue
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


class Counts(dict):
    """Tokens by pre-token: 1 for the proven ones; the rest are merged when first met."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError("the vocabulary's pre-tokenizer is not a plain byte-level one")
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.letters = byte_letters()
        self.merge = Tokenizer.from_file(path).model.tokenize
        super().__init__(dict.fromkeys(whole, 1))
        self.whole = whole

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) >= KNOWN_MAX:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n

    def of(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut else [text]
        count = len(parts) - 1
        for p in parts:
            pieces = self.split.findall(p) if len(p) < LAZY else (m.group() for m in self.split.finditer(p))
            count += sum(map(self.__getitem__, pieces))
        return count


@lru_cache(maxsize=2)
def _counts(path: str, whole: frozenset[str]) -> Counts:
    return Counts(path, whole)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``vocabulary`` is the path of the vocabulary file, readable on the driver and on every
    executor (it is part of an installed package, never data).
    """
    whole = docs.sparkSession.sparkContext.broadcast(proven(vocabulary))  # a part of the vocabulary, so bounded by it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(vocabulary, whole.value)
        for b in batches:
            sizes, tokens = [], []
            for t in utf8(b.column(1)):
                sizes.append(len(t))
                tokens.append(counts.of(t.decode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = narrow.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
