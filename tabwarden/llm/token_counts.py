"""Token counts with a whole-token shortcut.

Most words of a text are one token. Which strings are, is proved beforehand: every vocabulary
entry that can be a pre-token by itself is encoded by the library's model, and those that come
out as exactly one token form a set. In a text, pre-tokens of the set count one each; only the
others are merged, by the library's model, each distinct one once per task.

Nothing is shuffled. The set is bounded by the vocabulary, and it is what is broadcast.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import slices

#: Merged pre-tokens that a task remembers.
REMEMBERED = 400_000

#: White space of the tokenizer's patterns.
_BLANK = "\\t\\n\\x0b\\f\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The tokenizer's split pattern, for lower-cased ASCII texts and for all.
ASCII_PATTERN = rf"{_ENDINGS}|[a-zA-Z]+|[0-9]|[^\t\n\x0b\f\r\x20a-zA-Z0-9]+"
WIDE_PATTERN = rf"{_ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^{_BLANK}\p{{L}}\p{{N}}]+"


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    """The file of a public tokenizer; its package knows the place, else the folder."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand
    for themselves, the others get the code points from 256 on, in order."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokens:
    """The parts of the tokenizer that come before the merges, and the merges of one pre-token."""

    def __init__(self, file: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.ascii = re.compile(ASCII_PATTERN).findall
        self.wide = regex.compile(WIDE_PATTERN).findall
        with open(file, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.marks = {a[:2] for a in added}

    def of(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii():
            return self.ascii(text.lower())
        return self.wide(self.library.normalizer.normalize_str(text))

    def merged(self, pre_token: str) -> int:
        """Tokens of one pre-token, by the library's merges."""
        return len(self.library.model.tokenize(pre_token.encode().decode("latin-1").translate(self.letters)))

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and the texts between them."""
        if self.special is None or not any(m in text for m in self.marks):
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, parts


def whole_tokens(file: str) -> frozenset[str]:
    """The proof: pre-tokens that the library encodes as one token."""
    own = PreTokens(file)
    back = {c: b for b, c in byte_letters().items()}
    proved = set()
    for entry in own.library.get_vocab(with_added_tokens=False):
        letters = entry.removesuffix("</w>")
        if not letters or any(c not in back for c in letters):
            continue
        try:
            text = bytes(back[c] for c in letters).decode()
        except UnicodeDecodeError:
            continue
        if own.of(text) == [text] and own.merged(text) == 1:
            proved.add(text)
    return frozenset(proved)


def _count(file: str, proved):
    def run(batches):
        import pyarrow as pa

        own = PreTokens(file)
        ones = dict.fromkeys(map(sys.intern, proved.value), 1)

        class Costs(dict):
            def __missing__(self, pre_token):
                if len(self) > len(ones) + REMEMBERED:
                    self.clear()
                    self.update(ones)
                n = self[pre_token] = own.merged(pre_token)
                return n

        cost = Costs(ones).__getitem__
        for batch in slices(batches, 8 << 20):
            sizes, counts = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                special, parts = own.parts(text)
                counts.append(special + sum(sum(map(cost, own.of(part))) for part in parts))
                sizes.append(len(text) if text.isascii() else len(text.encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(documents: DataFrame, file: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text; null is empty, rows that repeat stay.

    Counts are those of the library without begin or end tokens; special strings inside texts
    are special tokens, as is its default. Columns other than ``doc_id, text`` are not looked at.
    """
    proved = documents.sparkSession.sparkContext.broadcast(whole_tokens(file))
    return documents.select("doc_id", "text").mapInArrow(_count(file, proved), "doc_id long, n_bytes long, n_tokens long")


def with_limit(counted: DataFrame, limit: int = 2048) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
