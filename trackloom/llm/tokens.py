"""Token ids of texts by a public byte-level tokenizer.

Method: forced-boundary splitting. A pair of bytes that occurs inside no vocabulary token can't be merged across, so
the text may be cut between them, the fragments encoded independently and the ids concatenated.
Every text, short or long, is cut at every such place; costs grow with its length, and as fragments repeat, the ids of most are known
already. Cuts are made only where the tokenizer's own splitting pattern can't notice them either (see cuts()).
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; an environment variable of the executors or an argument may name another folder.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Ids are kept of so many fragments of at most so many bytes.
KEPT, KEPT_BYTES = 300_000, 48
#: Texts that are cut at once.
BLOCK = 1000

_held: dict[str, "ByteTokenizer"] = {}


class ByteTokenizer:
    """The ranks of a .tiktoken file with its splitting pattern, encoding texts fragment by fragment."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        spec = importlib.util.spec_from_file_location("vocabulary_files", f"{folder}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        self.encoding = tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        self.free = ~inside
        self.held: dict[bytes, list[int]] = {}

    def cuts(self, data: bytes) -> np.ndarray:
        """Positions where the text may be cut: the pair of bytes around it is in no token, and the cut is one of

        - before white space that follows a character other than white space, where a piece of the pattern always ends;
        - between two ASCII letters: the pattern matches letters greedily and has no rule that looks across them.

        The rest (between white space, around apostrophes, digits and signs) stays whole, as the pattern looks ahead there.
        """
        b = np.frombuffer(data, np.uint8)
        left, right = b[:-1], b[1:]
        space = (b == 32) | ((b >= 9) & (b <= 13))
        letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        plain = (b < 128) & ~space & (b >= 33)
        ok = self.free[left, right] & ((plain[:-1] & space[1:]) | (letter[:-1] & letter[1:]))
        return np.flatnonzero(ok) + 1

    def _ids(self, fragment: bytes) -> list[int]:
        return self.encoding.encode_ordinary(fragment.decode("utf-8", "replace"))

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text without special tokens; none for a null or empty text. A special token's string is ordinary text.

        All texts are cut at forced boundaries at once; fragments come again and again, so the ids of short ones are kept.
        """
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b"".join(data)
        ends = np.cumsum([len(d) for d in data])
        if not joined:
            return [[] for _ in texts]
        cut = np.zeros(len(joined) + 1, bool)
        cut[self.cuts(joined)] = True
        cut[ends] = True
        at = np.flatnonzero(cut)
        at = at[at > 0]
        held, out, i, start = self.held, [], 0, 0
        stops = at.tolist()
        for end in ends.tolist():
            ids: list[int] = []
            while start < end:
                stop = stops[i]
                part = joined[start:stop]
                known = held.get(part)
                if known is None:
                    known = self._ids(part)
                    if len(part) <= KEPT_BYTES:
                        if len(held) >= KEPT:
                            held.clear()
                        held[part] = known
                ids += known
                start, i = stop, i + 1
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]


def tokenizer(name: str, folder: str = FOLDER) -> ByteTokenizer:
    key = f"{folder}/{name}"
    if key not in _held:
        _held[key] = ByteTokenizer(folder, name)
    return _held[key]


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """array<int> of the text's ids; an empty array for null and empty texts."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(name, folder)
        for texts in batches:
            yield pd.Series([ids for k in range(0, len(texts), BLOCK) for ids in own.encode_many(texts.iloc[k : k + BLOCK].tolist())])

    return F.pandas_udf(encode, "array<int>")(text)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """Number of ids, 0 for null and empty texts, without sending the ids back."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(name, folder)
        for texts in batches:
            yield pd.Series([len(ids) for k in range(0, len(texts), BLOCK) for ids in own.encode_many(texts.iloc[k : k + BLOCK].tolist())], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, ids of every row: no shuffle, one pass; repeated rows stay repeated, other columns are not read."""
    return documents.select(key, token_ids(documents[text], name, folder).alias("ids"))
