"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

Splice rule. Let the left chunk begin at a true pre-token boundary. Its boundaries are then true
ones, but for those near its cut end: a pre-token depends on its own characters and the one behind
it, an added token on no more than its own length. If the right chunk, which began anywhere, has
a boundary at one of these, both go on alike from there, because a pre-token's match depends only
on what stands at and behind its start. Such a place is a proven splice point. If the overlap has
none, as within one very long pre-token, it is doubled, in the end up to the whole rest.

Defined cases: null text is empty (no bytes, no tokens); each input row gets a result row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP = 8_192, 512
#: On runs of white space of some hundred thousand characters the second library ends its stack.
_LONG_SPACE = re.compile(r"\s{4096}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A path as it is; a bare name by the installed package of public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizers vocabulary in one worker process.

    With `fast`, which packing asks for: a byte-level vocabulary may have a file of the same merges as ranks beside it
    (.tiktoken), which the other public library encodes with several times as fast. It is used where both give the
    same ids: byte-level, the published pattern, a text within Latin-1 (where all Unicode versions
    agree on letters, digits and spaces) that holds no added token's string nor a
    very long run of white space. The tokenizers library itself
    encodes all other texts, and the chunks of huge ones.
    """

    _open: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, fast: bool = False) -> None:
        import json

        from tokenizers import Tokenizer, processors

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [x["content"] for x in said.get("added_tokens") or ()]
        kind = said.get("pre_tokenizer") or {}
        self.byte_level = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and not said.get("normalizer")
        if self.byte_level:
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # a word's offset is then that of its space
        ranks = path.removesuffix(".json") + ".tiktoken"
        self._fast = self._ranked(ranks) if fast and self.byte_level and os.path.exists(ranks) else None

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, name: str, fast: bool = False) -> Encoder:
        if (name, fast) not in cls._open:
            cls._open[name, fast] = cls(vocabulary_path(name), fast)
        return cls._open[name, fast]

    def _plain(self, text: str) -> bool:
        if self._fast is None or _LONG_SPACE.search(text) or any(x in text for x in self.added):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def ids(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """The ids of the whole text, four bytes each."""
        if len(text) > chunk and self.byte_level:
            return b"".join(map(self._pack, self.spliced(text, chunk, overlap)))
        if self._plain(text):
            return self._pack(self._fast(text))
        return self._pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)  # without offsets

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """How many ids the whole text has."""
        if len(text) > chunk and self.byte_level:
            return sum(map(len, self.spliced(text, chunk, overlap)))
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        import numpy as np

        return np.asarray(ids, dtype="<u4").tobytes()

    @staticmethod
    def _ends(encoded, at: int) -> Iterator[tuple[int, int]]:
        """(start in the whole text, index of the first id) of the pre-tokens, from the last one back."""
        i = len(encoded) - 1
        while i >= 0:
            word = encoded.token_to_word(i)
            while i > 0 and encoded.token_to_word(i - 1) == word:
                i -= 1
            yield at + encoded.token_to_chars(i)[0], i
            i -= 1

    @staticmethod
    def _begins(encoded, at: int, upto: int) -> dict[int, int]:
        """The same from the first one on, up to a place of the text."""
        out, last, i = {}, None, 0
        while i < len(encoded):
            word = encoded.token_to_word(i)
            if i == 0 or word != last:
                start = at + encoded.token_to_chars(i)[0]
                if start > upto:
                    break
                out.setdefault(start, i)
                last = word
            i += 1
        return out

    def spliced(self, text: str, chunk: int, overlap: int) -> Iterator[list[int]]:
        """Ids of a huge text, piece by piece; one pair of chunks is in memory at a time. Boundaries are looked
        at in the overlap only."""
        encode = lambda a, b: self.tokenizer.encode(text[a:b], add_special_tokens=False)
        margin = max([2, *map(len, self.added)])
        x, end = 0, min(chunk, len(text))
        at, left = 0, encode(0, end)  # where the left chunk was cut out
        begin = 0  # where ids that still stand begin
        while end < len(text):
            reach, found = overlap, None
            while found is None:
                start = max(x + 1, end - reach)
                to = min(len(text), start + max(chunk, 2 * reach))
                right = encode(start, to)
                held = self._begins(right, start, end - margin)
                for n, (s, i) in enumerate(self._ends(left, at)):
                    if s <= start:
                        break
                    if n > 1 and s <= end - margin and s in held:
                        found = s, i
                        break
                if found is None:
                    if start == x + 1:  # nothing left to widen: the left chunk grows instead
                        end = min(len(text), x + 2 * (end - x))
                        at, left, begin = x, encode(x, end), 0
                        if end == len(text):
                            break
                    reach *= 2
            if found is None:
                break
            yield left.ids[begin : found[1]]
            x, end, begin, at, left = found[0], to, held[found[0]], start, right
        yield left.ids[begin:]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of docs (doc_id, text). Narrow; a task holds one Arrow
    batch of texts and one pair of chunks."""

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder.of(vocabulary)
        for s in texts:
            yield pd.Series([encoder.count(t, chunk, overlap) for t in s], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), counted(text).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
