"""Token counts of whole texts, mostly without running the merges.

Offline, once for a vocabulary: which of its strings does the tokenizer itself
encode as that one token? A pre-token in that set counts 1. Any other pre-token
is encoded alone by the library and its count remembered, so merges run once for
a distinct pre-token of a worker, not once for each occurrence.

Letters, normal forms and cases are read from Unicode tables, and each library
has those of another year. Texts of letters that no year has changed are split
here; a text with any other is counted by the library as a whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from citeloom.llm.common import fields, lean, pieces

#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 1 << 20


def byte_signs() -> dict[str, int]:
    """The visible sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def unsettled() -> re.Pattern:
    """A code point whose kind or lower case is not what Unicode 3.2 said, or was not in it.

    Normal forms of texts of what 3.2 assigned never change, so all later tables
    agree on texts without a match.
    """
    old = unicodedata.ucd_3_2_0

    def known(c: str) -> bool:
        return unicodedata.category(c) == old.category(c) not in ("Cn", "Cs", "Co") and unicodedata.combining(c) == old.combining(c)

    spans: list[list[int]] = []
    for k in range(0x110000):
        c = chr(k)
        if k < 128 or (known(c) and all(map(known, c.lower()))):
            if spans and spans[-1][1] == k - 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class Counts(dict):
    """pre-token -> tokens; starts from the proved vocabulary strings."""

    def __init__(self, tokenizer: Tokenizer, proved: set[str]) -> None:
        super().__init__(dict.fromkeys(proved, 1))
        self.tokenizer, self.least = tokenizer, len(proved)

    def __missing__(self, token: str) -> int:
        if len(self) > self.least + REMEMBERED:
            for k in list(self)[self.least :]:
                del self[k]
        n = self[token] = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        return n


class TokenCounter:
    """Counts tokens as one tokenizers file of this kind does: NFC, lower case, a
    splitting pattern that drops what lies between, byte-level BPE with word ends."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: its steps are not those that this counter proves")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.parts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.counts = Counts(self.tokenizer, self.proved(spec["model"]))

    def proved(self, model: dict) -> set[str]:
        """Vocabulary strings that, as a pre-token, the tokenizer encodes as that one token."""
        signs, end = byte_signs(), model["end_of_word_suffix"]
        texts = []
        for v in model["vocab"]:
            if v.endswith(end) and all(c in signs for c in v[: -len(end)]):
                try:
                    texts.append((bytes(signs[c] for c in v[: -len(end)]).decode(), model["vocab"][v]))
                except UnicodeDecodeError:
                    continue
        alone = [(t, i) for t, i in texts if self.pre_tokens(t) == [t]]
        encoded = self.tokenizer.encode_batch([t for t, _ in alone], add_special_tokens=False)
        return {t for (t, i), e in zip(alone, encoded) if e.ids == [i]}

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special string."""
        if not text.isascii():
            # letter by letter, as the library does; Python alone ends a word with another sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text.isascii() and unsettled().search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.parts is None or not self.parts.search(text):
            return sum(map(self.counts.__getitem__, self.pre_tokens(text)))
        return len(self.parts.findall(text)) + sum(self.count(t) for t in self.parts.split(text))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter for a tokenizer file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row.

    Null text counts as empty and has no tokens; repeated rows are counted each;
    other columns are not read. Texts are never cut.
    """
    schema = T.StructType([docs.schema["doc_id"], *fields("n_bytes long, n_tokens long, over_limit boolean")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in (x for whole in batches for x in pieces(whole)):
            texts = batch.column("text").to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(lean(count), schema)
