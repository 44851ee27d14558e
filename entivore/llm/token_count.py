"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens. The driver
makes it from a bounded sample (SAMPLE_DOCS documents, SAMPLE_CHARS characters of each, at
most TABLE_SIZE pre-tokens) and broadcasts it: some 2 MB, whatever the size of the input.
The table decides about speed only: what it lacks is encoded by the library and kept in a
bounded cache of the worker (tier two). All texts are counted whole, where they are read.

Pre-tokens are looked up only if the tokenizer file names the normaliser and the pattern of
NORMALIZER and PRE_TOKENIZER. In texts whose characters are all below U+0250, where that
normalisation is lower-casing, one pattern finds them; in texts of any other script the
library's own normaliser and pre-tokenizer do, so that both tiers serve every script. Texts
that hold a special string of the tokenizer, and all texts under another tokenizer, are encoded
by the library as a whole.

Cases: null text counts as empty and has no tokens. An empty table gives an empty result.
Very long texts are counted whole. Repeated rows are counted each. Other columns are left
alone.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entivore.llm.common import table

SAMPLE_DOCS, SAMPLE_CHARS, TABLE_SIZE = 1_000, 10_000, 50_000
#: Entries of a worker's cache, beyond which it starts anew.
WORKER_ENTRIES = 200_000
#: Texts in work at a time.
SLICE = 512
# What the tokenizer file must say for pre_tokens() to give its pre-tokens.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
TOP_CHAR = 0x250


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(TOP_CHAR) if unicodedata.category(chr(c))[0] == kind)


_SPACE = r"\t-\r \x85\xa0"
_PRE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")
_FAR = re.compile(f"[^\x00-{chr(TOP_CHAR - 1)}]")


class Lengths(dict):
    """Tokens by pre-token: the frequent ones, then a cache of this worker, then the library."""

    def __init__(self, frequent: dict[str, int], tokenizer):
        super().__init__(frequent)
        self.tokenizer, self.cache = tokenizer, {}

    def __missing__(self, word: str) -> int:
        n = self.cache.get(word)
        if n is None:
            if len(self.cache) >= WORKER_ENTRIES:
                self.cache.clear()
            n = self.cache[word] = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return n


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(tokenizer) -> tuple[str, ...] | None:
    """The tokenizer's special strings; None if its pre-tokens aren't those of pre_tokens()."""
    spec = json.loads(tokenizer.to_str())
    if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER:
        return None
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def pre_tokens(text: str, special: tuple[str, ...] | None, tokenizer) -> list[str] | None:
    """The text's pre-tokens; None if the text has to be encoded as a whole."""
    if special is None or any(x in text for x in special):
        return None
    if text.isascii() or not _FAR.search(text):
        return _PRE.findall(text.lower())
    plain = tokenizer.normalizer.normalize_str(text)
    return [plain[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]


def frequent(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of the documents."""
    tokenizer, seen = load(path), Counter()
    special = specials(tokenizer)
    for row in docs.select(F.substr("text", F.lit(1), F.lit(SAMPLE_CHARS)).alias("text")).where("text != ''").take(sample_docs):
        seen.update(pre_tokens(row.text, special, tokenizer) or ())
    words = [w for w, _ in seen.most_common(table_size)]
    return dict(zip(words, (len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)), strict=True))


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, **options) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs. path: a tokenizer file that workers can read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent(docs, path, **options))

    def count(batches):
        tokenizer = load(path)
        special, lengths = specials(tokenizer), Lengths(shared.value, tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sizes, tokens = [], []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    words = pre_tokens(text, special, tokenizer)
                    sizes.append(len(text.encode()))
                    tokens.append(len(tokenizer.encode(text, add_special_tokens=False).ids) if words is None else sum(map(lengths.__getitem__, words)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
