"""Token counts by a whole-token shortcut.

Most pre-tokens of a text are entries of the vocabulary.  Whether such an entry, encoded
alone, really comes out as one token is a property of the tokenizer file: `whole_tokens`
proves it once per worker, by encoding every entry with the library.  A text then costs a
lookup per pre-token; only the others are merged, and their counts are kept in a bounded
memory of recent ones.

Contract of `count_tokens`: returns every row and column of docs, with `n_bytes`, `n_tokens`
and `over_limit`, which replace columns of those names.  A null or empty text has 0 bytes and
0 tokens; repeated rows are counted each; an empty table gives an empty table.  Special
strings inside a text count as the library counts them by default.  A text with a character
outside `PROVEN` (where the library and this pattern engine may hold different Unicode
tables) is counted by the library itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts, query, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
RECENT = 1 << 19

# Blocks whose classes (letter, number, white space) both engines agree on; tests/llm checks them all.
PROVEN = regex.compile("[\u0000-՗ -⁯ぁ-ゖァ-ヺ一-鿿가-힣]*+")


@dataclass
class Counter:
    library: tokenizers.Tokenizer
    counts: dict[str, int]  # pre-tokens: the proven ones, then recent others
    proven: int
    special: regex.Pattern | None
    pattern: regex.Pattern

    def remember(self, pieces: set[str]) -> None:
        """Merge the pieces that no count is known of."""
        new = [p for p in pieces if p not in self.counts]
        if len(self.counts) + len(new) > self.proven + RECENT:  # drop the others, keep the proven ones
            for key in list(self.counts)[self.proven :]:
                del self.counts[key]
            new = [p for p in pieces if p not in self.counts]
        coded = self.library.encode_batch_fast(new, add_special_tokens=False)
        self.counts.update(zip(new, (len(e.ids) for e in coded)))

    def count(self, texts: list[str]) -> list[int]:
        totals, known = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not PROVEN.fullmatch(text):
                totals[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            parts = [text]
            if self.special and (found := self.special.findall(text)):
                totals[i], parts = len(found), self.special.split(text)
            known += ((i, self.pattern.findall(part)) for part in parts)
        self.remember(set(chain.from_iterable(pieces for _, pieces in known)))
        for i, pieces in known:
            totals[i] += sum(map(self.counts.__getitem__, pieces))
        return totals


def whole_tokens(library: tokenizers.Tokenizer) -> list[str]:
    """The vocabulary's strings that are one pre-token and encode alone as one token."""
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t for t in library.decode_batch([[i] for i in range(library.get_vocab_size())], skip_special_tokens=True)]
    alone = [t for t in texts if t and "�" not in t and PROVEN.fullmatch(t) and len(pattern.findall(t)) == 1]
    coded = library.encode_batch(alone, add_special_tokens=False)
    return [t for t, e in zip(alone, coded) if len(e.ids) == 1]


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _LOADED:
        library = tokenizers.Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        added = library.get_added_tokens_decoder().values()
        if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added):
            raise ValueError("special tokens that take in their surroundings are not covered")
        special = regex.compile("|".join(regex.escape(a.content) for a in added)) if added else None
        proven = dict.fromkeys(whole_tokens(library), 1)
        _LOADED[path] = Counter(library, proven, len(proven), special, regex.compile(public_tokenizers.PATTERN))
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer: str = BYTE_BPE, limit: int = LIMIT, text: str = "text") -> DataFrame:
    def counted(texts: list[str]) -> dict[str, pa.Array]:
        own = counter(tokenizer)
        return {"n_tokens": pa.array(own.count(texts), pa.int64())}

    out = map_texts(docs.drop("n_bytes", "over_limit"), counted, text, n_tokens="long")
    return out.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
