"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the lengths of frequent pre-tokens, broadcast: those that a byte-pair vocabulary
holds whole. Its merges were made in order of frequency, so they are the frequent ones of the corpus that it comes
from; the table's size is that of the vocabulary, whatever the texts. What the table doesn't hold is looked up in the
worker's cache, and encoded by the library the first time, so what is frequent in these texts alone is encoded once a
worker. No pre-token, count or text is exchanged, and texts are read once. Both tiers only spare calls of the library:
the counts are its own whatever they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from winnow.llm.pretokens import Split, cache, strings
from winnow.llm.shared import map_batches
from winnow.llm.textscan import blocks

#: Pre-tokens in the broadcast table, and slots for them: 2.6 MB.
FREQUENT, SLOTS = 1 << 17, 1 << 18


class Table:
    """An open-addressing hash table from a pre-token's hash to its number of tokens."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.keys, self.sizes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint16)
        for h, n in zip(hashes.tolist(), sizes.tolist(), strict=True):
            at = h % SLOTS
            while self.keys[at] and self.keys[at] != h:
                at = (at + 1) % SLOTS
            self.keys[at], self.sizes[at] = h, n

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Sizes, and -1 where the table has none."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        at = (hashes % np.uint64(SLOTS)).astype(np.int64)
        while len(left):
            key = self.keys[at]
            same = key == hashes[left]
            out[left[same]] = self.sizes[at[same]]
            go = ~same & (key != 0)
            left, at = left[go], (at[go] + 1) % SLOTS
        return out


def frequent_pretokens(path: str) -> list[str]:
    """The pre-tokens that the vocabulary of the tokenizer file holds whole, the first FREQUENT of them."""
    library = Tokenizer.from_file(path)
    entries = library.decode_batch([[i] for i in range(library.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False)
    texts = [t for t in entries if t and "\ufffd" not in t]  # else the entry is a part of a character
    split = Split(texts, True)
    whole = np.flatnonzero(np.bincount(split.doc, minlength=len(texts)) == 1)
    return [texts[i] for i in whole[:FREQUENT].tolist()]


def count(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``, tokens as the library counts them.

    A null or empty text has no bytes and no tokens. Repeated rows are counted as often as they come.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    words = frequent_pretokens(path)
    own = cache(path, True)
    hashes = Split(words, True).hashes()  # each is a text of its own, and that text's only pre-token
    table = docs.sparkSession.sparkContext.broadcast(Table(hashes, own.encode_words(words)[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cache(path, True)
        for batch in batches:
            for part in blocks(batch):
                texts = strings(part.column(1))
                split = Split(texts, True)
                hashes = split.hashes()
                size = table.value.get(hashes)
                missed = np.flatnonzero(size < 0)
                entry = own.entries(split, hashes, missed)  # may grow what it indexes
                size[missed] = own.size[entry]
                total = np.bincount(split.doc, weights=size, minlength=len(texts)).astype(np.int64)
                for i, ids in zip(split.others, own.encode([texts[i] for i in split.others]), strict=True):
                    total[i] = len(ids)
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
