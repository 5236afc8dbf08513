"""Token counts of whole texts as a public tokenizer gives them."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Longer texts (in characters) are encoded in chunks of this length.
CHUNK = 32_768
OVERLAP = 256
#: Tokens from which on both encodings must agree behind a boundary.
AGREE = 4
#: Pieces whose counts a worker remembers, and their longest; the memory is emptied when it is full.
MEMORY = 800_000
REMEMBERED = 200

# A space with no white space beside it. Byte-level patterns take such a space only as the first character of a token, and what stands left of
# it is cut up without looking at it, so each side is encoded as if it stood alone.
_STABLE = re.compile(r"(?<=\S) (?=\S)")

# More of them, for texts with few spaces: on both sides of a line end between two words, and between letters, digits and other signs. The
# pattern takes as many characters of one class as there are, so a change of class ends a match and begins one. Not so behind an apostrophe,
# which may take letters with it ('s, 't, ...).
_BOUNDARY = regex.compile(
    r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_RUNS = re.compile(r"\s\s|^\s|\s$|[^\S \n]")


@cache
def _tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


class Pieces(dict):
    """Counts of pieces between stable boundaries, each encoded by the library when it is first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = len(self.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= REMEMBERED:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _RUNS.search(text):
            first, *rest = _STABLE.split(text)
        else:
            first, *rest = text.split(" ")
            # beside a line end a space is part of a run of white space, which _RUNS has found, so every space here is a stable boundary
        return self[first] + sum(map(self.__getitem__, [f" {x}" for x in rest]))


@cache
def _pieces(name: str) -> Pieces:
    return Pieces(_tokenizer(name).encode)


def spliced(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text from overlapping chunks.

    Neighbouring chunks are joined at a position in their overlap where both encodings begin a token, agree on the next tokens and the
    position is a stable boundary. Where there is none, the overlap is widened up to the whole chunk, and then the chunk is doubled; so a text
    without any boundary costs a few times what the library takes for it at once.
    """
    def encoded(start: int, end: int):
        e = encode(text[start:end], add_special_tokens=False)
        return [start + a for a, _ in e.offsets], e.ids

    total, done = 0, 0  # tokens that begin before ``done`` are counted
    start, end = 0, min(chunk, len(text))
    begins, ids = encoded(start, end)
    while end < len(text):
        wide = overlap
        while True:
            after = max(end - wide, done)
            stop = min(after + chunk + wide, len(text))
            new_begins, new_ids = encoded(after, stop)
            at = None
            i = bisect_left(begins, after + 1)
            for i in range(i, len(begins) - AGREE):
                b = begins[i]
                if not _BOUNDARY.match(text, b):
                    continue
                j = bisect_left(new_begins, b)
                if new_begins[j : j + AGREE] == begins[i : i + AGREE] and new_ids[j : j + AGREE] == ids[i : i + AGREE]:
                    at = (b, i, j)
                    break
            if at:
                break
            if after == done or not _BOUNDARY.search(text, done + 1, end):  # no boundary in the last chunk: encode it together with what follows
                end = min(2 * end - done, len(text))
                begins, ids = encoded(done, end)
                if end == len(text):
                    break
                wide = overlap
                continue
            wide *= 2
        if not at:
            break
        b, i, j = at
        total += i - bisect_left(begins, done)
        done, begins, ids, end = b, new_begins[j:], new_ids[j:], stop
    return total + len(begins) - bisect_left(begins, done)


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``n_tokens``, equal to encoding each whole text at once, without added special tokens.

    Null and empty texts have no tokens. Rows keep their columns, repeats included; if one is called n_tokens, the new one gets
    underscores in front. Special strings inside texts are handled as the library does by default.
    """
    name = free_name(docs, "n_tokens")
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def counted(batches):
        pieces, encode = _pieces(tokenizer), _tokenizer(tokenizer).encode
        for batch in batches:
            got = [0 if x is None else spliced(encode, x, chunk, overlap) if len(x) > chunk else pieces.count(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(counted, schema)


def op9_token_counts(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens")
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
