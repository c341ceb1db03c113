"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk_chars`` is encoded as it is.  A longer one is encoded in
chunks that overlap.  Two neighbouring encodings are spliced at a boundary q in
their overlap that

* is stable whatever stands around it: the character before q isn't white space
  and the one at q is.  The supported pre-tokenizers never match across such a
  place, no special token contains white space, and no merge crosses pre-tokens, so
  the whole text's encoding has a token boundary there as well;
* both encodings share: no token of either spans q; and
* is confirmed: the tokens that follow q in both encodings, up to the next stable
  boundary, are the same.

Where the overlap holds no such place (say, one very long word) it is doubled and
the next chunk encoded again; once it would reach back to the start of the left
chunk, that chunk is made longer instead, so that any text ends in its exact encoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Characters given to the library in one call.
BATCH_CHARS = 1 << 21

Encoding = tuple[list[int], list[tuple[int, int]]]


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _stable(text: str, q: int) -> bool:
    return not text[q - 1].isspace() and text[q] in " \t\n\r\x0b\x0c"


def _encode(tokenizer, text: str) -> Encoding:
    got = tokenizer.encode(text, add_special_tokens=False)
    return got.ids, got.offsets


def _common_boundary(text: str, left: Encoding, left_at: int, right: Encoding, right_at: int, end: int) -> tuple[int, int, int] | None:
    """(q, tokens of left before q, tokens of right before q) for the last q that can be spliced at."""
    left_ids, left_spans = left
    right_ids, right_spans = right
    i, stop = len(left_spans), end
    for q in range(end - 1, right_at, -1):
        if not _stable(text, q):
            continue
        while i and left_at + left_spans[i - 1][0] >= q:
            i -= 1
        j = next((k for k, (a, _) in enumerate(right_spans) if right_at + a >= q), len(right_spans))
        whole = (not i or left_at + left_spans[i - 1][1] <= q) and (not j or right_at + right_spans[j - 1][1] <= q)
        if whole and stop < end:
            n = sum(left_at + a < stop for a, _ in left_spans[i:])
            if n and left_ids[i : i + n] == right_ids[j : j + n]:
                return q, i, j
        stop = q
    return None


def spliced_ids(tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """The ids of the whole text, in runs; memory is that of a chunk and its overlap."""
    at, end = 0, min(len(text), chunk_chars)
    left, skip = _encode(tokenizer, text[at:end]), 0
    overlap = overlap_chars
    while end < len(text):
        start = end - overlap
        if start <= at:
            end = min(len(text), at + 2 * (end - at))
            left, skip_at = _encode(tokenizer, text[at:end]), skip
            skip, overlap = skip_at, overlap_chars
            continue
        right_end = min(len(text), start + chunk_chars + overlap)
        right = _encode(tokenizer, text[start:right_end])
        found = _common_boundary(text, left, at, right, start, end)
        if found is None:
            overlap *= 2
            continue
        _, i, j = found
        if i < skip:
            overlap *= 2
            continue
        yield left[0][skip:i]
        at, end, left, skip, overlap = start, right_end, right, j, overlap_chars
    yield left[0][skip:]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row, in one pass without a shuffle.

    tokenizer: path of a .json or .model file that every executor can read.  Counts
    are those of the library for the whole text, without begin, end or other added
    special tokens; special strings inside a text are the tokens they name, as is the
    library's default.  Null and empty texts have 0 bytes and 0 tokens; repeated rows
    and null ids each give a row; other columns are ignored; an empty table gives none.
    A .model tokenizer encodes each text in one piece, for its normaliser joins white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        pieces = tokenizer.endswith(".model")

        def counts(texts: list[str]) -> list[int]:
            if pieces:
                return [len(x) for x in encoder.encode(texts, num_threads=1)]
            return [len(x) for x in encoder.encode_batch_fast(texts, add_special_tokens=False)]

        for batch in batches:
            texts, out, k = [x or "" for x in batch.column(1).to_pylist()], [], 0
            while k < len(texts):
                if not pieces and len(texts[k]) > chunk_chars:
                    out.append(sum(map(len, spliced_ids(encoder, texts[k], chunk_chars, overlap_chars))))
                    k += 1
                    continue
                size, last = 0, k
                while last < len(texts) and (last == k or size + len(texts[last]) <= BATCH_CHARS) and (pieces or len(texts[last]) <= chunk_chars):
                    size += len(texts[last])
                    last += 1
                out += counts(texts[k:last])
                k = last
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(batch.column(2), pa.int64()), pa.array(out, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes")).mapInArrow(
        run, f"id {id_type}, n_bytes bigint, n_tokens bigint"
    )
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
