"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import byte_slices

#: A position where no pre-token of a byte-level BPE can cross: between a non-space and an ASCII
#: white space (a white space only begins a pre-token), between ASCII letters and digits, and
#: between CJK punctuation and a CJK letter (marks and punctuation of these blocks left out).
SAFE_CUT = re.compile(
    r"(?<=\S)(?=[ \t\n\r\x0b\x0c])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[、。，！？])(?=[ぁ-ゖァ-ヺ一-龥가-힣])"
)
_LOADED: dict[tuple[str, int], object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, loaded once in each worker process, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, os.getpid())
    if key not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[key] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[key] = Tokenizer.from_file(path)
            _LOADED[key].no_truncation()
            _LOADED[key].no_padding()
    return _LOADED[key]


def safe_pieces(text: str, limit: int) -> list[str]:
    """``text`` in pieces of about ``limit`` code points, cut only where tokens never cross."""
    pieces, at = [], 0
    while len(text) - at > limit:
        cut = SAFE_CUT.search(text, at + limit)
        if not cut:
            break
        pieces.append(text[at : cut.start()])
        at = cut.start()
    return [*pieces, text[at:]]


def encoded_lengths(tokenizer, texts: list[str]) -> list[int]:
    if hasattr(tokenizer, "encode_batch_fast"):
        return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in tokenizer.encode(texts, num_threads=1)]


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def count_tokens(tokenizer, texts: list[str], batch_bytes: int, piece_chars: int) -> list[int]:
    """Token counts, encoded in batches of about ``batch_bytes`` bytes of UTF-8."""
    splits = hasattr(tokenizer, "encode_batch_fast")  # pieces of other kinds of models are not proven safe
    counts, batch, owners, size = [0] * len(texts), [], [], 0

    def flush() -> None:
        nonlocal size
        for owner, n in zip(owners, encoded_lengths(tokenizer, batch)):
            counts[owner] += n
        batch.clear()
        owners.clear()
        size = 0

    for row, text in enumerate(texts):
        for piece in safe_pieces(text, piece_chars) if splits else [text]:
            batch.append(piece)
            owners.append(row)
            size += utf8_size(piece)
            if size >= batch_bytes:
                flush()
    if batch:
        flush()
    return counts


def n_tokens(text: Column, tokenizer_path: str, batch_bytes: int = 1 << 18, piece_chars: int = 1 << 15) -> Column:
    """Column of token counts (long).  Only the text goes to Python and only the counts return.

    ``tokenizer_path``: a ``tokenizers`` JSON or a sentencepiece model, on every executor.
    Encoding runs in batches of about ``batch_bytes`` bytes of UTF-8 whatever the number of rows,
    and a text longer than ``piece_chars`` is cut at the next safe boundary; a text that has
    none is encoded whole.  Null and empty texts have 0 tokens.
    """

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load_tokenizer(tokenizer_path)
        for array in batches:
            counts: list[int] = []
            for low, high in byte_slices(array, 16 * batch_bytes):
                texts = [x or "" for x in array.slice(low, high - low).to_pylist()]
                counts += count_tokens(tokenizer, texts, batch_bytes, piece_chars)
            yield pa.array(counts, pa.int64())

    return counted(text)


def token_counts(
    documents: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Size of each document: (id, n_bytes, n_tokens, over_limit); narrow, without a shuffle.

    Nulls in the text count as empty (0 bytes, 0 tokens); ids are passed on as they are, also
    null or repeated ones; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = documents.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, tokenizer_path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
