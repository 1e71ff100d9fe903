"""Byte-level BPE: whole texts to token ids by a rank file, and ids back to the very same bytes.

Runs row by row in Arrow batches, without a shuffle. The rank file is named by a path that every worker can read; it is
loaded once per worker process.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from doclake.llm.common import with_fields

#: Texts are handed to the tokenizer in pieces of about so many characters, cut only where no token can reach across.
PIECE_CHARS = 20_000
#: A run of white space from this length on is encoded apart, as the tokenizer's regular expression backtracks over it.
LONG_SPACE = 1_000
#: A token never holds white space after something else, so a text may be cut before a space that follows a non-space.
_SAFE = re.compile(r"(?<=[^\s])(?=[ \n])")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file (base64 token, space, rank on each line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str, chars: int) -> Iterator[str]:
    """Cuts of ``text`` at safe boundaries, each of about ``chars`` characters; a stretch without one stays whole."""
    start = 0
    while len(text) - start > chars:
        cut = _SAFE.search(text, start + chars)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    """Ids of a text, exactly those of one call over the whole text."""
    if len(text) <= LONG_SPACE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _SPACE.finditer(text):
        # of white space before something else the last character goes with what follows, the others are one match
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in _pieces(text[start:run.start()], piece_chars):
            ids += enc.encode_ordinary(piece)
        ids += enc._core_bpe.encode_single_piece(text[run.start():end].encode())
        start = end
    for piece in _pieces(text[start:], piece_chars):
        ids += enc.encode_ordinary(piece)
    return ids


def tokenize(docs: DataFrame, path: str, pattern: str, text_column: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` with ``tokens`` array<int>. A null or empty text has no tokens; other columns pass through, except that an own
    ``tokens`` column is replaced."""
    kept = [c for c in docs.columns if c != "tokens"]
    schema = with_fields(docs.select(*kept), "tokens array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            ids = [encode(enc, t or "", piece_chars) for t in batch.column(text_column).to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "tokens"])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` with ``decoded`` binary: the bytes of all ids in order, also where single tokens are no valid UTF-8."""
    kept = [c for c in tokens.columns if c != "decoded"]
    schema = with_fields(tokens.select(*kept), "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in batch.column("tokens").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "decoded"])

    return tokens.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the whole text (null: empty).

    Encodes and decodes in one pass, so that the ids of a text live only while it is handled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            counts, ids_hex, raw_hex = [], [], []
            for text in batch.column("text"):
                ids = encode(enc, text.as_py() or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                raw_hex.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(raw_hex)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = with_fields(docs.select("doc_id"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
