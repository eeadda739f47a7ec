"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

The rank file (under 1 MB) is read once by the driver and broadcast, so
executors need no local copy. Long texts are cut at safe boundaries first: an
ASCII space after a printable non-space ASCII character. The split pattern ends
a match there whatever surrounds it (only white-space runs hold white space
beyond an optional leading space, and the pattern looks ahead from white space
alone), so the pieces' ids concatenate to the ids of the whole text.

Nulls are encoded as the empty text; empty texts give no ids. Repeated rows give
repeated results, an empty table an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters after which a long text may be cut.
CUT_CHARS = 1 << 16

_encodings: dict[str, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read where the driver runs."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file, built once in a process."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("strandlake-" + key[:12], pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def safe_pieces(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Cut a text so that no match of the split pattern spans a cut."""
    start, n = 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while at != -1 and not "!" <= text[at - 1] <= "~":
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode_bytes(enc, text: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if len(text) <= CUT_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
    return b"".join(enc.encode_to_numpy(piece, disallowed_special=()).astype("<u4").tobytes() for piece in safe_pieces(text))


def decode_bytes(enc, ids: bytes) -> bytes:
    """Raw bytes of ids; they need not be whole characters."""
    return enc.decode_bytes(memoryview(ids).cast("I").tolist())


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary) for every row; ids are packed little-endian u32."""
    return _mapped(df, ranks_path, pattern, id_col, text_col, f"{id_col} {dict(df.dtypes)[id_col]}, ids binary, decoded binary", lambda ids, raw: (ids, raw), ("ids", "decoded"), (pa.binary(), pa.binary()))


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the digests of encode(), taken where the ids are made."""
    return _mapped(
        df, ranks_path, pattern, id_col, text_col,
        f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, raw: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()),
        ("n_tokens", "ids_sha256", "decoded_sha256"), (pa.int64(), pa.string(), pa.string()),
    )


def _mapped(df, ranks_path, pattern, id_col, text_col, schema, finish, names, types) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = encode_bytes(enc, text.as_py() or "")
                rows.append(finish(ids, decode_bytes(enc, ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True))], names=[id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, schema)
