"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabularies meant here holds a whitespace marker after another character,
so no piece crosses from one marked word into the next: a chunk (a run of markers and the
word behind it) is segmented on its own.  Each task keeps a table from distinct chunk to
ids, looks the chunks of its texts up, has the library segment those not seen before, and
joins the ids by position.  A chunk's ids depend on the chunk alone, so nothing is shuffled;
the table is emptied at a fixed size in bytes, which changes the work and never the result.

Null and empty texts have no ids and decode to the empty text.  Extra columns stay; columns
that have an output's name are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import give_back

MARKER = "▁"
#: a task's table is emptied when it holds about so much
TABLE_BYTES = 64 << 20
#: of an entry, besides its letters and ids
ENTRY_BYTES = 200
_CHUNK = re.compile(" *[^ ]+| +")


def require_separable(processor) -> None:
    """Fail if a piece could cross from one marked word into the next."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if MARKER in piece.lstrip(MARKER):
            raise ValueError(f"piece {piece!r} crosses a whitespace marker")


def load_processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def chunks_of(text: str) -> list[str]:
    """The text cut before each run of markers, the first marker of each chunk left out."""
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [chunk[1:] for chunk in _CHUNK.findall(" " + text)]


class ChunkTable(dict):
    """Ids of distinct chunks, packed as 32-bit numbers; emptied at ``TABLE_BYTES``."""

    def __init__(self, processor):
        super().__init__()
        self.encode = processor.encode
        self.bare = array("i", [processor.piece_to_id(MARKER)]).tobytes()
        self.taken = 0

    def add(self, chunks: set[str]) -> None:
        new = [chunk for chunk in chunks if chunk]
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            packed = [array("i", ids).tobytes() for ids in self.encode(part, num_threads=1)]
            self.update(zip(part, packed))
            self.taken += sum(map(len, packed)) + sum(map(len, part)) + ENTRY_BYTES * len(part)
        self[""] = self.bare

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, one after the other."""
        if not text:
            return b""
        chunks = chunks_of(text)
        missing = {chunk for chunk in chunks if chunk not in self}
        if missing:
            if self.taken > TABLE_BYTES:
                self.clear()
                self.taken = 0
                missing = set(chunks)
            self.add(missing)
        return b"".join(map(self.__getitem__, chunks))

    def ids(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


def encode_column(model_path: str):
    """A column function: text to ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(load_processor(model_path))
        for part in texts:
            rows = [table.packed(text.as_py()) for text in part]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(row) // 4 for row in rows], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(rows), np.int32))
            del rows
            yield pa.ListArray.from_arrays(pa.array(offsets), values)
        del table
        give_back()

    return encode


def decode_column(model_path: str):
    """A column function: ids to text, by the library's ``decode``."""

    @F.arrow_udf("string")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = load_processor(model_path)
        for part in ids:
            rows = (row.values.to_numpy().tolist() if row.is_valid else [] for row in part)
            yield pa.array([processor.decode(row) for row in rows], pa.string())
        del processor
        give_back()

    return decode


def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", out: str = "token_ids"
) -> DataFrame:
    """Add the ids of each whole text."""
    require_separable(load_processor(model_path))
    return docs.withColumn(out, encode_column(model_path)(F.coalesce(text, F.lit(""))))


def decode_documents(
    docs: DataFrame, model_path: str, ids: str = "token_ids", out: str = "decoded"
) -> DataFrame:
    """Add the text that each row's ids stand for."""
    return docs.withColumn(out, decode_column(model_path)(F.col(ids)))


def digests(encoded: DataFrame) -> DataFrame:
    """Number and digest of the ids, digest of the decoded text."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
