"""SentencePiece encoding and decoding by a table of distinct chunks.

Sentencepiece writes a blank as the marker U+2581.  When no piece of the model
holds a marker after another character, no merge can cross from a word into
the marker that follows it.  A text then falls into chunks -- a run of markers
and the word behind it -- that are segmented independently of each other.
Words repeat, so each task keeps a table of the distinct chunks it has met:
every chunk is segmented once by the library, and a text's ids are put
together from the table by position (numpy gathers, no per-id Python).

The table lives in the task and holds at most ``max_chunks`` chunks (it starts
anew beyond that), so memory is bounded and no shuffle is needed.  A table of
the whole corpus would have to move every word of every text by its hash and
back by position, many times the input.

Defined results: a null or empty text has the end id alone and decodes to the
empty text; blanks, markers and control characters are encoded as the library
does.  Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import slices

MARK = "▁"


def check_model(model: bytes) -> None:
    """Raise unless the model allows chunks: no piece holds a marker behind
    another character, a marker is put in front of a text, and white space and
    compatibility characters come back from a round trip as they were."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    crossing = [i for i in range(sp.get_piece_size()) if MARK in sp.id_to_piece(i).lstrip(MARK)]
    probe = "  a \u3000\u00a0\ufb01 \u212b  b  "
    if crossing or not sp.encode("a", out_type=str)[0].startswith(MARK) or sp.decode(sp.encode(probe)) != probe:
        raise ValueError("pieces of this model may cross white space markers")


class ChunkTable:
    """Distinct chunks -> ids, each segmented and decoded once."""

    def __init__(self, model: bytes, max_chunks: int) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_proto=model)
        self.max_chunks = max_chunks
        # decoded in front of a chunk, so that the decoder keeps the chunk's own leading blank
        self.lead = self.sp.encode("a")
        self.lead_text = self.sp.decode(self.lead)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.odd: dict[str, str] = {}  # chunks that do not decode to a blank and themselves
        self.flat = np.zeros(1024, np.int32)
        self.start = np.zeros(1, np.int64)  # chunk i has flat[start[i]:start[i + 1]]

    def add(self, chunks: list[str]) -> None:
        """Segment chunks that are not in the table.  A chunk is given without
        its first marker, which the library's dummy prefix adds."""
        blank = [c for c in chunks if not c.strip(" ")]
        chunks = [c for c in chunks if c.strip(" ")]
        ids = self.sp.encode(chunks, num_threads=1)
        flat = list(chain.from_iterable(ids))
        # one decode call for all; every chunk starts with a blank, which parts them again
        decoded = self.sp.decode(self.lead + flat)[len(self.lead_text) + 1 :]
        parts = chunks_of(decoded)
        if len(parts) != len(chunks):
            raise ValueError("the model's decoder does not keep chunks apart")
        self.odd.update((c, " " + d) for c, d in zip(chunks, parts, strict=True) if c != d)
        for c in blank:  # a run of markers at a text's end
            one = self.sp.encode(c) if c else self.sp.encode(MARK + "a")[:1]
            ids.append(one)
            flat += one
            text = self.sp.decode(self.lead + one)[len(self.lead_text) :]
            if text != " " + c:
                self.odd[c] = text
        first = len(self.row)
        self.row.update(zip(chunks + blank, range(first, first + len(ids)), strict=True))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        if start[-1] > self.flat.size:
            self.flat = np.concatenate([self.flat[: self.start[-1]], np.zeros(2 * start[-1] - self.start[-1], np.int32)])
        self.flat[self.start[-1] : start[-1]] = flat
        self.start = start

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Offsets and flat ids of the texts, and their decoded texts."""
        split = [chunks_of(t) for t in texts]
        if len(self.row) > self.max_chunks:
            self.clear()
        row = self.row
        new = set().union(*split).difference(row)
        if new:
            self.add(list(new))
        odd = self.odd
        decoded = ["".join([odd.get(c) or " " + c for c in chunks])[1:] if odd and not odd.keys().isdisjoint(chunks) else " ".join(chunks) for chunks in split]
        n_chunks = np.fromiter(map(len, split), np.int64, len(split))
        flat_rows = np.fromiter(map(row.__getitem__, chain.from_iterable(split)), np.int64, int(n_chunks.sum()))
        first, last = self.start[flat_rows], self.start[flat_rows + 1]
        lengths = last - first
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(first - upto[:-1], lengths) + np.arange(upto[-1])]
        offsets = upto[np.concatenate([[0], np.cumsum(n_chunks)])]
        return offsets, ids, decoded


def chunks_of(text: str) -> list[str]:
    """Chunks of a text, each without its first marker.

    The library puts one marker in front of a non-empty text.  Splitting the
    text at markers gives an empty string for every further marker of a run;
    those are joined to the word behind them (or stay as a last chunk).
    """
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts[:-1]:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    out.append(" " * run + parts[-1])
    return out


def encode(
    df: DataFrame,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: bool = True,
    max_chunks: int = 300_000,
    max_bytes: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``df``: the id, ``ids`` (array<int>), ``decoded`` (text).

    ``ids`` are the library's, without sampling, with the end id last if
    ``end_id``; ``decoded`` is what the library's ``decode(ids)`` gives.
    ``model`` is the model file's content: executors need no file.
    """
    check_model(model)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, max_chunks)
        end = table.sp.eos_id()
        for piece in slices(batches, 1, max_bytes):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            offsets, ids, decoded = table.encode(texts)
            if end_id:
                ids = np.insert(ids, offsets[1:], end).astype(np.int32)
                offsets = offsets + np.arange(len(offsets))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded string")


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: the id and ``decoded``, the library's
    ``decode`` of the ids (null ids: the empty text)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        for batch in batches:
            decoded = [sp.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=["id", "decoded"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {id_type}, decoded string")
