"""Packing by concatenate and cut.

Pass one encodes every document once, writes its ids and its place in its
partition, and sums the ids of each partition.  A prefix sum over the partition
totals (one number per partition) turns places into global offsets.  Pass two
cuts each document at the fixed windows; a document that crosses a window leaves
one boundary record on either side.  No row moves between the passes, so there is
no shuffle but the sum per partition, and no task holds more than a batch.

Every window but the last is full, so padding is under one window in all.  The
last is padded to the window, unless its length is a power of two.

Null and empty texts hold the end id alone.  Rows with one ``doc_id`` are packed
each for itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bodies, doc_id, per_worker, slices, stash

PIECES = "k long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_bpe(vocabulary: str, ranks: str):
    """A function from text to ids, as ``tokenizers`` gives them for ``vocabulary``.

    ``ranks`` holds the same vocabulary for tiktoken, which is four times as fast.
    It is used where the two cannot differ, on Latin-1 texts that spell out none of
    the vocabulary's added tokens; for all others their Unicode tables might, so
    those go through ``tokenizers`` itself, which turns an added token's text into
    its id.
    """

    def make():
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        added = [t.content for t in full.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> list[int]:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return full.encode(text, add_special_tokens=False).ids
            if any(t in text for t in added):
                return full.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        return encode

    return per_worker(f"byte_bpe:{vocabulary}:{ranks}", make)


def pack(
    docs: DataFrame,
    window: int = 1024,
    end_id: int = 0,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, with a checksum of its ids."""

    def encode(batches):
        ids_of, place, part = byte_bpe(vocabulary, ranks), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            keys, out, places, counts = batch.column(0), [], [], []
            for body in batch.column(1).to_pylist():
                ids = ids_of(body.decode("utf-8", "replace"))
                ids.append(end_id)
                out.append(np.array(ids, dtype="<u4").tobytes())
                places.append(place)
                counts.append(len(ids))
                place += len(ids)
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array(places, pa.int64()), keys, pa.array(out, pa.binary()), pa.array(counts, pa.int64())],
                ["part", "place", "k", "ids", "n"],
            )

    encoded = stash(bodies(docs).mapInArrow(encode, "part long, place long, k long, ids binary, n long"), "pack-ids")

    # One number per partition of the scan, whatever the number of documents: a million partitions make 16 MB.
    totals = sorted((r.part, r.n) for r in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases, at = {}, 0
    for part, n in totals:
        bases[part] = at
        at += n
    held = docs.sparkSession.sparkContext.broadcast(bases)

    def cut(batches):
        bases = held.value
        for batch in slices(batches):
            rows = []
            for part, place, k, body, _ in zip(*(c.to_pylist() for c in batch.columns)):
                at = bases[part] + place
                ids = np.frombuffer(body, dtype="<u4")
                n, start = len(ids), 0
                while start < n:
                    length = min(n - start, window - (at + start) % window)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, (at + start) // window, (at + start) % window))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 7, ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return encoded.mapInArrow(cut, PIECES).select(doc_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
