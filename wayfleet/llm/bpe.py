"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is first cut before spaces that no match of the pattern can cross, which bounds the work
and memory of each call and leaves the ids as they are. Decoding works on raw bytes: the bytes of all
ids are joined before anything reads them as text, so ids that split a character do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfleet.llm.common import text_or_empty
from wayfleet.llm.tokens import byte_bpe, safe_parts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, path: str = RANKS) -> np.ndarray:
    """The ids of a whole text, without special tokens."""
    encoding = byte_bpe(path)
    parts = [encoding.encode_ordinary(part) for part in safe_parts(text)]
    return np.concatenate([np.array(p, "<u4") for p in parts])


def decode(ids: np.ndarray, path: str = RANKS) -> bytes:
    """The bytes that ids stand for."""
    return byte_bpe(path).decode_bytes(ids.tolist())


def _encode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [encode(text, path).tolist() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [byte_bpe(path).decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])


def _digest_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids_sha, data_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = encode(text, path)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            data_sha.append(hashlib.sha256(decode(ids, path)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                          pa.array(data_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))


def encoded(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``(doc_id, ids)`` per row of ``docs(doc_id, text)``; a null or empty text has no ids."""
    return _narrow(docs).mapInArrow(partial(_encode_batches, path), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """``(doc_id, data)`` per row of ``tokens(doc_id, ids)``: the raw bytes; null ids give null."""
    present = tokens.select("doc_id", "ids").filter(tokens["ids"].isNotNull())
    return present.mapInArrow(partial(_decode_batches, path), "doc_id long, data binary")


def digest(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids (little-endian 32 bits) and of the decoded bytes.

    A null text counts as empty. Equal rows give equal rows; no row is compared with another one, so
    there are no ties; an empty table gives an empty one; other columns are not read.
    """
    return _narrow(docs).mapInArrow(partial(_digest_batches, path),
                                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
