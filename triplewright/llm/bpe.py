"""BPE encoding and decoding: longest matches are proposed, every neighbouring pair is verified, failures are merged.

`encode` adds the ids of each text, `decode` the text of each id list. Both work on one row at a time within
Arrow batches, so that there is no shuffle and a worker holds one slice of a batch and a bounded memory of pieces.
Null texts count as empty (no ids). Other columns stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplewright.llm.common import table, text_column
from triplewright.llm.tokens import byte_encoder, slices, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with a column `ids` (array of int) of the text's tokens; an existing column of that name is replaced."""
    path = path or tokenizer_path(VOCABULARY)
    df = df.drop(ids) if ids in df.columns else df

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            at = 0
            for part in slices(batch.column(text)):
                rows = batch.slice(at, len(part))
                at += len(part)
                raw = encoder.encode([t or "" for t in part.to_pylist()])
                offsets = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], [*rows.schema.names, ids])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with a column `text` decoded from the ids; a null list decodes to the empty text."""
    path = path or tokenizer_path(VOCABULARY)
    df = df.drop(text) if text in df.columns else df

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            column = batch.column(ids)
            texts = [encoder.decode(np.array(x.values if x.is_valid else [], np.int64)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of df (doc_id, text): encoded, then decoded from the ids."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                raw = encoder.encode([t or "" for t in part.to_pylist()])
                decoded = (encoder.decode(np.frombuffer(r, "<u4")) for r in raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)).cast(pa.int64()),
                        pa.array([len(r) // 4 for r in raw], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(part)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), text_column()))
