"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import bpe
from granary.llm.common import whole_text


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    The strings that the vocabulary encodes alone as one token are proven once, on the driver, and sent
    to the tasks; the vocabulary bounds their number. A null text counts as empty: no bytes, no tokens.
    Rows with the same or a null doc_id each have a row of their own. Other columns are ignored.
    """
    whole = docs.sparkSession.sparkContext.broadcast(bpe.prove_whole_tokens(vocabulary))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.kept(bpe.Counts, vocabulary, whole.value)
        for b in batches:
            n = pa.array(counter.n(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    own = own.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = own.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
