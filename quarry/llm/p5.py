"""Problem 5: credentials in code snippets and evidence, found and redacted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.secrets import SIEVE, find_secrets, redact
from quarry.llm.words import TOKENIZER_DIR, dictionary
from quarry.tables import table


def credentials(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, clean: bool = False) -> DataFrame:
    """(key, secret) for each distinct credential of a row; with `clean` (key, secrets, redacted), one row a text with any.

    Null and empty texts give no row. The dictionary is the only broadcast: the
    whole words of one vocabulary, at most 49,408.
    """
    words = df.sparkSession.sparkContext.broadcast(dictionary(folder))
    kind = df.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            hit = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(batch.column(1), SIEVE), False))
            if not len(hit):
                continue
            ids, texts = batch.column(0).take(hit), batch.column(1).take(hit).to_pylist()
            take, found, cleaned = [], [], []
            for i, t in enumerate(texts):
                spans = find_secrets(t, known)
                own = list(dict.fromkeys(t[a:b] for a, b in spans))
                if clean and own:
                    take.append(i)
                    found.append(own)
                    cleaned.append(redact(t, spans))
                elif own:
                    take += [i] * len(own)
                    found += own
            if take:
                cols = [ids.take(pa.array(take, pa.int64()))]
                cols += [pa.array(found, pa.list_(pa.string())), pa.array(cleaned, pa.string())] if clean else [pa.array(found, pa.string())]
                yield pa.record_batch(cols, names=[key, "secrets", "redacted"] if clean else [key, "secret"])

    out = f"`{key}` {kind}, " + ("secrets array<string>, redacted string" if clean else "secret string")
    return df.select(key, text).mapInArrow(search, out)


def _sources(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("findings", table(spark, folder, "findings"), "id", "code_snippet"), ("evidence_items", table(spark, folder, "evidence_items"), "item_id", "content")]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [credentials(df, key, text).select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), "secret") for name, df, key, text in _sources(spark, folder)]
    return parts[0].unionByName(parts[1]).distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that holds a credential, with the credentials replaced and all else as it was."""
    parts = [
        credentials(df, key, text, clean=True).select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.size("secrets").cast("bigint").alias("n_secrets"), "redacted")
        for name, df, key, text in _sources(spark, folder)
    ]
    return parts[0].unionByName(parts[1]).distinct()
