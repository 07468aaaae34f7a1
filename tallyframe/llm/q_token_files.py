from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spark_io import load, scratch
from .token_files import read_token_files, write_token_files


def tokenizer_path() -> str:
    """The public tokenizer's file; its folder is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to range-coded files in the shared folder and read back."""
    path = scratch(spark, "token-files")
    write_token_files(load(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_files(spark, path)
