"""Text to unit vectors: a built-in hashing encoder and a hook for any batch model."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx
from ticketloom.operators.similarity import unit_rows
from ticketloom.sources.tables import staged

INPUT = "_text_to_encode"


def fit_hashing_encoder(texts: DataFrame, text_column: str = "chunk_text",
                        dim: int = fv.VECTOR_DIM) -> PipelineModel:
    """Hashed term weights of fixed length. Fitting is one aggregate of `dim` document counts.

    Words are runs of letters, numbers and `_` of any script, in lower case; a text of other signs
    alone, like a blank one, has the zero vector. Matches words, not meaning: use `batch_encoder` with a sentence model for that.
    """
    body = F.coalesce(F.col(text_column), F.lit("")).alias(INPUT)
    return Pipeline(stages=counting(dim) + weighing()).fit(texts.select(body))


def counting(dim: int) -> list:
    return [RegexTokenizer(inputCol=INPUT, outputCol="_tokens", pattern=f"{tx.WORD}+", gaps=False),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dim)]


def weighing() -> list:
    return [IDF(inputCol="_counts", outputCol="_weights"),
            Normalizer(inputCol="_weights", outputCol="_unit", p=2.0)]


def fit_and_encode(texts: DataFrame, text_column: str = "chunk_text", out: str = "vector",
                   dim: int = fv.VECTOR_DIM) -> DataFrame:
    """The vectors of `fit_hashing_encoder` on its own texts, which are read and cut into words once.

    The text itself is left out; the hashed counts are staged, at most `dim` numbers a text.
    """
    body = F.coalesce(F.col(text_column), F.lit("")).alias(INPUT)
    kept = [c for c in texts.columns if c != text_column]
    counted = Pipeline(stages=counting(dim)).fit(texts).transform(texts.select(*kept, body))
    counts = staged(counted.select(*kept, "_counts"), "term-counts")
    weighed = Pipeline(stages=weighing()).fit(counts).transform(counts)
    return weighed.select(*kept, vector_to_array("_unit", "float32").alias(out))


def batch_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A pandas UDF around a batch model, which `load` opens once per task, not per row.

    Vectors are scaled to length 1. Batch size: spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            matrix = np.asarray(model(texts.fillna("").tolist()), dtype=np.float64)
            yield pd.Series(list(unit_rows(matrix).astype(np.float32)))

    return F.pandas_udf(encode, "array<float>")


def encode(encoder, df: DataFrame, text_column: str = "chunk_text",
           out: str = "vector") -> DataFrame:
    """Add a unit vector column with either kind of encoder."""
    if not isinstance(encoder, PipelineModel):
        return df.withColumn(out, encoder(F.col(text_column)))
    body = F.coalesce(F.col(text_column), F.lit(""))
    encoded = encoder.transform(df.withColumn(INPUT, body))
    return encoded.withColumn(out, vector_to_array("_unit", "float32")).select(*df.columns, out)
