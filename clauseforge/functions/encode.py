"""Character sequences and vectors as DataFrame columns."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The nucleotide order of the one-hot and the index code.
NUCLEOTIDES = "ACGT"


def characters(text: Column) -> Column:
    """One array element per character."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def one_hot(text: Column, alphabet: str = NUCLEOTIDES) -> Column:
    """Per character an array with a 1.0 at its place in ``alphabet``; others are all zero."""
    return F.transform(
        characters(text),
        lambda c: F.array(*[F.when(c == a, F.lit(1.0)).otherwise(F.lit(0.0)) for a in alphabet]),
    )


def one_hot_vector(text: Column, alphabet: str = NUCLEOTIDES) -> Column:
    """The one-hot code of all positions in one ``array<double>``."""
    return F.flatten(one_hot(text, alphabet))


def one_hot_active(text: Column, alphabet: str = NUCLEOTIDES) -> Column:
    """Indices of the 1.0 entries of :func:`one_hot_vector`, the sparse form."""
    size = len(alphabet)
    places = F.transform(
        characters(text), lambda c, i: F.nullif(_place(c, alphabet), F.lit(0)) - 1 + i * size
    )
    return F.filter(places, lambda x: x.isNotNull())


def feature_set(indices: Column, width: int) -> Column:
    """The 0/1 vector of ``width`` features whose ones are at ``indices``, as a struct.

    Training and classification read it as it is; nothing has an entry per feature.
    """
    return F.struct(F.lit(width).alias("size"), indices.cast("array<int>").alias("indices"))


def one_hot_set(text: Column, width: int, alphabet: str = NUCLEOTIDES) -> Column:
    """The one-hot code of texts of equal length as a set of ``width`` features."""
    return feature_set(one_hot_active(text, alphabet), width)


def index_code(text: Column, alphabet: str = NUCLEOTIDES) -> Column:
    """Per character its 1-based place in ``alphabet`` as a double, 0.0 for others."""
    return F.transform(characters(text), lambda c: _place(c, alphabet).cast("double"))


def _place(char: Column, alphabet: str) -> Column:
    return F.instr(F.lit(alphabet), char)


def encode(df: DataFrame, column: str, encoding: str = "OneHot", alphabet: str = NUCLEOTIDES,
           output: str = "features") -> DataFrame:
    """``df`` with ``output`` holding the ``"OneHot"`` or ``"Index"`` code of ``column``."""
    codes = {"OneHot": one_hot_vector, "Index": index_code}
    if encoding not in codes:
        raise ValueError(f"encoding must be one of {tuple(codes)}")
    return df.withColumn(output, codes[encoding](F.col(column), alphabet))


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Numeric or vector columns side by side in one vector column."""
    return VectorAssembler(inputCols=columns, outputCol=output).transform(df)


def to_arrays(df: DataFrame, features: str = "features") -> DataFrame:
    """The vector column as ``array<double>``."""
    return df.withColumn(features, vector_to_array(F.col(features)))


def to_vectors(df: DataFrame, features: str = "features", sparse: bool = True) -> DataFrame:
    """The array column as vectors, stored sparse where that is smaller."""
    dense = df.withColumn(features, array_to_vector(F.col(features)))
    if not sparse:
        return dense
    # The assembler keeps whichever of the two forms is smaller.
    packed = assemble(dense.withColumnRenamed(features, "__dense"), ["__dense"], features)
    return packed.select(*df.columns)
