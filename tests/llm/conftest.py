import pyarrow.parquet as pq
import pytest
from helpers import ODD, SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of users whose names the operators use inside.
CLASHES = ("__text", "__group", "__key", "__size", "size", "fp", "h", "x", "lang_pred", "score", "position", "bucket", "copies", "t")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(ODD, SCHEMA)
    return plain.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    from riskweir.llm.common import documents

    return documents(spark, SF)


@pytest.fixture(scope="session")
def table():
    """The same documents as a list of rows."""
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()
