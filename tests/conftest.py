import pytest
from pyspark.sql import SparkSession

from ratebook.session import configure

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = configure(
        SparkSession.builder.master("local[8]").appName("ratebook-tests"),
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__maxMetadataStringLength="4000",
        spark__sql__debug__maxToStringFields="1000",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    ).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
