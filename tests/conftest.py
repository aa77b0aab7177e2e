from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidemark.schemas import CHANGELOG
from tidemark.session import session

START = datetime(2031, 7, 9, 5, 41, 36)


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tidemark-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "3",
            # Tiny frames: compiling would take longer than running. The comparisons compile.
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """A changelog out of (transaction, offset in ms, further fields) tuples."""

    def make(*rows, **common):
        entries = []
        for number, (tx, offset, *more) in enumerate(rows, start=1):
            entry = {
                "id": number,
                "entity_type": "vessel",
                "entity_id": "618",
                "table_name": "vessel",
                "row_id": "618",
                "operation": "UPDATE",
                "old_values": None,
                "new_values": None,
                "transaction_id": tx,
                "created_at": START + timedelta(microseconds=round(offset * 1000)),
                **common,
                **(more[0] if more else {}),
            }
            entries.append(tuple(entry[f] for f in CHANGELOG.fieldNames()))
        return spark.createDataFrame(entries, CHANGELOG)

    return make


def rows(df, *columns):
    """Rows as sorted tuples, of the given columns or of all in name order."""
    picked = df.select(*(columns or sorted(df.columns)))
    return sorted((tuple(r) for r in picked.collect()), key=repr)
