import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def texts_frame(spark):
    """Documents from a list of texts, with columns whose names the operators use themselves."""

    def build(texts, **columns):
        names = {"lang": ["en"] * len(texts), "source": ["s"] * len(texts)} | columns
        clash = "_text string, _size long, size string, kept string, node long, bucket string, target string, score string"
        schema = f"doc_id long, text string, {', '.join(f'{name} string' for name in names)}, n_chars long, {clash}"
        rows = [
            (k, text, *(values[k] for values in names.values()), len(text or ""), "x", 1, "y", "z", 2, "b", "t", "s")
            for k, text in enumerate(texts)
        ]
        return spark.createDataFrame(rows, schema)

    return build
