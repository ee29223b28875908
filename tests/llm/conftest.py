import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def vocab():
    from churnforge.llm.queries import vocabulary
    return vocabulary


@pytest.fixture(scope="session")
def docs_of(spark):
    """Small documents tables: (id, text[, lang[, source]]) rows plus clashing extra columns."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            for c in ("ids", "key", "word", "fingerprint", "kept", "norm", "h", "length", "host", "item"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df
    return make
