import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cobbler.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


#: A null id, null and empty texts, repeated rows, white space only, one long line, clashing extra columns.
EDGE = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "null id"),
        (None, "null id"), (4, " \n\t\n "), (5, "Alpha Beta Gamma Delta Epsilon Zeta"), (6, "word " * 3000), (7, "x" * 5000), (8, "é ñ 日本 😀 <|endoftext|>")]
EXTRA = ["key", "digest", "n", "node", "text_key", "first", "rank", "start", "spans", "line_no", "id_", "w"]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, *[k] * len(EXTRA)) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in EXTRA))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (99, 1, 0), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.limit(0)
