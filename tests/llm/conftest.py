import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_tables as corpus
import pytest


@pytest.fixture(scope="session")
def odd_rows():
    return corpus.document_rows()


@pytest.fixture(scope="session")
def odd_folder(tmp_path_factory, odd_rows):
    labels = [(row[0], 0 if row[1] and ("$$$" in row[1] or " | " in row[1]) else 1, 0) for row in odd_rows]
    return corpus.folder(tmp_path_factory.mktemp("odd"), odd_rows, [*labels, (1, None, None), (2, 7, 0), (10**9, 1, 0)])


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory):
    return corpus.folder(tmp_path_factory.mktemp("empty"), [])
