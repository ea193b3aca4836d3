"""Small documents that every operator must stand: nulls, empty and long texts, ties, repeated rows and clashing columns."""

import pytest

DATA = "/root/testdata/sf0.001"

LONG = " ".join(f"w{k % 997}" for k in range(30_000))
ODD = [
    (None, "a null id has a text of its own"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "same words in two rows here"),
    (5, "same words in two rows here"),
    (5, "the same id with another text"),
    (6, "same words in two rows here"),
    (7, "Größe Éte <b>&amp;</b> 12 x\r\n"),
]
# Names that operators use for their own columns.
CLASHING = "doc_id bigint, text string, version bigint, keep boolean, fp bigint, n_words string, score string, root int, _keep string, pos int"


@pytest.fixture
def odd(frame):
    """The documents with columns whose names clash."""
    return frame([(i, t, 1, True, 2, "n", "s", 3, "k", 4) for i, t in ODD], CLASHING)


@pytest.fixture
def nothing(frame):
    return frame([], CLASHING)
