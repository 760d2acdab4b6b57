from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, "x" * 300_000), (None, "no id here"),
            (7, "same text of some words"), (7, "same text of some words"), (8, "same text of some words"),
            (9, "É è ﬁ 😀 ▁ \x00 \x0b z"), (10, "a b c　d")]
    return rows
