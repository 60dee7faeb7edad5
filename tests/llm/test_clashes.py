"""What keeps the columns of documents keeps all of them, whatever their names."""

import numpy as np
import pytest

from pagemart.llm import line_dedup, mixing, ngram_join
from pagemart.llm.ngram_join import Slice

from .conftest import CLASHES, rows_of


@pytest.mark.parametrize(
    "keep",
    [
        lambda docs: line_dedup.deduplicated(docs).drop("n_token_lines", "n_removed"),
        ngram_join.one_of_each,
        lambda docs: mixing.mixed_documents(docs, keep_all=True),
    ],
    ids=["line dedup", "n-gram join", "mixing"],
)
def test_other_columns_stay(documents, clashing, keep):
    found = keep(clashing)
    assert found.columns == clashing.columns
    assert {tuple(r) for r in found.select(*CLASHES).collect()} == {("clash",) * len(CLASHES)}
    assert rows_of(found.select(documents.columns)) == rows_of(keep(documents).select(documents.columns))


def test_shards_get_the_classes_that_own_their_keys():
    draw = np.random.default_rng(4)
    sizes = {}
    for shards in (30, 1700):
        part = Slice(shards)
        for cls in range(2000):
            part.add(cls, draw.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2), 100)
        dealt = part.dealt().to_pylist()
        sizes[shards] = sum(len(r["classes"]) for r in dealt)
        keys, classes = ngram_join.gathered(dealt)
        assert len(keys) == 80_000 and set(np.bincount(classes)) == {40}
    assert sizes[1700] <= 8 * 80_000 < 1700 * 8 * 2000 / 10
