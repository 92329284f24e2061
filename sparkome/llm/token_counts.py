"""Token counts without segmentations: the count-only Viterbi pass of the unigram vocabulary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .spm import _in, _rows, count_text


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: how many pieces the best path of each whole text has. No shuffle, one row for each row.

    Null and empty texts count 0. Ties follow the tokenizer (see spm): a path's count is the count of the
    path that the tokenizer would return, not the least or largest of equal paths.
    """
    return _in(docs, id_col, text_col).mapInArrow(_rows(lambda text: (count_text(text or "", model_path),), ["n_tokens"], [pa.int64()]), "doc_id long, n_tokens long")
