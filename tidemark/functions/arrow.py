"""Pieces of texts in Arrow batches; this runs inside tasks, so it is pickled by value: executors need no copy of it."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def coded_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the number of each piece of all texts, and the pieces by number.

    Arrow's white space is that of the patterns; only at the ends of a text it leaves an empty piece.
    """
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), lengths), coded.indices.to_numpy(), coded.dictionary


def tallied(first: np.ndarray, second: np.ndarray, seconds: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The different pairs of two numbers, in order, the second one below ``seconds``; and how often each pair stands."""
    places = np.sort(first.astype(np.int64) * seconds + second)
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    return np.divmod(places[starts], seconds), np.diff(starts, append=len(places)).astype(np.int32)
