"""The best ``k`` documents per query, kept by a task over the batches it reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Matrix cells held at once by a task.
CELLS = 4_000_000

# Queries that are compared at a time: with more, few vectors would fit in the cells.
QUERIES_AT_ONCE = 1024


class BestPerQuery:
    """Lowest costs first, equal costs in document order."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.n_queries = n_queries
        # Query, cost and document of what is kept, by the first of the queries that were offered together.
        self._kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # Cost of the worst kept document, once a query has ``k`` of them.
        self.edge = np.full(n_queries, np.inf)

    def _whole(self, column: int, empty: np.ndarray | None) -> np.ndarray | None:
        return np.concatenate([self._kept[first][column] for first in sorted(self._kept)]) if self._kept else empty

    @property
    def query(self) -> np.ndarray:
        return self._whole(0, np.empty(0, dtype=np.int64))

    @property
    def cost(self) -> np.ndarray:
        return self._whole(1, np.empty(0))

    @property
    def doc(self) -> np.ndarray | None:
        return self._whole(2, None)

    def add(self, cost: np.ndarray, docs: np.ndarray, first: int = 0) -> None:
        """Offer documents: one row per query, one column per document, inf for no hit.

        The rows are the queries from ``first`` on; whoever offers documents to some queries at a time always takes the same ones together.
        """
        if self.k <= 0 or cost.size == 0:
            return
        kth = min(self.k, cost.shape[1]) - 1
        edge = np.minimum(np.partition(cost, kth, axis=1)[:, kth], self.edge[first : first + len(cost)])
        query, column = np.nonzero((cost <= edge[:, None]) & np.isfinite(cost))
        self.offer(query + first, cost[query, column], docs[column], first)

    def offer(self, query: np.ndarray, cost: np.ndarray, doc: np.ndarray, first: int = 0) -> None:
        """The same by single pairs: number of the query, cost, document."""
        if self.k <= 0 or not len(query):
            return
        if first in self._kept:
            query, cost, doc = (np.concatenate(both) for both in zip(self._kept[first], (query, cost, doc)))
        order = np.lexsort((doc, cost, query))
        query, cost, doc = query[order], cost[order], doc[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        query, cost, doc = self._kept[first] = query[keep], cost[keep], doc[keep]
        full = place[keep] == self.k - 1
        self.edge[query[full]] = cost[full]

    def table(self, queries: pa.Table, keys: list[str], name: str, sign: float = 1.0) -> pa.Table:
        """Kept rows: the keys of the query, ``doc_id``, and ``sign * cost`` as ``name``."""
        rows = pa.array(self.query)
        columns = {key: queries.column(key).take(rows) for key in keys}
        columns["doc_id"] = pa.array([] if self.doc is None else self.doc)
        columns[name] = pa.array(sign * self.cost)
        return pa.table(columns)


def true_cells(hit: np.ndarray) -> np.ndarray:
    """Flat positions of the few cells of a contiguous matrix that are true; eight of them are looked at together."""
    flat = hit.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    word, cell = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + cell, whole + np.flatnonzero(flat[whole:])])


def id_array(ids) -> np.ndarray:
    """Document ids of an Arrow column as a NumPy array that sorts like Spark does."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.to_numpy()
    return np.asarray(ids.to_pylist())
