"""The best entries of each query, kept while candidates stream by; for operators on Arrow batches."""

from __future__ import annotations

#: Entries that wait before they are sorted in, at least.
LEAST_WAITING = 500_000


class Best:
    """The `depth` entries of the highest score of each of `n` queries; ties go to the lesser document.

    `bar` holds for each query the score below which nothing can enter any more. Memory is bounded by twice
    the entries kept or LEAST_WAITING, and by what one offer adds.
    """

    def __init__(self, n: int, depth: int, least: float = float("-inf")):
        import numpy as np

        self.depth, self.bar = depth, np.full(n, least)
        self.most = max(LEAST_WAITING, n * depth)
        self.queries, self.documents, self.scores = [], [], []
        self.kept = self.waiting = 0

    def offer(self, queries, documents, scores) -> None:
        """Arrays of candidates; those below their query's bar may be left out."""
        if len(queries):
            self.queries.append(queries)
            self.documents.append(documents)
            self.scores.append(scores)
            self.waiting += len(queries)
            if self.waiting > self.most:
                self.settle()

    def settle(self):
        """(queries, documents, scores) of what is kept, by query and place."""
        import numpy as np

        if not self.queries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, d, s = np.concatenate(self.queries), np.concatenate(self.documents), np.concatenate(self.scores)
        order = np.argsort(-s)
        same = s[order][1:] == s[order][:-1]
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if len(s) else order
        order[tied] = order[tied][np.lexsort((d[order[tied]], -s[order[tied]]))]
        order = order[np.argsort(q[order].astype(np.uint16) if len(self.bar) < 1 << 16 else q[order], kind="stable")]  # by counting, where numbers are short
        q, d, s = q[order], d[order], s[order]
        first = np.searchsorted(q, q, "left")
        place = np.arange(len(q)) - first
        kept = place < self.depth
        last = place == self.depth - 1
        self.bar[q[last]] = s[last]
        q, d, s = q[kept], d[kept], s[kept]
        self.queries, self.documents, self.scores, self.waiting = [q], [d], [s], 0
        return q, d, s
