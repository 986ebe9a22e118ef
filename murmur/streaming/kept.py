"""Greedy fuzzy dedup of a stream with keyed state: kept texts lie in pages by length, so that an item reads only the pages whose
texts can resemble it, and a batch rewrites only the last page of a length class."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from murmur.operators.candidates import Block, _least_share, possible
from murmur.operators.dedup import RULES

#: Kept texts in a page of the state.
PAGE = 256


class Kept(StatefulProcessor):
    """State of a group: pages of kept texts by (length class, number), and the pages that a class has."""

    def __init__(self, rule: str, ttl: int | None = None) -> None:
        self.same, self.clauses, self.ttl = RULES[rule].same, RULES[rule].clauses, ttl
        views = {c.view for c in self.clauses}
        self.view = views.pop() if len(views) == 1 else None
        self.share = min(map(_least_share, self.clauses)) if self.view else 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "class int, page int", "texts array<string>", self.ttl)
        self.counts = handle.getMapState("counts", "class int", "pages int", self.ttl)

    def length_class(self, size: float) -> int:
        return int(math.log(max(size, 1.0), 1.25)) if self.share else 0

    def classes(self, size: int) -> range:
        """The classes of all lengths that a text of this length can resemble; a rule that bounds no length has one class."""
        if not self.share:
            return range(1)
        return range(self.length_class(size * self.share - 1), self.length_class((size + 1) / self.share + 1) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        x = pd.concat(list(rows)).dropna(subset=["text"]).sort_values("pos", kind="stable")
        # equal texts: a rule need not hold between a text and itself (a short one may resemble nothing), so all of them are met
        texts = x["text"].tolist()
        sizes = [len(self.view(t) or "") if self.view else 0 for t in texts]
        out = np.zeros(len(texts), bool)
        wanted: dict[int, list[int]] = {}
        for i, n in enumerate(sizes):
            for c in self.classes(n):
                wanted.setdefault(c, []).append(i)
        for c, mine in wanted.items():
            for page in range(self._pages(c)):
                held = self.pages.getValue((c, page))
                left = [i for i in mine if not out[i]]
                if held is None or not left:
                    continue
                held = list(held[0])
                for a, b in possible(Block([texts[i] for i in left], self.clauses), Block(held, self.clauses)):
                    for i, j in zip(a.tolist(), b.tolist(), strict=True):
                        if not out[left[i]] and self.same(texts[left[i]], held[j]):
                            out[left[i]] = True
        left = [i for i in range(len(texts)) if not out[i]]
        meets: dict[int, list[int]] = {}
        if left:
            block = Block([texts[i] for i in left], self.clauses)
            for a, b in possible(block, block, ordered=lambda i, j: j < i):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    meets.setdefault(left[i], []).append(left[j])
        new: dict[int, list[str]] = {}
        for i in left:
            out[i] = any(not out[j] and self.same(texts[i], texts[j]) for j in meets.get(i, ()))
            if not out[i]:
                new.setdefault(self.length_class(sizes[i]), []).append(texts[i])
        for c, more in new.items():
            self._append(c, more)
        y = x[~out]
        # plain objects: pandas' own strings may become chunked arrays, which have no place in a struct
        yield pd.DataFrame({"group": pd.Series([key[0]] * len(y), dtype=object), "pos": y["pos"].to_numpy("int64"), "text": pd.Series(y["text"].tolist(), dtype=object)})

    def _pages(self, c: int) -> int:
        found = self.counts.getValue((c,))
        return 0 if found is None else found[0]

    def _append(self, c: int, more: list[str]) -> None:
        last = max(self._pages(c) - 1, 0)
        held = self.pages.getValue((c, last))
        more = [*(held[0] if held is not None else ()), *more]
        for k in range(0, len(more), PAGE):
            self.pages.updateValue((c, last + k // PAGE), (more[k : k + PAGE],))
        self.counts.updateValue((c,), (last + (len(more) - 1) // PAGE + 1,))

    def close(self) -> None:
        pass
