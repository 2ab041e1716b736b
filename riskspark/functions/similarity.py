"""Similarity of header texts to the known aliases."""

from __future__ import annotations

import numpy as np
import pandas as pd

from riskspark import schema


class AliasMatcher:
    """Normalised indel ratio 2*LCS/(len a + len b) of a text to every alias at once.

    The common subsequence is counted with one bit per alias character; all aliases fit
    64 bits, so one step per character of the text serves the whole alias table.
    """

    def __init__(self, table: list[tuple[str, str]] | None = None):
        table = table or schema.aliases()
        self.fields = [field for _, field in table]
        self.lengths = np.array([len(alias) for alias, _ in table])
        chars = sorted({ch for alias, _ in table for ch in alias})
        self.masks = {
            ch: np.array(
                [sum(1 << i for i, c in enumerate(alias) if c == ch) for alias, _ in table], dtype=np.uint64)
            for ch in chars
        }
        self.used = np.array([(1 << len(alias)) - 1 for alias, _ in table], dtype=np.uint64)

    def ratios(self, text: str) -> np.ndarray:
        rows = np.full(len(self.lengths), ~np.uint64(0))
        for ch in text:
            mask = self.masks.get(ch)
            if mask is not None:
                hit = rows & mask
                rows = (rows + hit) | (rows - hit)
        common = np.bitwise_count(~rows & self.used)
        return 2.0 * common / (self.lengths + len(text))

    def best(self, text: str) -> tuple[str, float]:
        """First best alias in declaration order."""
        scores = self.ratios(text)
        i = int(np.argmax(scores))
        return self.fields[i], float(scores[i])


def best_alias(headers: pd.Series) -> pd.DataFrame:
    matcher = AliasMatcher()
    found = [matcher.best(h) if isinstance(h, str) else (None, None) for h in headers]
    return pd.DataFrame(found, columns=["field", "score"])
