"""Prefix dynamic programming over byte-pair vocabularies.

Every prefix of a word has exactly one encoding, and its last token decides how
it goes on: a token may follow another if no merge would have crossed the
border between them.  So one pass over the prefixes relaxes, for each, the one
token that ends there and may follow the encoding of what is before it.
"""

from __future__ import annotations

from collections.abc import Callable


class Borders:
    """Which token may directly follow which.

    `parts` holds the two tokens each token was merged from (atoms are absent),
    `order` the place of that merge among all merges, and `merge_order(a, b)`
    the place of the merge of two neighbours, or None.
    """

    def __init__(self, parts: dict[int, tuple[int, int]], order: dict[int, int],
                 merge_order: Callable[[int, int], int | None], remembered: int = 500_000):
        self.parts, self.order, self.merge_order, self.remembered = parts, order, merge_order, remembered
        self._known: dict[int, bool] = {}

    def stays(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= self.remembered:
                self._known.clear()
            known = self._known[key] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        """Walk back through the merges on both sides, the latest first.

        Before a merge is undone, the two tokens at the border must not be a
        pair that merges earlier than it.  On a tie the pair further left goes
        first.
        """
        if self.merge_order(left, right) is not None:
            return False
        order, parts = self.order, self.parts
        while True:
            at_left, at_right = order.get(left, -1), order.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                left = parts[left][1]
                crossing = self.merge_order(left, right)
                if crossing is not None and crossing < at_left:
                    return False
            else:
                right = parts[right][0]
                crossing = self.merge_order(left, right)
                if crossing is not None and crossing <= at_right:
                    return False


def merge_all(atoms: list[int], merge: Callable[[int, int], tuple[int, int] | None]) -> list[tuple[int, tuple[int, int] | None]]:
    """Tokens of a short word by merging in order: (token, the pair it was last merged from).

    Only used to learn from which pair each vocabulary entry is made.
    """
    tokens: list[tuple[int, tuple[int, int] | None]] = [(a, None) for a in atoms]
    while len(tokens) > 1:
        found = [(m[0], i, m[1]) for i in range(len(tokens) - 1) if (m := merge(tokens[i][0], tokens[i + 1][0])) is not None]
        if not found:
            break
        _, i, token = min(found)
        tokens[i:i + 2] = [(token, (tokens[i][0], tokens[i + 1][0]))]
    return tokens
