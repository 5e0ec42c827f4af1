"""Suffix automaton of word sequences, for matching statistics."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """Accepts every run of consecutive words of its references, which are added one by one.

    States are kept in flat lists: longest match length, suffix link and a
    transition dict each; at most two states arise for a word.
    """

    def __init__(self, reference: list[bytes] | None = None) -> None:
        self.length, self.link, self.next, self.last = [0], [-1], [{}], 0
        self.extend(reference or [])

    def extend(self, reference: list[bytes]) -> None:
        """Add a reference; a word of its own that no query has parts it from the one before."""
        length, link, nxt = self.length, self.link, self.next
        last = self.last
        for word in (*reference, object()) if reference else ():
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nxt.append({})
            at = last
            while at >= 0 and word not in nxt[at]:
                nxt[at][word] = new
                at = link[at]
            if at >= 0:
                found = nxt[at][word]
                if length[found] == length[at] + 1:
                    link[new] = found
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[found])
                    nxt.append(dict(nxt[found]))
                    while at >= 0 and nxt[at].get(word) == found:
                        nxt[at][word] = copy
                        at = link[at]
                    link[found] = link[new] = copy
            last = new
        self.last = last

    def matching_statistics(self, query: list[bytes]) -> np.ndarray:
        """For each position of ``query`` the longest run ending there that the reference holds."""
        out = np.empty(len(query), np.int64)
        length, link, nxt = self.length, self.link, self.next
        state = matched = 0
        for i, word in enumerate(query):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(word)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            out[i] = matched
        return out
